"""Set-similarity join of documents on word n-grams by T-occurrence search.

A document is the set of its distinct ``k``-word shingles (64-bit hashes). Two
documents link when their Jaccard similarity reaches ``percent`` / 100, that is
when they share at least T shingles, T following from both sizes.

* A count sketch over all shingles of all documents orders shingles from rare to
  common; any two linked documents share a shingle among the
  ``n - ceil(t n) + 1`` rarest of each. Of those, the ones that the sketch knows
  to be in one document only are left out, and the others are dealt out. The
  sketch has a place for each shingle up to ``MOST_PLACES``; in a larger corpus
  it still tells common shingles from others, but knows fewer single ones, so
  more is dealt out. Results are the same with any sketch.
* All holders of such a shingle go to the block of its first holder. Holders
  within a task are gathered there first, so a shingle that very many documents
  hold is no hot key. Inside a block, ``DivideSkip`` answers the T-occurrence
  query of each document: it heap-merges its short inverted lists, binary-probes
  the long ones, and retains documents that reach T.
* Blocks of more than ``block_size`` documents are dealt over several tasks that
  all hold the first document; what stays unlinked to the largest component of
  the block is searched against every part of the block.

Documents with equal shingle sets are one node. Links inside a known component
need no further proof, so a group of copies costs a chain, not all pairs.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ADDRESS, addressed, components, forget, materialize, maybe_in, releasing, strings, text_batches, without_rows

_M = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
#: Least and most places of the count sketch, two bits each once it is merged (64 MB
#: at most). They only order shingles and leave out single ones; results are exact.
LEAST_PLACES, MOST_PLACES = 1 << 20, 1 << 28
#: bytes of text for each shingle, to size the sketch by the corpus
TEXT_BYTES = 6.5
CHUNK = 1 << 16
#: shingles that a task counts, and postings that it gathers, at a time
FLUSH = 1_000_000


class WordHashes(dict):
    """64-bit hash of each word, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text: A-Z lowered,
    words between ASCII white space. Fewer than ``k`` words: the whole sequence
    as one; no words: empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    k = min(k, n)
    h = w[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _M + w[j : n - k + 1 + j]
    h = (h ^ (h >> np.uint64(31))) * _A
    return np.unique(h ^ (h >> np.uint64(30)))


def least_overlap(n: int, percent: int) -> int:
    """Shingles that any partner of a set of ``n`` must share with it."""
    return -(-percent * n // 100)


def linked(overlap: int, n: int, m: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


class DivideSkip:
    """Inverted lists over the sets of a block, and T-occurrence queries. Shingles
    in fewer than ``least`` sets get no list: with 2, results are exact for
    queries that are indexed sets themselves, and most shingles take no memory."""

    def __init__(self, sets: list[np.ndarray], percent: int, least: int = 1):
        self.percent, self.sets = percent, sets
        flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        holder = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, holder = flat[order], holder[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)])
        size = np.diff(first, append=len(flat))
        wanted = size >= least
        self.lists: dict[int, list[int]] = {int(flat[i]): holder[i : i + n].tolist() for i, n in zip(first[wanted], size[wanted])}

    def search(self, query: np.ndarray, skip=lambda y: False) -> Iterator[int]:
        """Indexed sets linked with ``query``. ``skip(y)`` is asked before ``y``
        is probed and may change between results."""
        n = len(query)
        t = least_overlap(n, self.percent)
        found = sorted((self.lists[x] for x in query.tolist() if x in self.lists), key=len)
        # t - 1 of the lists may be set aside: a result occurs in the others too
        aside = min(t - 1, max(0, len(found) - 1))
        short, long = found[: len(found) - aside], found[len(found) - aside :]
        need = t - aside
        counts: list[tuple[int, int]] = []
        last, c = -1, 0
        for y in heapq.merge(*short):
            if y == last:
                c += 1
                continue
            if c >= need:
                counts.append((-c, last))
            last, c = y, 1
        if c >= need:
            counts.append((-c, last))
        for c, y in sorted(counts):
            m = len(self.sets[y])
            total = -(-self.percent * (n + m) // (100 + self.percent))
            if min(n, m) < total or skip(y):
                continue
            overlap, left = -c, len(long)
            for ids in reversed(long):
                if overlap + left < total:
                    break
                left -= 1
                at = bisect_left(ids, y)
                overlap += at < len(ids) and ids[at] == y
            if linked(overlap, n, m, self.percent):
                yield y


class Forest:
    """Union-find over positions of a block."""

    def __init__(self, start: list[int]):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(c, i) for i, c in enumerate(start)]

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def search_block(rows: list[tuple[int, int, bool, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links (node, node) of a block that join components not joined before.
    rows: node, its component so far, whether it is asked about, its set."""
    rows = sorted(rows, key=lambda r: (len(r[3]), r[0]))
    forest = Forest([r[1] for r in rows])
    if len({forest.find(i) for i in range(len(rows))}) == 1:
        return []
    index = DivideSkip([r[3] for r in rows], percent, least=2)
    out = []
    for x, (node, _, asked, s) in enumerate(rows):
        if asked:
            for y in index.search(s, lambda y: forest.find(y) == forest.find(x)):
                if forest.join(x, y):
                    out.append((node, rows[y][0]))
    return out


# -- distributed steps --------------------------------------------------------


def _places(s: np.ndarray, places: int) -> np.ndarray:
    return ((s >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.uint32)


def _gaps(places: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Chunks of sorted places, and the steps from each place to the next in its
    chunk as bytes; 255 is a step of 255 that ends at no place."""
    chunks = places // CHUNK
    starts = np.flatnonzero(np.diff(chunks, prepend=-1))
    gap = np.diff(places, prepend=0).astype(np.int64)
    gap[starts] = places[starts] % CHUNK
    ends = np.cumsum(gap // 255 + 1)
    out = np.full(ends[-1], 255, np.uint8)
    out[ends - 1] = gap % 255
    return chunks[starts], [x.tobytes() for x in np.split(out, ends[starts[1:] - 1])]


def _from_gaps(steps: bytes) -> np.ndarray:
    b = np.frombuffer(steps, np.uint8)
    return np.cumsum(b, dtype=np.int64)[b != 255]


def _sketch(k: int, places: int, most: int):
    """Places of a task's shingles, each as often as it occurs but ``most`` times
    for each FLUSH shingles, by chunk."""

    def told(held):
        at, counts = np.unique(np.concatenate(held), return_counts=True)
        chunks, steps = _gaps(np.repeat(at, np.minimum(counts, most)))
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(steps, pa.binary())], ["chunk", "steps"])

    def run(batches):
        cache, held, n = WordHashes(), [], 0
        for batch in batches:
            for t in strings(batch.column(0)):
                held.append(_places(shingles(t, k, cache), places))
                n += len(held[-1])
                if n > FLUSH:
                    yield told(held)
                    held, n = [], 0
        if n:
            yield told(held)

    return releasing(run)


def _merge_sketch(levels: list[float]):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c not in total:
                    total[c] = np.zeros(CHUNK, np.uint32)
                total[c] += np.bincount(_from_gaps(b), minlength=CHUNK).astype(np.uint32)
        for c, x in total.items():
            level = np.searchsorted(levels, x).astype(np.uint8).reshape(-1, 4)
            packed = level[:, 0] | level[:, 1] << 2 | level[:, 2] << 4 | level[:, 3] << 6
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["chunk", "levels"])

    return run


def frequency_levels(texts: DataFrame, k: int, most_places: int = MOST_PLACES) -> tuple[np.ndarray, int]:
    """Two bits for each place of shingles, and the count of places: a shingle is
    in one document (0), or its place was met as often as others (1), clearly more
    often (2) or very often (3). Chance meetings are allowed for by the mean count
    of a place, so that a full sketch still tells common shingles from others."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("double")), F.lit(0.0))).first()[0] / TEXT_BYTES
    places = CHUNK * math.ceil(min(max(size, LEAST_PLACES), most_places) / CHUNK)
    mean = size / places
    levels = [1, 7 + 4 * mean, 63 + 16 * mean]
    merged = texts.mapInArrow(_sketch(k, places, int(levels[-1]) + 1), "chunk int, steps binary").repartition("chunk").mapInArrow(_merge_sketch(levels), "chunk int, levels binary").toArrow()
    out = np.zeros(places // 4, np.uint8)
    for chunk, part in zip(merged["chunk"], merged["levels"]):
        out[chunk.as_py() * CHUNK // 4 : (chunk.as_py() + 1) * CHUNK // 4] = np.frombuffer(part.as_buffer(), np.uint8)
    return out, places


def rare_first(s: np.ndarray, levels: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The same order of shingles for all documents, rare ones first, then by
    hash (``s`` is sorted), and the level of each."""
    at = _places(s, places).astype(np.int64)
    level = levels[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3
    return np.argsort(level, kind="stable"), level


def _describe(k: int, percent: int, sketch):
    """Of each text: count and digest of its shingles, and those of its rarest
    that may be in another document too."""

    def run(batches):
        cache, (levels, places) = WordHashes(), sketch.value
        for batch in batches:
            texts, passed = strings(batch.column(0)), batch.columns[1:]
            for i in range(0, len(texts), 2000):
                n, digest, keys = [], [], []
                for t in texts[i : i + 2000]:
                    s = shingles(t, k, cache)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    order, level = rare_first(s, levels, places)
                    p = order[: len(s) - least_overlap(len(s), percent) + 1] if len(s) else order
                    keys.append(s[p[level[p] > 0]].view(np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                made = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, len(n)) for c in passed), *made], [*batch.schema.names[1:], "n_shingles", "digest", "keys"])

    return releasing(run)


def _gather(batches):
    """Postings (node, key) of a task, FLUSH at a time: each key's least node there
    is its head; ``many`` tells whether it has other nodes there."""

    def told(nodes, keys):
        order = np.lexsort((nodes, keys))
        nodes, keys = nodes[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(first, append=len(keys))
        for i in range(0, len(keys), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(np.repeat(nodes[first], size)[part]), pa.array(nodes[part]), pa.array(np.repeat(size > 1, size)[part])], ["key", "head", "node", "many"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= FLUSH:
            yield from told(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield from told(*map(np.concatenate, zip(*held)))


MEMBER = "block long, part int, piece int, node long, comp long, asked boolean, items array<long>"


def _sets(k: int):
    """Sets of texts that have the digest asked for, once for each place that a
    node goes to; rows are sorted by node and group of places, of repeated rows
    one is taken."""

    def run(batches):
        cache, last = WordHashes(), None
        for batch in batches:
            node, group, want, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strings(batch.column(3))
            places = batch.column(4).to_pylist()
            rows, n = [], 0
            for i in range(len(node)):
                if (node[i], group[i]) == last:
                    continue
                s = shingles(texts[i], k, cache)
                if xxhash.xxh3_128_digest(s.tobytes()) != want[i]:
                    continue
                last = node[i], group[i]
                for p in places[i]:
                    rows.append((p["block"], p["part"], p["piece"], node[i], p["comp"], p["asked"], s.view(np.int64)))
                    n += len(s)
                    if n > 500_000:
                        yield _members(rows)
                        rows, n = [], 0
            if rows:
                yield _members(rows)

    return releasing(run)


def _members(rows):
    block, part, piece, node, comp, asked, sets = zip(*rows)
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(piece, pa.int32()), pa.array(node, pa.int64()), pa.array(comp, pa.int64()), pa.array(asked, pa.bool_()), items], ["block", "part", "piece", "node", "comp", "asked", "items"])


def _blocks(percent: int):
    """Partitions sorted by block, part and piece; one block is held at a time."""

    def run(batches):
        at, rows = None, []

        def done():
            got = search_block(list({r[0]: r for r in sorted(rows, key=lambda r: r[2])}.values()), percent)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["u", "v"])

        for batch in batches:
            block, part, piece, node, comp, asked = (batch.column(i).to_pylist() for i in range(6))
            items = batch.column(6)
            ends, flat = items.offsets.to_numpy(), items.values.to_numpy().view(np.uint64)
            for i in range(len(node)):
                if (block[i], part[i], piece[i]) != at:
                    if rows:
                        yield done()
                    at, rows = (block[i], part[i], piece[i]), []
                rows.append((node[i], comp[i], asked[i], flat[ends[i] : ends[i + 1]].copy()))
        if rows:
            yield done()

    return releasing(run)


def _search(members: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links within each (block, part, piece). members: block, part, piece, node,
    comp, asked; nodes: node, digest, id, none, sig of all that can be members;
    docs: id, none, sig, text.

    Only texts of members are shuffled, by id and a hash of the text, and their
    sets are made anew; a node goes to up to 256 places in one row."""
    places = members.groupBy("node", F.expr("pmod(xxhash64(block, part, piece), 1 + part div 256)").alias("bunch"))
    places = places.agg(F.collect_list(F.struct("block", "part", "piece", "comp", "asked")).alias("places"))
    need = materialize(places.join(nodes, "node"), "need")
    wanted = maybe_in(need.select(F.xxhash64("id", "none", "sig")))
    few = docs.filter(wanted(F.xxhash64("id", "none", "sig")))
    texts = need.join(few, ["id", "none", "sig"]).select("node", "bunch", "digest", "text", "places").sortWithinPartitions("node", "bunch")
    rows = texts.mapInArrow(_sets(k), MEMBER)
    found = rows.repartition("block", "part", "piece").sortWithinPartitions("block", "part", "piece").mapInArrow(_blocks(percent), "u long, v long")
    links = materialize(found, "links")
    forget(need)
    return links


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, block_size: int = 256, most_places: int = MOST_PLACES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the columns named in ``carry`` for
    each row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links, the row's own
    included. Null or wordless texts: no shingles, linked with nothing. Null ids
    come last among ids, and stay null if a component has no other. Repeated
    rows are rows of their own in one component. Other columns are ignored.
    ``kept`` marks one row of each component, one with its least id. Shingles are
    compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    text_batches(spark)
    passed = docs.select("text", F.col("doc_id").cast("long"), F.xxhash64("text").alias("sig"), *carry)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.schema[1:])
    docs = passed.select("doc_id", "sig", "text")
    sketch = spark.sparkContext.broadcast(frequency_levels(docs.select("text"), k, most_places))
    rows = passed.mapInArrow(_describe(k, percent, sketch), f"{shape}, n_shingles long, digest binary, keys array<long>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sets")
    sketch.destroy()  # or Python workers would keep it
    key = (F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "sig")
    docs = docs.select(*key, "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"), F.col("sig").alias("sig")))
    classes = rows.filter("n_shingles > 0").groupBy("digest").agg(first.alias("first"), F.count("*").alias("size"))
    classes = materialize(classes.select("digest", F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.sig").alias("sig"), "size"), "classes")
    nodes = classes.select("node", "digest", *key)

    # one row of each class deals out its keys. Sizes of linked documents differ
    # by one band at most: each is dealt to its band and the next
    keyed = rows.filter("size(keys) > 0").select(F.col("row").alias("node"), "n_shingles", "keys").join(classes.select("node"), "node")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n_shingles").cast("int")
    postings = keyed.select("node", F.explode("keys").alias("key"), band.alias("band"))
    postings = postings.select("node", F.explode(F.array(F.xxhash64("key", "band"), F.xxhash64("key", F.col("band") + 1))).alias("key"))
    postings = materialize(postings.mapInArrow(releasing(_gather), "key long, head long, node long, many boolean"), "postings")
    heads = postings.filter("node = head").select("key", "head", "many").repartition("key")
    shared = heads.groupBy("key").agg(F.count("*").alias("n"), F.min("head").alias("block"), F.max("many").alias("any")).filter("n > 1 or any").select("key", "block")
    blocks = materialize(heads.join(shared, "key").select("key", "head", "block", "many"), "heads")
    others = postings.filter("many and node <> head").select("key", "head", "node")
    within = others.join(blocks.filter("many").select("key", "head", "block"), ["key", "head"]).select("block", "node")
    pairs = materialize(blocks.select("block", F.col("head").alias("node")).union(within).distinct(), "blocks")
    forget(postings, blocks)

    sizes = pairs.groupBy("block").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.select("block", F.ceil(F.col("n") / block_size).cast("int").alias("parts")), "sizes")
    dealt = pairs.join(sizes, "block").withColumn("part", F.expr("pmod(xxhash64(node), parts)").cast("int"))
    dealt = materialize(dealt, "dealt")
    forget(pairs)
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    firsts = sizes.select("block", every("parts").alias("part"), F.col("block").alias("node"))
    members = dealt.select("block", "part", "node").union(firsts).distinct()
    members = members.select("block", "part", F.lit(0).alias("piece"), "node", F.col("node").alias("comp"), F.lit(True).alias("asked"))
    links = _search(members, nodes, docs, k, percent)
    roots = components(links)

    # blocks over several tasks: what is outside the largest component of its
    # block is asked about in every part, unless it is in that component
    # (block, part) is the key of all joins here: a part has about block_size rows
    slots = sizes.filter("parts > 1").select("block", every("parts").alias("part"))
    wide = dealt.filter("parts > 1").join(roots.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tally = wide.groupBy("block", "comp").agg(F.count("*").alias("n"))
    most = tally.groupBy("block").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("kinds")).filter("kinds > 1").select("block", F.col("m.comp").alias("main"))
    wide = materialize(wide.join(most.join(slots, "block"), ["block", "part"]), "wide")
    if not wide.isEmpty():
        asked = wide.filter("comp <> main")
        pieces = asked.groupBy("block").agg(F.ceil(F.count("*") / block_size).cast("int").alias("pieces")).join(slots, "block")
        asked = asked.join(pieces, ["block", "part"]).withColumn("piece", F.expr("pmod(xxhash64(node, 7), pieces)").cast("int"))
        q = asked.select("block", every("parts").alias("part"), "piece", "node", "comp", F.lit(True).alias("asked"))
        i = wide.join(pieces, ["block", "part"]).select("block", "part", every("pieces").alias("piece"), "node", "comp", F.lit(False).alias("asked"))
        more = _search(q.union(i), nodes, docs, k, percent)
        if not more.isEmpty():
            forget(roots)
            roots = components(links.union(more))
        forget(more)
    forget(wide, dealt, sizes, links)

    # both sides of these joins are tables, so Spark splits a large component or
    # class of copies
    known = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialize(known.select("digest", "root", "doc_id", "node", "size"), "known")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("f")
    least = known.groupBy("root").agg(first, F.count("*").alias("kinds"), F.sum("size").alias("all"))
    least = materialize(least.filter("kinds > 1 or all > 1").select("root", F.col("f.doc_id").alias("component_id"), F.col("f.node").alias("head")), "least")
    groups = materialize(known.join(least, "root").select("digest", "component_id", "head"), "groups")
    forget(classes, roots, known, least)
    out = rows.select("doc_id", "n_shingles", "digest", "row", *carry)
    with_sets = out.filter("n_shingles > 0").join(groups, "digest", "left")
    told = with_sets.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("row") == F.col("head"), F.lit(True)).alias("kept"), *carry)
    return told.union(out.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), *carry))


def keep_least(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``ngram_components`` keeps, one of each component,
    with all their columns; rows are told apart by their address."""
    placed = addressed(docs)
    told = ngram_components(placed, k, percent, carry=tuple(ADDRESS))
    return without_rows(placed, materialize(told.filter("not kept").select(*ADDRESS), "near-gone")).select(docs.columns)


# -- registered query ---------------------------------------------------------


def op5_ngram_join(spark, sf_dir):
    """Every row of documents with its component of links over 4-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_components(docs, k=4, percent=85).drop("kept")
