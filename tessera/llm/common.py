"""Shared pieces: scratch tables in the cluster's shared folder, mergeable
fixed-size sketches and distributed connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in
    ``spark.checkpoint.dir``; only where that is unset (tests) a folder is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, and any executor can read it after another one is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more: all that was
    made of them has itself been written."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python at most ``rows`` texts at a time: batches of Spark's default
    count of long texts would fill an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def release_memory() -> None:
    """Give what a finished task held back to the system: Python workers go on to
    the next task and would keep it beside the executor's own memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run):
    """A function over record batches that gives its memory back at the end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


def held_out(doc_id: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo ``modulus``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample_labels(labels: DataFrame, label: str, keep: Column | None, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids (doc_id, y), in the order of a hash of the
    id. Rows without id or label don't count; of contradicting rows for an id the
    mean decides, a tie counts as 1."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if keep is not None:
        rows = rows.filter(keep)
    one = rows.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


# -- connected components ---------------------------------------------------


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a partition by stars with the same components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the least node of the component of each node with an edge.

    ``edges`` has two long columns. Partitions are contracted to stars first,
    then large-star and small-star rounds run until nothing changes; each step
    is a table in the shared folder, deleted when the next one is there. Least
    neighbours are tables of their own, so a star's centre is a key of a plain
    join of two tables, which Spark splits when it is large. Empty input gives
    an empty result.
    """
    a, b = edges.columns
    current = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").mapInArrow(_contract, "u long, v long"), "edges")
    mark = None
    for _ in range(rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = materialize(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).filter("u <> v").distinct(), "stars")
        forget(current, least, large, low)
        current = after
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    roots = materialize(current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v"), F.col("v")).distinct()), "roots")
    forget(current)
    return roots


# -- Bloom filter sized by its keys ----------------------------------------------

#: bits for each key, and the least and the most bits (32 MB) of a filter
BLOOM_PER_KEY, BLOOM_LEAST, BLOOM_MOST = 16, 1 << 20, 1 << 28
BLOOM_CHUNK = 1 << 20  # bits of a chunk


def _bloom_places(h: np.ndarray, bits: int):
    h = h.view(np.uint64)
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _bloom_build(bits: int):
    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_bloom_places(batch.column(0).to_numpy(), bits)))
            if not len(at):
                continue
            chunk = (at // BLOOM_CHUNK).astype(np.int32)
            starts = np.flatnonzero(np.diff(chunk, prepend=-1))
            low = (at % BLOOM_CHUNK).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(chunk[starts]), pa.array([x.tobytes() for x in np.split(low, starts[1:])], pa.binary())], ["chunk", "low"])

    return run


def _bloom_merge(batches):
    total = {}
    for batch in batches:
        for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if c not in total:
                total[c] = np.zeros(BLOOM_CHUNK // 8, np.uint8)
            on = np.zeros(BLOOM_CHUNK, bool)
            on[np.frombuffer(b, "<u4")] = True
            total[c] |= np.packbits(on)
    for c, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["chunk", "bits"])


def maybe_in(hashes: DataFrame):
    """A function of a long column: false only where the value isn't among
    ``hashes`` (one long column of well-mixed hashes, read twice: to count them
    and to enter them). 16 bits for each key, 32 MB at most; a filter that is too
    full lets more pass, so an exact join must follow. It keeps texts that cannot
    match from being shuffled."""
    bits = min(max(BLOOM_LEAST, 1 << (hashes.count() * BLOOM_PER_KEY).bit_length()), BLOOM_MOST)
    rows = hashes.mapInArrow(_bloom_build(bits), "chunk int, low binary").repartition("chunk").mapInArrow(_bloom_merge, "chunk int, bits binary").toArrow()
    packed = np.zeros(bits // 8, np.uint8)
    for chunk, part in zip(rows["chunk"], rows["bits"]):
        at = chunk.as_py() * BLOOM_CHUNK // 8
        packed[at : at + BLOOM_CHUNK // 8] = np.frombuffer(part.as_buffer(), np.uint8)
    held = hashes.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        marks, out = held.value, np.ones(len(h), bool)
        for at in _bloom_places(h.to_numpy(np.int64), bits):
            out &= (marks[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return pd.Series(out)

    return test


# -- addresses of rows ------------------------------------------------------------

ADDRESS = ["__file", "__at"]


def addressed(docs: DataFrame) -> DataFrame:
    """``docs`` with the address of each row, ``__file`` and ``__at``. What isn't
    read from files that tell row numbers is written to the shared folder first."""
    where = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")]
    try:
        return docs.select("*", *where)
    except AnalysisException:
        return materialize(docs, "content").select("*", *where)


def without_rows(placed: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``addressed`` that aren't at the addresses ``gone``, without their
    address. Only rows that the filter can't clear are shuffled."""
    maybe = maybe_in(gone.select(F.xxhash64(*ADDRESS)))(F.xxhash64(*ADDRESS))
    left = placed.filter(maybe).join(gone, ADDRESS, "left_anti")
    return placed.filter(~maybe).unionByName(left).drop(*ADDRESS)
