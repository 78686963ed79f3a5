"""Joins and deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm.exact_dedup import deduplicate, keep_first
from tessera.llm import ngram_join
from tessera.llm.ngram_join import DivideSkip, WordHashes, keep_least, linked, ngram_components, shingles


def brute(rows, k, percent):
    sets, parent = {}, {}
    for i, (d, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 160))) for _ in range(12)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 3 + 1, (" \t\n".join(w) if i % 2 else " ".join(w).upper()) + (" " + passage if i % 5 == 0 else "")))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "one"), (None, "one"), (1, rows[0][1]), (2000, "long " * 5000)]


@pytest.mark.parametrize(("k", "percent", "block", "full"), [(4, 85, 256, False), (5, 80, 7, False), (5, 80, 40, True), (5, 80, 256, True)])
def test_components(make, monkeypatch, k, percent, block, full):
    """Also with blocks over several tasks and a sketch so full that it knows no
    single shingle and orders them at random."""
    if full:
        levels = np.random.default_rng(k).integers(1, 4, (1 << 14, 4)).astype(np.uint8)
        packed = levels[:, 0] | levels[:, 1] << 2 | levels[:, 2] << 4 | levels[:, 3] << 6
        monkeypatch.setattr(ngram_join, "frequency_levels", lambda *_: (packed, 1 << 16))
    rows = corpus(k)
    got = ngram_components(make(rows), k=k, percent=percent, block_size=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, percent)
    kept = [r.component_id for r in got if r.kept and r.n_shingles]
    assert len(kept) == len(set(kept)) and all(r.doc_id == r.component_id for r in got if r.kept)


def chain(n):
    """Documents each of which differs from the next in one of 40 words: one
    component, though the ends share nothing."""
    words = [f"c{i}" for i in range(40)]
    out = []
    for i in range(n):
        words[i * 7 % 40] = f"n{i}"
        out.append((i, " ".join(words)))
    return out


def test_components_of_large_groups(make):
    """One giant component, a block of many unlike texts that share a passage, many
    rows without id, and equal rows."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    unlike = [(10_000 + i, passage + " " + " ".join(f"u{i}x{j}" for j in range(14 + i % 3))) for i in range(150)]
    nulls = [(None, " ".join(rng.choices([f"z{j}" for j in range(500)], k=30))) for _ in range(120)]
    rows = chain(300) + unlike + nulls + nulls[:40] + [(7, "same words in all of these rows here")] * 30
    for block in (16, 256):
        got = ngram_components(make(rows).repartition(6), k=3, percent=80, block_size=block).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 80)


def test_keep_least(make):
    rows = corpus(5) + [(None, "no id " * 9 + "a b c"), (None, "no id " * 9 + "a b c")]
    out = keep_least(make(rows).repartition(3))
    parts = brute(rows, 5, 80)
    assert out.columns == ["text", "doc_id", "lang", "digest", "key"]
    heads = {c for _, n, c in parts if n and c is not None}
    left = out.collect()
    assert {r.doc_id for r in left if (r.text or "").split()} == heads | {None} and len([r for r in left if (r.text or "").split()]) == len(heads) + 1
    assert len([r for r in left if not (r.text or "").split()]) == 3


def test_gaps():
    rng = np.random.default_rng(1)
    for n, top in ((1, 10), (5000, 200_000), (3, 1 << 28), (50_000, 1 << 17)):
        places = np.sort(rng.integers(0, top, n)).astype(np.uint32)
        chunks, steps = ngram_join._gaps(places)
        assert np.concatenate([c * ngram_join.CHUNK + ngram_join._from_gaps(b) for c, b in zip(chunks.astype(np.int64), steps)]).tolist() == places.tolist()


def test_components_of_nothing(make):
    assert ngram_components(make([])).collect() == []


def test_divide_skip_finds_all():
    rng, cache = random.Random(1), WordHashes()
    sets = [shingles(t or "", 3, cache) for _, t in corpus(9)]
    sets = [s for s in sets if len(s)]
    index = DivideSkip(sets, 80)
    for s in sets:
        want = {j for j, o in enumerate(sets) if linked(len(set(s.tolist()) & set(o.tolist())), len(s), len(o), 80)}
        assert set(index.search(s)) == want


def exact(rows):
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), t in zip(rows, norm):
        ids = [x for (x, _), u in zip(rows, norm) if u == t]
        out.append((d, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(i, f"text {i % 7}\t\nx") for i in range(40)] + [(100, None), (101, ""), (102, " "), (103, "a  b"), (104, "a b"), (105, "a b"), (None, "a b"), (5, "text 5 x"), (5, "text 5 x"), (None, None), (200, "y" * 300_000), (201, "y" * 300_000)]


@pytest.mark.parametrize(("size", "batches"), [(32, 1), (32, 3), (0, 2), (1, 2)])
def test_exact_dedup(make, size, batches):
    got = deduplicate(make(ROWS).repartition(5), digest_bytes=size, batches=batches).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == exact(ROWS)
    kept = [(r.text_sha256, r.doc_id, r.keep_id) for r in got if r.kept]
    assert len(kept) == len({k[0] for k in kept}) == len({r.text_sha256 for r in got})
    assert all(d == k for _, d, k in kept)


@pytest.mark.parametrize("size", [32, 1])
def test_exact_dedup_goes_on_from_its_state(spark, make, tmp_path, size):
    """Two calls with one state: the second meets the first's rows and compares
    with their texts, and a call repeated under its label isn't counted twice."""
    parts = ROWS[::2], ROWS[1::2]
    for i, part in enumerate(parts):
        make(part).repartition(3).write.parquet(f"{tmp_path}/in {i}")
    read = lambda i: spark.read.parquet(f"{tmp_path}/in {i}")
    state = f"file://{tmp_path}/state"
    one = deduplicate(read(0), state, "one", size).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in one), key=str) == exact(parts[0])
    for _ in range(2):  # as after a restart
        two = deduplicate(read(1), state, "two", size).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in two), key=str) == exact_of(parts[1], ROWS)
    import os

    assert len(os.listdir(f"{tmp_path}/state/rows")) == 2 and len(os.listdir(f"{tmp_path}/state/told")) >= 4


def exact_of(part, rows):
    """The results for ``part`` among ``rows``."""
    by = {(x[0], x[3]): x for x in exact(rows)}
    return sorted((by[d, hashlib.sha256(re.sub("[ \t-\r]+", " ", t or "").encode()).hexdigest()] for d, t in part), key=str)


def test_keep_first(make):
    out = keep_first(make(ROWS).repartition(3))
    left = out.collect()
    assert out.columns == ["text", "doc_id", "lang", "digest", "key"]
    texts = {re.sub("[ \t-\r]+", " ", t or "") for _, t in ROWS}
    assert len(left) == len(texts) and {re.sub("[ \t-\r]+", " ", r.text or "") for r in left} == texts
    assert {r.doc_id for r in left} == {k for _, k, _, _ in exact(ROWS)}
    assert keep_first(make([])).collect() == []


def test_exact_dedup_of_nothing(make):
    assert deduplicate(make([])).collect() == []
