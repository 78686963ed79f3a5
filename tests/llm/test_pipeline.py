"""Each pipeline stage on its own input, and all in a row."""

import re

import corpus_pipeline as p
from test_pairs import brute, exact

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, left = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        left[name] = [r.doc_id for r in out.collect()]
        assert len(left[name]) == len(set(left[name]))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert set(left["exact_dedup"]) == {d for d, keep, _, _ in exact(rows) if d == keep}
    assert set(left["ngram_join"]) == {d for d, _, c in brute(rows, 5, 80) if c == d}
    assert 0 < len(left["quality"]) < len(rows) and 0 < len(left["toxicity"]) <= len(rows)
    assert p.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == len(rows)


def test_run(spark):
    """The stages in a row: what is packed are the rows that each stage by itself
    leaves of what the one before left, whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:2]:
        docs = stage(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    first = {d for d, keep, _, _ in exact(rows) if d == keep}
    rows = [(d, t) for d, t in rows if d in first]
    want = {d for d, _, c in brute(rows, 5, 80) if c == d}
    packed = p.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == want
    for d in sorted(want)[:50]:
        parts = sorted((r.start, r.length, r.doc_tokens) for r in packed if r.doc_id == d)
        assert sum(n for _, n, _ in parts) == parts[0][2] and parts[0][0] == 0


def test_stages_of_odd_rows(spark):
    """Nulls, repeated rows and empty tables pass each stage."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [{"doc_id": i, "text": t} for i, t in [(None, None), (1, None), (1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "x" * 100_000)]]
    rows = [tuple(r.get(f.name) for f in schema) for r in odd]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in p.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert name == "packing" or n <= docs.count()
            if name == "exact_dedup" and docs.count():
                assert n == len({re.sub("[ \\t-\\r]+", " ", t["text"] or "") for t in odd})
