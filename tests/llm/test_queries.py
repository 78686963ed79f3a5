"""The registered queries on small whole tables: columns, contracts, held-out rules."""

import base64
import hashlib
import os
import shutil
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_pairs import brute, exact
from tokenizers import Tokenizer

from tessera.llm import html_text, registry, tiff

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def told(spark, name, sf=SF):
    return registry.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(registry.ORACLE[name])
    cols = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want.fetchall()) if name == "op8_exact_dedup" else sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want.fetchall()))


def test_html_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = told(spark, "op1_html_extraction")
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.n_chars == len(r.text) and r.text == r.text.strip() and "\n" not in r.text
        root = html_text.parse(pages[r.page_id] or "")
        every = {" ".join(t for n in nodes for t in html_text.blocks(n)) for nodes in html_text.containers(root).values()}
        assert r.text in every or r.text == " ".join(html_text.blocks(root))


@pytest.mark.parametrize(("name", "label", "modulus", "remainder", "line"), [("op2_quality", "quality", 4, 2, 0.7), ("op3_toxicity", "toxic", 5, 0, 0.5)])
def test_classifier_queries(spark, documents, tmp_path, name, label, modulus, remainder, line):
    """Held-out rows by the rule; their labels, and columns but the text, change
    nothing; a repeated run gives the same."""
    got = told(spark, name)
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in documents)
    held = {d for d, _ in documents if zlib.crc32(str(d).encode()) % modulus == remainder}
    for r in got:
        assert r.held_out == (r.doc_id in held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= line)
    for f in os.listdir(SF):
        if f not in ("labels.parquet", "documents.parquet"):
            shutil.copy(f"{SF}/{f}", tmp_path / f)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder
    spark.read.parquet(f"{SF}/labels.parquet").withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label))).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF}/documents.parquet").withColumns({"lang": F.lit("zz"), "source": F.col("doc_id").cast("string")}).write.parquet(str(tmp_path / "documents.parquet"))
    again = {r.doc_id: r.score for r in told(spark, name, str(tmp_path))}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_packing_query(spark, documents):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in documents}
    sequences, pieces = {}, {}
    for r in told(spark, "op4_packing"):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert all(len(v) == 1 and v[0][0] == 0 and v[0][1] in [1 << i for i in range(12)] for v in sequences.values())
    for d, ids in want.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == len(ids)


def test_join_query(spark, documents):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in told(spark, "op5_ngram_join")), key=str)
    assert got == brute(documents, 4, 85)


def test_dedup_query(spark, documents):
    got = told(spark, "op8_exact_dedup")
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == exact(documents)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_byte_bpe_query(spark, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(documents)
    for r in told(spark, "op7_byte_bpe"):
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_media_query(spark, documents):
    texts = dict(documents)
    got = told(spark, "op9_media_tiff")
    assert len(got) == len(documents)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        full = data + b"\0" * (-len(data) % 64) or b"\0" * 64
        media = tiff.store(full)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(media), hashlib.sha256(media).hexdigest())


def test_queries_of_empty_and_odd_tables(spark, tmp_path):
    """Empty tables, and nulls in every column, repeated rows and a very long text."""
    tables = {f.removesuffix(".parquet"): spark.read.parquet(f"{SF}/{f}").schema for f in ("documents.parquet", "labels.parquet", "pages.parquet", "conversations.parquet")}
    for kind in ("empty", "odd"):
        for name, schema in tables.items():
            rows = []
            if kind == "odd":
                rows = [tuple(None for _ in schema)] * 2
                if name != "labels":
                    filled = {"doc_id": 1, "page_id": 1, "conv_id": 1, "turn": 0, "text": "word " * 60_000, "html": "<p>" * 50 + "word " * 60_000, "url": "http://h.example/x", "role": "user"}
                    rows += [tuple(filled.get(f.name) for f in schema)] * 2
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / kind / f"{name}.parquet"))
        for name, query in registry.QUERIES.items():
            n = query(spark, str(tmp_path / kind)).count()
            assert n == 0 if kind == "empty" else n >= (1 if name == "op10_chat_formatting" else 4), name
