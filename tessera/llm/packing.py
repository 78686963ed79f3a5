"""Power-of-two packing: each document is cut into pieces whose lengths are the
binary digits of its token count, so every sequence holds one piece of one
document, has a length that is a power of two, and needs no padding."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import releasing, strings, text_batches

END = 1
MAX_LENGTH = 2048
WORD_END = "\0"


@lru_cache(2)
def load(path: str) -> tuple[Tokenizer, tiktoken.Encoding, np.ndarray, regex.Pattern, list[str]]:
    """A word-end BPE file of the tokenizers library: the library's tokenizer, the
    same merges for tiktoken, the id of each of its ranks, the pattern of words,
    and the file's added tokens, which the library finds anywhere in a text.

    WORD_END stands for the word end in tiktoken; the symbols that end a word are
    the first merges, byte and WORD_END."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, suffix = file["model"], file["model"]["end_of_word_suffix"]
    kinds = [x["type"] for x in file["normalizer"]["normalizers"]], [x["type"] for x in file["pre_tokenizer"]["pretokenizers"]]
    if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or not suffix or model["type"] != "BPE":
        raise ValueError("not a lower-casing byte-level BPE with word ends")
    added = [x["content"] for x in file["added_tokens"]]
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in file["added_tokens"]) or any(len(x.split()) != 1 for x in added):
        raise ValueError("an added token takes white space")
    # printable bytes stand for themselves, the others for characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict(zip(plain, map(chr, plain))) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    end = WORD_END.encode()
    spelling = {shown[b]: bytes([b]) for b in range(256)} | {shown[b] + suffix: bytes([b]) + end for b in range(256)}
    names = [shown[b] for b in range(256)] + [shown[b] + suffix for b in range(256)]
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        spelling[a + b] = spelling[a] + spelling[b]
        names.append(a + b)
    ranks = {spelling[n]: i for i, n in enumerate(names) if shown[0] not in n}
    ranks[end] = 0
    engine = tiktoken.Encoding("word-ends", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={})
    ids = np.array([model["vocab"][n] for n in names], "<u4")
    return Tokenizer.from_file(path), engine, ids, regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), added


class Recent(dict):
    """A cache of two generations: what was met since the last full one stays."""

    LIMIT = 150_000

    def __init__(self):
        self.older: dict = {}

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.older = {}


class WordIds(Recent):
    """Ids of a word of the pattern, lower-case, by tiktoken."""

    def __init__(self, engine: tiktoken.Encoding, ids: np.ndarray):
        super().__init__()
        self.encode, self.ids = engine.encode_ordinary, [x.tobytes() for x in ids]

    def make(self, word: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.encode(word + WORD_END)))


class ChunkIds(Recent):
    """Ids of each run of bytes between ASCII white space, as little-endian
    unsigned 32-bit bytes. The tokenizer drops white space, and no match of its
    pattern and no added token spans any, so a text's ids are those of its runs,
    one after another.

    The library gives the ids. Runs of printable ASCII and Latin letters up to
    U+024F without added tokens take the same merges by tiktoken, word by word,
    which is faster; tests compare both on all their characters."""

    PLAIN = regex.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]+")

    def __init__(self, path: str):
        super().__init__()
        self.library, engine, ids, self.pattern, self.added = load(path)
        self.words = WordIds(engine, ids)

    def forget(self) -> None:
        super().forget()
        self.words.forget()

    def make(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters
            return self.words[chunk.lower().decode()]
        text = chunk.decode("utf-8", "replace")
        if not self.PLAIN.fullmatch(text) or "<" in text and any(x in text for x in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.pattern.findall(text.lower())
        return b"".join(map(self.words.__getitem__, words))


def token_bytes(texts: list[str], known: ChunkIds) -> Iterator[bytes]:
    """The ids of each text and END, as bytes."""
    end = np.array([END], "<u4").tobytes()
    for t in texts:
        yield b"".join(map(known.__getitem__, t.encode("utf-8", "replace").split())) + end


def pieces(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, longest first: as often
    ``max_length`` as it fits, then the set bits of the rest."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, bucket int"


def _pack(path: str, max_length: int, with_ids: bool):
    def run(batches):
        known = ChunkIds(path)
        names = [x.strip().split()[0] for x in SCHEMA.split(",")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            cols: list[list] = [[] for _ in names]
            for doc, data in zip(ids, token_bytes(texts, known)):
                n, at = len(data) // 4, 0
                for length in pieces(n, max_length):
                    part = data[4 * at : 4 * (at + length)]
                    for c, v in zip(cols, (doc, at, length, part if with_ids else None, zlib.crc32(part), n, length.bit_length() - 1)):
                        c.append(v)
                    at += length
                if len(cols[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                    cols = [[] for _ in names]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        known.forget()

    return releasing(run)


def pack_pow2(docs: DataFrame, tokenizer: str | None = None, max_length: int = MAX_LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), ids_crc32, doc_tokens, bucket (binary logarithm of the length),
    sequence_id, offset.

    Each sequence is one piece, so equal buckets hold equal lengths and batch
    without padding; ``write_buckets`` stores them so. Null and empty texts give
    one piece, the end id. Repeated rows are packed as often as they occur. Other
    columns are ignored. Nothing is shuffled. ``max_length`` is a power of two.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    text_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(path, max_length, with_ids), SCHEMA)
    return rows.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store sequences by length: one folder per power of two."""
    packed.write.partitionBy("bucket").parquet(path)


def op4_packing(spark, sf_dir):
    """Every row of documents cut into pieces of powers of two, a sequence each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_pow2(docs, with_ids=False).drop("ids")
