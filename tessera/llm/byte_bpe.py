"""Byte-level BPE encoding with the lazily determinised transducer, and streaming
decode with an incremental UTF-8 state machine."""

from __future__ import annotations

import base64
import gc
import hashlib
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import strings, text_batches
from tessera.llm.transducer import Transducer


def merge(data: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain rank-order merging; with ``below``, only merges of lower rank."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank >= (1 << 60 if below is None else below):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def compile_ranks(ranks: dict[bytes, int]) -> Transducer:
    """The transducer of a rank file; its token numbers are the ranks."""
    if sorted(ranks.values()) != list(range(len(ranks))) or sorted(ranks[bytes([b])] for b in range(256)) != list(range(256)):
        raise ValueError("ranks must be 0, 1, ... with the single bytes first")
    merges = []
    for word, rank in sorted(ranks.items(), key=lambda x: x[1])[256:]:
        parts = merge(word, ranks, rank)
        if len(parts) != 2:
            raise ValueError(f"token {rank} is not made by merges")
        merges.append((ranks[parts[0]], ranks[parts[1]]))
    return Transducer(256, merges)


class Words(dict):
    """Encoding of each word met lately: ids as text, ids. Two generations: words
    met since the last full one stay."""

    LIMIT = 250_000

    def __init__(self, machine: Transducer, symbols: list[int]):
        self.machine, self.older = machine, {}
        #: bytes to symbols; the symbols of a rank file are the bytes in some order
        self.table = bytes(symbols)
        self.names = list(map(str, range(len(machine.halves))))

    def __missing__(self, word: str):
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            ids = self.machine.encode(word.encode("utf-8", "surrogatepass").translate(self.table))
            out = ",".join(map(self.names.__getitem__, ids)), tuple(ids)
        self[word] = out
        return out


class Utf8Decoder:
    """Incremental UTF-8: tokens in, text out as soon as characters are whole."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.whole = _whole(tokens)
        self.reset()

    def reset(self) -> None:
        self.state, self.held = 0, b""

    #: states: 0 between characters; 1-3 so many bytes to come; 4-7 the second
    #: byte is restricted (after E0, ED, F0, F4); -1 not UTF-8
    @staticmethod
    def step(state: int, data: bytes) -> tuple[int, int]:
        """State after ``data``, and how many bytes of it end whole characters."""
        done = 0
        for i, b in enumerate(data):
            if state == 0:
                state = 0 if b < 0x80 else -1 if b < 0xC2 else 1 if b < 0xE0 else 4 if b == 0xE0 else 5 if b == 0xED else 2 if b < 0xF0 else 6 if b == 0xF0 else 3 if b < 0xF4 else 7 if b == 0xF4 else -1
            elif state > 0:
                low, high = {4: (0xA0, 0xBF), 5: (0x80, 0x9F), 6: (0x90, 0xBF), 7: (0x80, 0x8F)}.get(state, (0x80, 0xBF))
                state = (state - 1 if state < 4 else 1 if state < 6 else 2) if low <= b <= high else -1
            if state < 0:
                raise UnicodeDecodeError("utf-8", data, i, i + 1, "invalid byte")
            if state == 0:
                done = i + 1
        return state, done

    def feed(self, token: int) -> bytes:
        """Whole characters, as UTF-8, that ``token`` completes."""
        data = self.tokens[token]
        if self.state == 0 and self.whole.get(token):
            return data
        data, old = self.held + data, self.held
        self.state, done = self.step(self.state, data[len(old) :])
        cut = len(old) + done if done else 0
        self.held = data[cut:]
        return data[:cut]

    def finish(self) -> None:
        if self.state:
            raise ValueError("the text ends within a character")

    def decode(self, ids: list[int]) -> bytes:
        self.reset()
        if all(map(self.whole.__getitem__, ids)):
            return b"".join(map(self.tokens.__getitem__, ids))
        out = b"".join(map(self.feed, ids))
        self.finish()
        return out


def _whole(tokens):
    out = {}
    for i, b in tokens.items():
        try:
            out[i] = Utf8Decoder.step(0, b)[0] == 0
        except UnicodeDecodeError:
            out[i] = False
    return out


@lru_cache(2)
def machine(path: str) -> tuple[Words, Utf8Decoder]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    out = Words(compile_ranks(ranks), [ranks[bytes([b])] for b in range(256)]), Utf8Decoder({i: b for b, i in ranks.items()})
    gc.freeze()  # the tables stay; don't walk them at each collection
    return out


SCHEMA = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _run(path: str, pattern: str, with_ids: bool):
    def run(batches):
        words, decoder = machine(path)
        find = regex.compile(pattern).findall
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            for at in range(0, len(texts), 500):
                part = texts[at : at + 500]
                n, ids_sha, text_sha, kept = [], [], [], []
                for text in part:
                    names, parts = zip(*map(words.__getitem__, find(text))) if text else ((), ())
                    ids = list(chain.from_iterable(parts))
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
                    kept.append(ids if with_ids else None)
                yield pa.RecordBatch.from_arrays([pa.array(docs[at : at + 500], pa.int64()), pa.array(kept, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``.

    Null and empty texts have no ids. Every character of a text is matched by the
    pattern, so decoding gives the text back. Repeated rows give repeated rows,
    an empty table an empty one; other columns are ignored. Nothing is shuffled.
    """
    text_batches(docs.sparkSession)
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_run(path, pattern, with_ids), SCHEMA)


def op7_byte_bpe(spark, sf_dir):
    """Every whole text of documents, encoded and decoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, with_ids=False).drop("ids")
