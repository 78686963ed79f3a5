"""Quality of documents: histogram gradient-boosted trees over statistics of the
text. Fitted trees are flattened into arrays and walked for whole batches."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, sample_labels, strings, text_batches

#: labelled rows that a fit takes at most, in the order of a hash of the id
SAMPLE = 20_000
FEATURES = ("log_bytes", "log_words", "word_length", "distinct", "repeats", "line_repeats", "line_words", "upper", "digit", "symbol", "punctuation", "space", "high", "double_marks", "mark_words", "ends_sentence", "top_word", "distinct_by_root")
DOUBLE_MARKS = (b"!!", b"??", b"**", b"==", b"--")
_UPPER, _DIGIT, _PUNCT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_PUNCT[list(b".,;:!?'\"()-")] = True
_SYMBOL[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; all 0 for an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = set(words)
    tail = words[-1][-1:]
    sample: dict[bytes, int] = {}
    for x in words:
        sample[x] = sample.get(x, 0) + 1
    return [
        np.log1p(n), np.log1p(w), n / w, len(distinct) / w, sum(a == b for a, b in pairwise(words)) / w,
        1 - len(set(lines)) / len(lines), np.log1p(w / len(lines)), counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n,
        counts[_SYMBOL].sum() / n, counts[_PUNCT].sum() / n, (counts[32] + counts[9]) / n, counts[128:].sum() / n,
        sum(map(data.count, DOUBLE_MARKS)) / w, sum(k for x, k in sample.items() if len(x) == 1 and not x.isalnum()) / w, float(tail in b".!?"), max(sample.values()) / w, len(distinct) / np.sqrt(w),
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, leaf: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boost trees of logistic loss; splits come from histograms of ``bins``
    quantile bins. Without rows of both classes: a constant."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        f = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            roots.append(len(nodes))
            nodes.append([0, 0.0, roots[-1], roots[-1], 0.0])
            level = [(roots[-1], np.arange(len(y)))]
            for d in range(depth + 1):
                below = []
                for number, rows in level:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    best = (1e-6, None)
                    for j in range(x.shape[1]) if d < depth and len(edges) else ():
                        k = len(edges[j]) + 1
                        b = binned[rows, j]
                        gl, hl = np.cumsum(np.bincount(b, g[rows], k))[:-1], np.cumsum(np.bincount(b, h[rows], k))[:-1]
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(hl < leaf) | (hs - hl < leaf)] = -1
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), (j, int(gain.argmax())))
                    if best[1] is None:
                        nodes[number][4] = rate * gs / (hs + ridge)
                        f[rows] += nodes[number][4]
                        continue
                    j, cut = best[1]
                    a, b = len(nodes), len(nodes) + 1
                    nodes += [[0, 0.0, a, a, 0.0], [0, 0.0, b, b, 0.0]]
                    nodes[number][:4] = [j, float(edges[j][cut]), a, b]
                    low = binned[rows, j] <= cut
                    below += [(a, rows[low]), (b, rows[~low])]
                level = below
    columns = list(zip(*nodes)) or [()] * 5
    return Trees(base, np.array(roots, int), *(np.array(c, t) for c, t in zip(columns, (int, float, int, int, float))), depth)


def fit_labels(docs: DataFrame, labels: DataFrame, keep: Column | None = None, limit: int = SAMPLE) -> Trees:
    """Fit on at most ``limit`` labelled documents."""
    text_batches(docs.sparkSession)
    chosen = F.broadcast(sample_labels(labels, "quality", keep, limit))
    named = docs.select("doc_id", "text").join(chosen, "doc_id")

    def run(batches):
        for batch in batches:
            got = matrix(strings(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = named.select("text", "y").mapInArrow(run, "x array<double>, y int").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows["y"].to_pylist(), float)
    order = np.lexsort((y, *x.T))  # the same model from any order of rows
    return fit(x[order], y[order])


def with_score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is good. Null is scored as
    empty text; repeated rows get equal scores."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(matrix([t if t is not None else "" for t in text])))

    return docs.withColumn(name, scored("text"))


def op2_quality(spark, sf_dir):
    """Every row of documents scored for quality by a model that learns from the
    labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out("doc_id", 4, 2)
    model = fit_labels(docs, labels, ~out)
    rows = with_score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
