"""Toxicity of documents: a logistic model over words and word beginnings with a
counterfactual penalty.

Every labelled text gets counterparts: each identity term that it names is
swapped for each other term of its group and left out; a text that names none
gets one inserted, chosen by a hash of the text. The fit penalises the squared
change of the score's log-odds from a text to its counterparts, so that naming a
group is no evidence. Terms of all groups are features of every model, whether
they seem to tell or not, so that the penalty always has something to act on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, sample_labels, strings, text_batches

#: labelled rows that a fit takes at most, in the order of a hash of the id
SAMPLE = 12_000
#: hashed features; features of which a fit keeps the most telling
SPACE, KEPT = 1 << 20, 6_000
#: terms of one row may stand for each other
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("frauen", "männer"), ("mujeres", "hombres"), ("femmes", "hommes"), ("muslime", "christen", "juden"), ("musulmanes", "cristianos", "judíos"), ("musulmans", "chrétiens", "juifs"),
)
_MARKS = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in range(256))


def words(text: str) -> set[bytes]:
    """Distinct lower-case words between ASCII marks and white space."""
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_MARKS).split())


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its beginnings of 4, 5 and 6 letters."""
    text = word.decode("utf-8", "surrogatepass")
    names = [b"w" + word] + [b"p" + text[:n].encode("utf-8", "surrogatepass") for n in (4, 5, 6) if len(text) > n]
    return [xxhash.xxh3_64_intdigest(x) & (SPACE - 1) for x in names]


def document(text: str, cache: dict[bytes, list[int]]) -> np.ndarray:
    got: set[int] = set()
    for w in words(text):
        f = cache.get(w)
        if f is None:
            if len(cache) > 200_000:
                cache.clear()
            f = cache[w] = features(w)
        got.update(f)
    return np.array(sorted(got), np.int64)


BY_TERM = {t.encode(): group for group in IDENTITY for t in group}
TERMS = sorted(BY_TERM)


def counterparts(held: set[bytes], stable: int) -> list[list[int]]:
    """Changes of features from a text with the words ``held`` to each of its
    counterparts: f for a feature that comes, -1 - f for one that goes. Features
    that another word of the text has too stay. ``stable`` chooses the term that
    a text without any gets."""
    out = []
    for t in sorted(held & BY_TERM.keys()):
        rest = {f for w in held if w != t and w[:4] == t[:4] for f in features(w)}
        gone = [-1 - f for f in features(t) if f not in rest]
        out.append(gone)
        for other in BY_TERM[t]:
            if other.encode() not in held:
                new = features(other.encode())
                kept = {-1 - f for f in gone}
                out.append([f for f in gone if -1 - f not in new] + [f for f in new if f not in rest and f not in kept])
    if not out:
        out.append(features(TERMS[stable % len(TERMS)]))
    return out


@dataclass
class Model:
    bias: float
    weight: dict[int, float]

    def telling(self, word: bytes) -> tuple[int, ...]:
        return tuple(f for f in features(word) if f in self.weight)

    def score(self, text: str, cache: dict[bytes, tuple[int, ...]]) -> float:
        hits: set[int] = set()
        for w in words(text):
            f = cache.get(w)
            if f is None:
                if len(cache) > 400_000:
                    cache.clear()
                f = cache[w] = self.telling(w)
            if f:
                hits.update(f)
        z = self.bias + sum(self.weight[f] for f in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, changes: list[list[list[int]]] | None = None, steps: int = 250, ridge: float = 1e-4, fairness: float = 0.3, chance: float = 0.8, shown: float = 0.8) -> Model:
    """Logistic model on the features that tell most, by full-batch Adam.

    A feature is kept if its share of toxic rows exceeds what one of so many
    features would reach by chance (binomial large-deviation bound), so accidents
    of long documents don't add up; whole identity terms are kept always. Weights
    are not negative: benign words never hide toxic ones. Each step shows a row's
    features with chance ``shown``, so that one of them can be enough.

    ``changes`` holds the counterparts of each row (``counterparts``). ``fairness``
    weighs the squared change of log-odds, the mean over the counterparts of a row
    and then over rows; 0 fits without the penalty."""
    n, pos = len(y), float(y.sum())
    if not n or pos in (0, n):
        mean = (pos + 0.5) / (n + 1)
        return Model(float(np.log(mean / (1 - mean))), {})
    flat = np.concatenate(rows).astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    total = np.bincount(flat, minlength=SPACE)
    toxic = np.bincount(np.concatenate([r for r, v in zip(rows, y) if v > 0]), minlength=SPACE)
    base = pos / n
    q = np.clip(toxic / np.maximum(total, 1), 1e-9, 1 - 1e-9)
    surprise = total * (q * np.log(q / base) + (1 - q) * np.log((1 - q) / (1 - base)))
    surprise[(q < max(base, 0.3)) | (surprise < np.log(max(1, (total > 0).sum())) * chance)] = 0
    kept = np.argsort(-surprise, kind="stable")[:KEPT]
    kept = np.union1d(kept[surprise[kept] > 0], [features(t)[0] for t in TERMS])
    place = np.full(SPACE, -1)
    place[kept] = np.arange(len(kept))
    use = place[flat] >= 0
    col, row = place[flat[use]].astype(np.int32), owner[use]
    del flat, owner, use
    # counterparts as a sparse matrix: pair, column, sign; a row's pairs share one weight
    pair, where, sign, weight = [], [], [], []
    for own in changes or ():
        for change in own:
            for f in change:
                if (j := place[f if f >= 0 else -1 - f]) >= 0:
                    pair.append(len(weight))
                    where.append(j)
                    sign.append(1.0 if f >= 0 else -1.0)
            weight.append(1 / (n * len(own)))
    pair, where, sign, weight = np.array(pair, int), np.array(where, int), np.array(sign), np.array(weight)
    w, b = np.zeros(len(kept)), 0.0
    balance = np.where(y > 0, 0.5 / pos, 0.5 / (n - pos))
    balance = 0.5 * balance + 0.5 / n
    balance /= balance.sum()
    m = v = np.zeros(len(kept) + 1)
    rng = np.random.default_rng(1)
    for t in range(1, steps + 1):
        on = rng.random(len(col)) < shown
        c, r = col[on], row[on]
        p = 1 / (1 + np.exp(-(b + np.bincount(r, w[c], n))))
        e = (p - y) * balance
        g = np.append(np.bincount(c, e[r], len(kept)) + ridge * w, e.sum())
        if fairness and len(pair):
            change = np.bincount(pair, w[where] * sign, len(weight))
            g[:-1] += np.bincount(where, 2 * fairness * (weight * change)[pair] * sign, len(kept))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return Model(float(b), {int(f): float(x) for f, x in zip(kept, w) if x > 1e-3})


def fit_labels(docs: DataFrame, labels: DataFrame, keep: Column | None = None, limit: int = SAMPLE, fairness: float = 0.3) -> Model:
    """Fit on at most ``limit`` labelled documents, of which only hashed features
    and those of their counterparts come to the driver. Nulls count as empty
    texts, rows without label or id don't count, repeated rows count as often as
    they occur."""
    text_batches(docs.sparkSession)
    chosen = F.broadcast(sample_labels(labels, "toxic", keep, limit))
    named = docs.select("doc_id", "text").join(chosen, "doc_id")

    def run(batches):
        cache: dict[bytes, list[int]] = {}
        for batch in batches:
            texts = strings(batch.column(0))
            got = [document(t, cache).astype(np.int32) for t in texts]
            other = [counterparts(words(t), xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), batch.column(1), pa.array(other, pa.list_(pa.list_(pa.int32())))], ["x", "y", "changes"])

    got = named.select("text", "y").mapInArrow(run, "x array<int>, y int, changes array<array<int>>").toArrow()
    y = np.array(got["y"].to_pylist(), float)
    rows = [np.array(r, np.int32) for chunk in got["x"].chunks for r in (x.values.to_numpy() for x in chunk)]
    changes = got["changes"].to_pylist()
    order = sorted(range(len(y)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes(), changes[i]))
    return fit([rows[i] for i in order], y[order], [changes[i] for i in order], fairness=fairness)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic. Null is scored as
    empty text; repeated rows get equal scores."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[bytes, tuple[int, ...]] = {}

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t if t is not None else "", cache) for t in text], dtype=float)

    return docs.withColumn(name, scored("text"))


def op3_toxicity(spark, sf_dir):
    """Every row of documents scored for toxicity by a model that learns from the
    labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out("doc_id", 5, 0)
    model = fit_labels(docs, labels, ~out)
    rows = with_score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
