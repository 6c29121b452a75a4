"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of its pairs of next
words and of its pairs with one word between, each taken once. FTRL-proximal
keeps a learning rate per coordinate, and its L1 term leaves most weights at
exactly zero, so the fitted model is a short list of (hash, weight) that every
task holds. The fit reads a bounded sample of labelled rows (`per_class` of each
label, those of the least hash of their doc_id); scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_words

#: Bits of a feature hash: so many that features of the longest texts don't meet by chance.
BITS = 62
#: Words of a text that are looked at together; pairs across the borders are kept.
CHUNK = 1 << 16


class _Hashes(dict):
    """32-bit hashes of the words met lately."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[w] = h = zlib.crc32(w)
        return h


_SEEN = _Hashes()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature hashes, of BITS bits; none for a null or empty text."""
    words = lower_words(text)
    found = [np.zeros(0, np.uint64)]
    for at in range(0, len(words), CHUNK):
        h = np.array([_SEEN[w] for w in words[at : at + CHUNK + 2]], np.uint64)
        own = min(CHUNK, len(h))
        mix = h * np.uint64(0x9E3779B97F4A7C15)
        parts = [mix[:own]]
        for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            n = min(own, len(h) - gap)
            if n > 0:
                parts.append((mix[:n] ^ (h[gap : gap + n] + np.uint64(gap)) * np.uint64(odd)) * np.uint64(0x9E3779B97F4A7C15))
        found.append(np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)))
    return np.unique(np.concatenate(found)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights, and the bias."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> float:
        if not len(self.ids) or not len(x):
            return self.bias
        at = np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1)
        return self.bias + float(self.weights[at][self.ids[at] == x].sum())

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40))))


def fit(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 1.0, l2: float = 0.5, epochs: int = 5) -> Model:
    """FTRL-proximal over the rows, `epochs` times in seeded orders. Without rows: the score is 0.5 less a hair."""
    names, place = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_inverse=True)
    rows = np.split(place, np.cumsum([len(x) for x in rows])[:-1]) if rows else []
    z, g2 = np.zeros(len(names)), np.zeros(len(names))
    zb = gb = 0.0
    order = np.random.default_rng(7)
    bias = lambda: -zb / ((beta + np.sqrt(gb)) / alpha + l2)  # noqa: E731  without L1

    def weights(x: np.ndarray) -> np.ndarray:
        zx = z[x]
        return np.where(np.abs(zx) <= l1, 0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(g2[x])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            w, b = weights(x), bias()
            p = 1 / (1 + np.exp(-np.clip(b + w.sum(), -40, 40)))
            g = float(p - y[i])
            # Long texts share one step among their features.
            gx = g / np.sqrt(max(1.0, len(x) / 256))
            s = (np.sqrt(g2[x] + gx * gx) - np.sqrt(g2[x])) / alpha
            z[x] += gx - s * w
            g2[x] += gx * gx
            sb = (np.sqrt(gb + g * g) - np.sqrt(gb)) / alpha
            zb += g - sb * b
            gb += g * g
    kept = np.flatnonzero(np.abs(z) > l1)
    return Model(names[kept], weights(kept), float(bias()) if len(rows) else -1e-6)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """y, x: labelled rows outside the held-out fifth, `per_class` doc_ids of each label at most.

    The doc_ids are chosen among the labels alone; the texts of so few are found without a shuffle.
    """
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    parts = [y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # At most 2 * per_class rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [features(t).tobytes() for t in b["text"]]})

    return rows.select("y", "text").mapInPandas(each, "y int, x binary")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model:
    """Fit on at most 2 * `per_class` rows, in one task; only the weights reach the driver.

    Features that only one of these rows has teach nothing about others; a table of small counters
    finds most of them, and they are left out before the fit. Labels that repeat a doc_id count once,
    by their greatest value; without labels the model is the bias alone.
    """

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows, y = np.zeros(1 << 24, np.uint8), [], []
        low = len(seen) - 1
        for b in batches:
            for x, k in zip(b["x"], b["y"], strict=True):
                x = np.frombuffer(x, np.int64)
                at = x & low
                seen[at] = np.minimum(seen[at], 1) + 1
                rows.append(x)
                y.append(k)
        rows = [x[seen[x & low] > 1] for x in rows]
        order = sorted(range(len(rows)), key=lambda i: (zlib.crc32(rows[i].tobytes()), len(rows[i]), y[i]))
        m = fit([rows[i] for i in order], np.array([y[i] for i in order], float))
        yield pd.DataFrame({"ids": [m.ids.tobytes()], "weights": [m.weights.tobytes()], "bias": [m.bias]})

    # The rows are bounded by `per_class`, so one task holds them.
    r = training_rows(docs, labels, per_class).repartition(1).mapInPandas(fitted, "ids binary, weights binary, bias double").first()
    if r is None:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["weights"], float), r["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row: null and empty texts get the bias alone.

    A null doc_id isn't held out. Repeated rows get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            s = np.array([m.score(features(t)) for t in b["text"]], float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInPandas(each, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, with all their columns, that the model doesn't reject (score under 0.5).

    Each row is judged by its text alone: null and empty texts get the bias, repeated rows and null doc_ids are rows
    like any other, and an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(features(t)) for t in text], dtype=float)

    return docs.where(scored(F.col("text")) < 0.5)
