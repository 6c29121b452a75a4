"""Cross-entropy difference of matched target and background n-gram models.

Both models are bigram models over one vocabulary, all words of all texts, with the same
smoothing (Dirichlet towards the unigrams of the same corpus) and the same weight of
evidence: the background's counts are scaled to the target's number of tokens. A
document's score is its mean loss a token under the target model less that under the
background model, so the most target-like documents score lowest. A document's own words
count in the model of its side, as in the corpus that is to be selected from.

Every word and every pair of next words is counted; what is gathered grows with the corpus.
Texts are put into chunks of some millions of words. A chunk counts its different words and
pairs, sends these counts to buckets by their hash (one entry a chunk and pair, however
often it stands there), and gets back the sums over all chunks in the same order. The chunk
then adds up the losses of its texts. No model is held anywhere as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, lower_words, mixed, new_path, partitions, word_hashes

#: Pseudo-counts of the unigrams in each bigram context.
KAPPA = 20.0
#: Words of a chunk, and characters of text for a bucket.
CHUNK, BUCKET = 2_000_000, 16_000_000
#: Bits of a key that aren't sent: 40 and the bucket tell keys apart, of which a bucket has a few millions.
DROPPED = 24
#: The hash of the word before the first.
OPENING = np.uint64(0)


def _packed(x: np.ndarray) -> bytes:
    """Bytes of equal places side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 3)


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    plain = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(plain.reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


@dataclass
class Grams:
    """The different words and pairs of some texts: 63-bit hashes with the highest bit set for words, bucket by bucket."""

    keys: np.ndarray
    #: Where each bucket begins.
    cuts: np.ndarray
    #: Of each token, the place in `keys` of its pair, of the word before it and of itself.
    pair: np.ndarray
    before: np.ndarray
    word: np.ndarray
    opening: int

    @classmethod
    def of(cls, hashes: np.ndarray, codes: np.ndarray, n: np.ndarray, buckets: int) -> Grams:
        """Of texts of n words each, given as places in `hashes`."""
        marked = lambda h, k, bit: (mixed(h, k) >> np.uint64(1)) | np.uint64(bit << 63)
        plain = np.concatenate([[OPENING], hashes])
        first = np.cumsum(n) - n
        b = codes.astype(np.int64) + 1
        a = np.concatenate([[0], b[:-1]]) if len(b) else b
        a[first[n > 0]] = 0
        pairs, inverse = np.unique(marked(mixed(plain[a]) + plain[b], 0, 0), return_inverse=True)
        keys = np.concatenate([pairs, marked(plain, 1, 1)])
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((keys, bucket))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        of_word = rank[len(pairs) :]
        return cls(keys[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), rank[inverse], of_word[a], of_word[b], int(of_word[0]))

    def counts(self, weight: np.ndarray, texts: int) -> np.ndarray:
        """How often each key stands in the texts, given each token's weight (0 or 1) and the number of openings."""
        n = np.bincount(self.pair, weight, len(self.keys)) + np.bincount(self.word, weight, len(self.keys))
        n[self.opening] += texts
        return n.astype(np.int64)


TEXTS = "chunk long, bucket int, doc_ids array<long>, n array<int>, x binary, y binary, z binary"


def _chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds: a chunk's texts (bucket -1: x the words' hashes, y their places) and its counts in a bucket (x keys, y and z counts)."""

    def chunk(number: int, ids: list, roles: list[int], texts: list[list[bytes]]) -> pd.DataFrame:
        n = np.array([len(t) for t in texts], np.int64)
        place: dict[bytes, int] = {}
        codes = np.fromiter((place.setdefault(w, len(place)) for t in texts for w in t), np.int32, int(n.sum()))
        hashes = word_hashes(list(place))
        g, role = Grams.of(hashes, codes, n, buckets), np.array(roles)
        t, o = (g.counts(np.repeat(role == k, n).astype(float), int(((role == k) & (n > 0)).sum())) for k in (0, 1))
        rows = [(number, -1, ids, n.tolist(), _packed(hashes), _packed(codes), b"")]
        for k, (lo, hi) in enumerate(zip(g.cuts, g.cuts[1:], strict=False)):
            if lo < hi:
                rows.append((number, k, None, None, _packed(g.keys[lo:hi] >> np.uint64(DROPPED)), _packed(t[lo:hi]), _packed(o[lo:hi])))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "doc_ids", "n", "x", "y", "z"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        ids, roles, texts, n = [], [], [], 0
        for b in batches:
            for d, r, t in zip(b["doc_id"], b["role"], b["text"], strict=True):
                ids.append(None if pd.isna(d) else int(d))
                roles.append(r)
                texts.append(lower_words(t))
                n += len(texts[-1])
                if n >= CHUNK:
                    yield chunk(number, ids, roles, texts)
                    number += 1
                    ids, roles, texts, n = [], [], [], 0
        if ids:
            yield chunk(number, ids, roles, texts)

    return docs.select("doc_id", "role", "text").mapInPandas(each, TEXTS)


def _sums(key, g: pd.DataFrame) -> pd.DataFrame:
    """The counts of a bucket's keys over all chunks, for each chunk in its order; and of all its words (chunk null)."""
    keys = [_unpacked(x, np.uint64) for x in g["x"]]
    at = np.cumsum([0] + [len(k) for k in keys])
    names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(inverse, np.concatenate([_unpacked(x, np.int64) for x in g[c]]), len(names)).astype(np.int64) for c in ("y", "z")]
    rows = [(int(c), int(key[0]), *(_packed(s[inverse[lo:hi]]) for s in sums), None, None, None) for c, lo, hi in zip(g["chunk"], at, at[1:], strict=False)]
    own = (names >> np.uint64(63 - DROPPED) > 0) & (sums[0] + sums[1] > 0)
    rows.append((None, int(key[0]), None, None, int(sums[0][own].sum()), int(sums[1][own].sum()), int(own.sum())))
    out = pd.DataFrame(rows, columns=["chunk", "bucket", "y", "z", "t", "g", "words"])
    return out.astype({"chunk": "Int64", "t": "Int64", "g": "Int64", "words": "Int64"})


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _losses(buckets: int, t: int, g: int, size: int):
    """Scores of a chunk's texts from the counts of its keys; t, g: tokens and openings of both models; size: words of the vocabulary."""

    def each(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("bucket")
        out = [texts.iloc[:0].assign(doc_id=[], n_tokens=[], target_loss=[], background_loss=[], score=[])[SCORED]]
        for r in texts.itertuples():
            n = np.array(r.n, np.int64)
            grams = Grams.of(_unpacked(r.x, np.uint64), _unpacked(r.y, np.int32), n, buckets)
            text, means = np.repeat(np.arange(len(n)), n), []
            for column, scale, total in (("y", 1.0, t), ("z", t / max(1, g), g)):
                c = scale * np.concatenate([_unpacked(x, np.int64) for x in counts[column]])
                p = (c[grams.word] + 1) / (scale * total + size)
                loss = -np.log((c[grams.pair] + KAPPA * p) / (c[grams.before] + KAPPA))
                sums = np.bincount(text, loss, len(n))
                means.append(np.divide(sums, n, out=np.full(len(n), np.nan), where=n > 0))
            mean = lambda x: pd.Series(x, dtype=object).where(n > 0, None)
            ids = pd.array([None if pd.isna(d) else int(d) for d in r.doc_ids], "Int64")
            out.append(pd.DataFrame({"doc_id": ids, "n_tokens": n, "target_loss": mean(means[0]), "background_loss": mean(means[1]), "score": mean(means[0] - means[1])}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    return each


SCORED = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]


def _with_roles(docs: DataFrame, target_ids: DataFrame, others: DataFrame | None) -> DataFrame:
    """doc_id, text, role: 0 for the target, 1 for the background, 2 for texts that are only scored.

    The target's ids grow with the corpus, so they are merged with it; rows with a null doc_id aren't, as they'd meet in one task.
    """
    flags = target_ids.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("role", F.lit(0))
    rows = docs.select("doc_id", "text")
    named = rows.where("doc_id IS NOT NULL").join(flags.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("role", F.lit(1)).alias("role"))
    out = named.unionByName(rows.where("doc_id IS NULL").withColumn("role", F.lit(1)))
    return out if others is None else out.unionByName(others.select("doc_id", "text", F.lit(2).alias("role")))


def score(docs: DataFrame, target_ids: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (their difference; all a token) of each row.

    The target are the rows whose doc_id is in `target_ids` (doc_id), the background all other rows, those with a
    null doc_id too; rows of `others` (doc_id, text) are scored without being counted. Repeated rows count each time.
    A text without words (null and empty ones too) has 0 tokens and null losses and score.
    Without target documents both models are uniform and scores are 0. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    size = docs.select(F.length("text").alias("n")).agg(F.sum("n")).first()[0] or 0
    # So many that a bucket's keys fit in a task.
    buckets = max(partitions(spark), min(1 << 17, -(-size // BUCKET)))
    path = new_path(spark, "grams")
    kinds = _chunks(_with_roles(docs, target_ids, others), buckets).withColumn("kind", F.when(F.col("bucket") < 0, "texts").otherwise("counts"))
    kinds.write.option("compression", "none").partitionBy("kind").parquet(path)
    del kinds  # its shuffle can be cleaned up
    read = lambda kind: spark.read.schema(TEXTS + ", kind string").parquet(path).where(F.col("kind") == kind)
    each = "chunk long, bucket int, y binary, z binary, t long, g long, words long"
    sums_at = new_path(spark, "gram-sums")
    read("counts").groupBy("bucket").applyInPandas(_sums, each).write.option("compression", "none").parquet(sums_at)
    drop_path(spark, f"{path}/kind=counts")
    sums = spark.read.schema(each).parquet(sums_at)
    r = sums.where("chunk IS NULL").agg(F.sum("t"), F.sum("g"), F.sum("words")).first()
    back = sums.where("chunk IS NOT NULL").select("chunk", "bucket", "y", "z")
    texts = read("texts").select("chunk", "doc_ids", "n", "x", "y")
    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(_losses(buckets, r[0] or 0, r[1] or 0, (r[2] or 0) + 1), SCORES)
