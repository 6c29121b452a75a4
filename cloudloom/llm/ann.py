"""Nearest neighbours by inner product over an inverted multi-index.

Each vector is cut into two halves, and each half is quantised by its own k-means
(fitted on a bounded sample): a cell is a pair of centroids. A query takes cells in
ascending order of its summed distances to the two centroids, by a heap over pairs
of sorted lists, until they hold a share of all vectors; every vector of these cells
is reranked by its exact inner product. The share is that at which the fit's sample
finds `recall` of its true neighbours: small for data with clusters, over half for
vectors without any, as no quantiser orders these well.

Equal vectors are folded into one entry with their smallest ids: more of them than
neighbours are asked for can't be in any answer. Small cells are put together on
shelves of about BLOCK entries, and a larger cell is cut into several; queries of a
shelf are cut into blocks too. A group returns only the best of each of its queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

#: Rows that the codebooks are fitted on at most, and of these the queries that the share is set by.
FIT_ROWS, TRIED = 20_000, 100
BLOCK = 4096


def valid(vector: Column) -> Column:
    """Neither null nor zero nor empty, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows of x; k-means++ start with a fixed seed."""
    rng = np.random.default_rng(5)
    k = min(k, len(np.unique(x, axis=0)))
    c = x[[rng.integers(len(x))]]
    far = ((x - c[0]) ** 2).sum(1)
    while len(c) < k:
        p = far / far.sum() if far.sum() > 0 else None
        c = np.vstack([c, x[rng.choice(len(x), p=p)]])
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all centroids."""
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.first.shape[1]
        return distances(x[:, :d], self.first), distances(x[:, d:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def traverse(self, a: np.ndarray, b: np.ndarray, sizes: dict[int, int], want: int) -> list[int]:
        """Cells that aren't empty, by ascending a[i] + b[j], until they hold `want` vectors."""
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, pushed, out, got = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}, [], 0
        while heap and got < want:
            _, i, j = heapq.heappop(heap)
            cell = int(oa[i]) * len(self.second) + int(ob[j])
            if cell in sizes:
                out.append(cell)
                got += sizes[cell]
            for s, t in ((i + 1, j), (i, j + 1)):
                if s < len(oa) and t < len(ob) and (s, t) not in pushed:
                    pushed.add((s, t))
                    heapq.heappush(heap, (a[oa[s]] + b[ob[t]], s, t))
        return out


def fit(vectors: DataFrame, rows: int, keep: int, recall: float) -> tuple[Codebooks, float]:
    """Codebooks of 16 centroids a half (more where cells would hold over 1,000 vectors, 1,024 at most), and the share."""
    k = 16
    while k < 1024 and rows / (k * k) > 1000:
        k *= 2
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toPandas()
    x = np.array(sample["v"].to_list(), float)
    d = x.shape[1] // 2
    books = Codebooks(kmeans(x[:, :d], k) if d else np.zeros((1, 0)), kmeans(x[:, d:], k))
    return books, needed_share(books, x, keep, recall)


def needed_share(books: Codebooks, x: np.ndarray, keep: int, recall: float) -> float:
    """The share of the sample that queries must take for `recall` of their true neighbours in it."""
    cells = books.cells(x)
    counts = np.bincount(cells, minlength=len(books.first) * len(books.second))
    a, b = books.halves(x[:TRIED])
    mass = []
    for i in range(len(a)):
        order = np.argsort((a[i][:, None] + b[i][None]).ravel(), kind="stable")
        upto = np.empty(len(order))
        upto[order] = np.cumsum(counts[order])
        near = x @ x[i]
        near[i] = -np.inf
        mass.append(upto[cells[np.argsort(-near)[: min(keep, len(x) - 1)]]])
    return float(np.quantile(np.concatenate(mass), recall)) / len(x) if len(x) > 1 else 1.0


def shelves(sizes: dict[int, int]) -> tuple[dict[int, int], list[int]]:
    """The shelf of each cell, and into how many blocks of entries each shelf is cut."""
    of: dict[int, int] = {}
    cut: list[int] = []
    held = BLOCK + 1
    for cell in sorted(sizes):
        if held + sizes[cell] > BLOCK:
            cut.append(-(-sizes[cell] // BLOCK))
            held = 0
        of[cell] = len(cut) - 1
        held += sizes[cell]
    return of, cut


def distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """v, ids: each vector once, with its `keep` smallest ids ascending.

    Ranks within salted parts of a vector's rows come first, so a vector that many rows
    share isn't gathered in one task.
    """
    part = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    rank = F.expr("row_number() OVER (PARTITION BY v, salt ORDER BY vec_id)")
    part = part.withColumn("r", rank).where(F.col("r") <= keep)
    return part.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"))


def _best(keep: int):
    def each(key, g: pd.DataFrame) -> pd.DataFrame:
        """Of each query of the group, its best entries among its cells: score and ids."""
        e, q = g[g["query"] == 0].sort_values("cell", kind="stable"), g[g["query"] == 1]
        out_q, out_s, out_i = [], [], []
        if len(e) and len(q):
            x = np.array(e["v"].to_list(), float)
            ids, cells = e["ids"].to_numpy(), e["cell"].to_numpy()
            least = np.array([i[0] for i in ids])
            for name, v, own in zip(q["id"], q["v"], q["cells"], strict=True):
                at = np.flatnonzero(np.isin(cells, own))
                if not len(at):
                    continue
                v = np.asarray(v, float)
                row = x[at] @ v
                if len(at) > keep:
                    # Ties at the border are kept until the exact scores are known.
                    at = at[row >= np.partition(row, -keep)[-keep] - 1e-9]
                s = (x[at] * v).sum(1)
                for k in np.lexsort((least[at], -s))[:keep]:
                    out_q.append(name)
                    out_s.append(s[k])
                    out_i.append(ids[at[k]])
        out = pd.DataFrame({"q": out_q, "score": out_s, "ids": out_i}, dtype=object)
        return out.astype({"q": "int64", "score": "float64"})

    return each


RESULT = "query_id long, rank int, vec_id long, score double"


def search(
    vectors: DataFrame, queries: Column, keep: int = 20, recall: float = 0.96, share: float | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the `keep` nearest other rows of each row of (vec_id, embedding) that `queries` picks.

    Scores are inner products in double precision, ties go to the smaller vec_id. Rows
    with a null vec_id, an invalid vector or another number of components than the
    first valid vector (by vec_id) take no part. Rows that repeat a vec_id with the
    same vector count once. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), queries.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    first = rows.orderBy("vec_id").select(F.size("v")).first()
    if first is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("v") == first[0])
    total = rows.count()
    fitted, fit_share = fit(rows, total, keep, recall)
    books = spark.sparkContext.broadcast(fitted)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=books.value.cells(np.array(b["v"].to_list(), float)))

    entries = distinct(rows.select("vec_id", "v").distinct(), keep + 1)
    entries = written(entries.mapInPandas(coded, "v array<double>, ids array<long>, cell int"), "ann-entries")
    # Counts by cell: at most the square of the number of centroids.
    sizes = {r["cell"]: r["n"] for r in entries.groupBy("cell").agg(F.count("*").alias("n")).toLocalIterator()}
    of, cut = shelves(sizes)
    sent = spark.sparkContext.broadcast((sizes, of))
    want = max(keep + 1, int((fit_share if share is None else share) * sum(sizes.values())))

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, (n, of) = books.value, sent.value
        for b in batches:
            out = []
            a, c = m.halves(np.array(b["v"].to_list(), float).reshape(len(b), -1)) if len(b) else ([], [])
            for name, v, x, y in zip(b["id"], b["v"], a, c, strict=True):
                by: dict[int, list[int]] = {}
                for cell in m.traverse(x, y, n, want):
                    by.setdefault(of[cell], []).append(cell)
                out += [(name, v, s, cells) for s, cells in by.items()]
            if out:
                yield pd.DataFrame(out, columns=["id", "v", "shelf", "cells"])

    asked = rows.where("is_query").select("vec_id", "v")
    named = asked.groupBy("v").agg(F.min("vec_id").alias("id"))
    plan = named.select("id", "v").mapInPandas(probes, "id long, v array<double>, shelf int, cells array<int>")
    plan = written(plan, "ann-probes")
    # One row a cell, 1,024 squared at most, and one a shelf: small enough to be sent to all tasks, so that no cell's entries meet before they are dealt out.
    busy = plan.groupBy("shelf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb"))
    shape = T.StructType([T.StructField(c, T.IntegerType()) for c in ("cell", "shelf", "eb")])
    places = spark.createDataFrame([(c, s, cut[s]) for c, s in of.items()], shape)
    places = F.broadcast(written(places.join(busy, "shelf"), "ann-places"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int").alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n)
    null = lambda t: F.lit(None).cast(t)
    es = entries.join(places, "cell").select("shelf", deal("v", "eb"), every("qb"), F.lit(0).alias("query"), null("long").alias("id"), "v", "ids", "cell", null("array<int>").alias("cells"))
    qs = plan.join(F.broadcast(places.select("shelf", "eb", "qb").distinct()), "shelf")
    qs = qs.select("shelf", every("eb"), deal("id", "qb"), F.lit(1).alias("query"), "id", "v", null("array<long>").alias("ids"), null("int").alias("cell"), "cells")
    near = es.unionByName(qs).groupBy("shelf", "eb", "qb").applyInPandas(_best(keep + 1), "q long, score double, ids array<long>")
    # The best of each different query vector, then of each row that asks it.
    flat = near.select("q", "score", F.explode("ids").alias("vec_id"))
    order = "PARTITION BY {} ORDER BY score DESC, vec_id"
    flat = flat.withColumn("r", F.expr(f"row_number() OVER ({order.format('q')})")).where(F.col("r") <= keep + 1)
    each = asked.select("vec_id", "v").distinct().withColumnRenamed("vec_id", "query_id")
    each = each.join(named, "v").select("query_id", F.col("id").alias("q"))
    out = each.join(flat, "q").where("query_id <> vec_id")
    out = out.withColumn("rank", F.expr(f"row_number() OVER ({order.format('query_id')})"))
    return out.where(F.col("rank") <= keep).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame) -> DataFrame:
    """The 20 nearest others of every row whose vec_id is divisible by 20."""
    return search(vectors, F.col("vec_id") % 20 == 0)
