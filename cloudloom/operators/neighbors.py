"""Neighbour joins of point clouds on a grid.

Points fall into cubic cells of the search radius, so all points within the radius
of a query lie in its cell or the 26 around it: an equi-join on the cell. Clouds are
frames with a cloud key, an id and x, y, z; results name query columns q_ and
reference columns as they are.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as v
from ..session import checkpointed

AROUND = [f"struct({a} AS a, {b} AS b, {c} AS c)" for a, b, c in product((-1, 0, 1), repeat=3)]


def celled(cloud: DataFrame, radius: float) -> DataFrame:
    cell = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"]
    return cloud.select("*", *cell)


def radius_join(
    queries: DataFrame, refs: DataFrame, radius: float, key: str = "obj", strict: bool = True, copied: str = "queries"
) -> DataFrame:
    """All columns of both sides (queries' with q_ before them) and d2, for pairs of one cloud within the radius.

    The side named by `copied`, best the smaller one, stands in its cell and the 26 around it.
    """
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).withColumn(key, F.col(f"q_{key}"))
    placed = []
    for name, side, p in (("queries", q, "q_"), ("refs", refs, "")):
        shift = F.explode(F.expr(f"array({', '.join(AROUND)})")) if name == copied else F.expr("struct(0 AS a, 0 AS b, 0 AS c)")
        cell = [(F.floor(F.col(f"{p}{c}") / radius) + F.col(f"s.{s}")).alias(f"c{c}") for c, s in zip("xyz", "abc", strict=True)]
        placed.append(side.select("*", shift.alias("s")).select(*side.columns, *cell))
    both = placed[0].join(placed[1], [key, "cx", "cy", "cz"])
    d2 = F.expr("(x - q_x) * (x - q_x) + (y - q_y) * (y - q_y) + (z - q_z) * (z - q_z)")
    near = F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius
    return both.withColumn("d2", d2).where(near).drop("cx", "cy", "cz")


def starting_radius(queries: DataFrame, refs: DataFrame, radius: float, widest: float, k: int, key: str = "obj") -> float:
    """The radius, or a fraction of it whose cells hold about k / 2 references for a query, so that the pairs of a join don't grow with the square of the points.

    Cells are counted anew at each smaller radius; references have at most k + 1 points at one place, which no radius parts.
    """
    both = queries.select(key, "x", "y", "z", F.lit(1).alias("q"), F.lit(0).alias("r")).unionByName(refs.select(key, "x", "y", "z", F.lit(0).alias("q"), F.lit(1).alias("r")))
    share, before, least = max(1.0, k / 2), float("inf"), widest / 2**40
    radius = min(radius, widest) if widest > 0 else radius
    while True:
        cells = celled(both, radius).groupBy(key, "cx", "cy", "cz").agg(F.sum("q").alias("q"), F.sum("r").alias("r"))
        met, n = cells.agg(F.sum(F.col("q") * F.col("r")), F.sum("q")).first()
        crowd = (met or 0) / n if n else 0.0
        if crowd <= share or crowd <= 2 * (k + 1) and crowd > 0.7 * before or radius <= least:
            return radius
        # Half the radius has an eighth of the points where these fill space; on surfaces it takes further rounds.
        radius /= 2 ** min(3, max(1, round(math.log(crowd / share, 8))))
        before = crowd


def knn(
    queries: DataFrame, refs: DataFrame, k: int, radius: float, key: str = "obj", point: str = "pt_id", include_self: bool = False, copied: str = "queries"
) -> DataFrame:
    """The k nearest of each query in its cloud: radius_join's columns and rank from 1; ties to the smaller id.

    A query whose k-th neighbour lies within the radius is done; the others are asked again
    with twice the radius, and those of clouds with too few points take all of these. Each
    round is checkpointed, so a later one doesn't repeat it. The first radius is the given one
    or, in crowded clouds, a smaller one (`starting_radius`).
    """
    # Of points at one place no query has more than these among its k nearest.
    same = f"row_number() OVER (PARTITION BY {key}, x, y, z ORDER BY {point})"
    refs = refs.withColumn("_same", F.expr(same)).where(F.col("_same") <= (k if include_self else k + 1)).drop("_same")
    out, left = None, queries
    # Beyond twice the width of both clouds together, a radius takes all.
    xyz = refs.select("x", "y", "z").unionByName(queries.select("x", "y", "z"))
    widest = max((w or 0.0 for w in xyz.agg(*[(F.max(c) - F.min(c)) for c in "xyz"]).first()), default=0.0)
    r = starting_radius(queries, refs, radius, widest, k, key)
    order = f"PARTITION BY q_{key}, q_{point} ORDER BY d2, {point}"
    while True:
        last = r > 2 * widest
        near = radius_join(left, refs, r, key, copied=copied)
        if not include_self:
            near = near.where(f"q_{point} <> {point}")
        near = near.withColumn("rank", F.expr(f"row_number() OVER ({order})")).where(F.col("rank") <= k)
        if last:
            return near if out is None else out.unionByName(near)
        near = checkpointed(near)
        done = near.where(F.col("rank") == k).select(F.col(f"q_{key}").alias(key), F.col(f"q_{point}").alias(point))
        full = near.join(done.select(F.col(key).alias(f"q_{key}"), F.col(point).alias(f"q_{point}")), [f"q_{key}", f"q_{point}"], "left_semi")
        full = full.select(*near.columns)
        out = full if out is None else out.unionByName(full)
        left = checkpointed(left.join(done, [key, point], "left_anti"))
        if left.isEmpty():
            return out
        r *= 2


def nearest(queries: DataFrame, refs: DataFrame, radius: float, key: str = "obj", point: str = "pt_id", copied: str = "queries") -> DataFrame:
    """knn with k = 1; queries and references may be different clouds with the same key."""
    return knn(queries, refs, 1, radius, key, point, include_self=True, copied=copied)


def bijective(pairs: DataFrame, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """Of all queries that chose a reference, the one nearest to it; ties to the smaller query."""
    order = f"PARTITION BY {key}, {point} ORDER BY d2, q_{point}"
    return pairs.withColumn("r", F.expr(f"row_number() OVER ({order})")).where("r = 1").drop("r")


def remove_in_sphere(cloud: DataFrame, centres: DataFrame, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """The cloud's points that no centre has within the radius."""
    near = radius_join(cloud, centres.select(key, "x", "y", "z"), radius, key, strict=False)
    gone = near.select(F.col(f"q_{key}").alias(key), F.col(f"q_{point}").alias(point)).distinct()
    return cloud.join(gone, [key, point], "left_anti")


def remove_in_sphere_normal(
    cloud: DataFrame, centres: DataFrame, radius: float, angle: float, key: str = "obj", point: str = "pt_id"
) -> DataFrame:
    """The cloud's points that no centre has within the radius and with a normal turned by less than `angle` against theirs."""
    near = radius_join(cloud, centres.select(key, "x", "y", "z", "nx", "ny", "nz"), radius, key, strict=False)
    near = near.where(f"{v.dot(v.vec('q_n'), v.vec('n'))} > cos({angle})")
    gone = near.select(F.col(f"q_{key}").alias(key), F.col(f"q_{point}").alias(point)).distinct()
    return cloud.join(gone, [key, point], "left_anti")


def in_box(cloud: DataFrame, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> DataFrame:
    """Points within the closed box; the bounds reach the scan where the columns are stored."""
    for c, a, b in zip("xyz", lo, hi, strict=True):
        cloud = cloud.where(F.col(c).between(a, b))
    return cloud
