"""Sampling, bounds, transforms and statistics of point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rot
from ..functions import vec as v
from . import ranks


def numbered(cloud: DataFrame, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """Adds `row`: each cloud's points counted from 0 in order of their id.

    Points are counted by blocks of ids first, so a large cloud isn't sorted in one task.
    """
    block = F.floor(F.col(point) / 4096)
    c = cloud.withColumn("b", block)
    per = c.groupBy(key, "b").agg(F.count("*").alias("n"))
    per = per.selectExpr(key, "b", f"sum(n) OVER (PARTITION BY {key} ORDER BY b) - n AS before")
    c = c.withColumn("within", F.expr(f"row_number() OVER (PARTITION BY {key}, b ORDER BY {point}) - 1"))
    return c.join(per, [key, "b"]).withColumn("row", F.col("before") + F.col("within")).drop("b", "before", "within")


def sample_uniform(cloud: DataFrame, step: int, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """Every step-th point in order of ids; the ids stay."""
    return numbered(cloud, key, point).where(F.col("row") % step == 0).drop("row")


def bounds(cloud: DataFrame, key: str = "obj") -> DataFrame:
    """xmin to zmax of each cloud and `diagonal`, the length by which relative steps are measured."""
    box = [f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    spread = "sqrt(" + " + ".join(f"({c}max - {c}min) * ({c}max - {c}min)" for c in "xyz") + ")"
    return cloud.groupBy(key).agg(*box).withColumn("diagonal", F.expr(spread))


def sample_voxels(
    cloud: DataFrame, step: float, key: str = "obj", cubic: bool = False, angle: float | None = None, level: int = 0
) -> DataFrame:
    """One averaged point a grid cell, with unit mean normal and the number of points.

    A cell is `step` of each axis' own range, halved `level` times; with `cubic` it is `step`
    itself on all axes. With `angle`, a cell is split by the normal's polar and azimuth bins.
    Sums are whole numbers of 1e-6, so the result doesn't depend on the order of rows.
    """
    size = step / 2**level
    if cubic:
        c, at = cloud, {a: f"floor({a} / {size})" for a in "xyz"}
    else:
        box = bounds(cloud, key).drop("diagonal")
        c = cloud.join(box, key)
        at = {a: f"floor(({a} - {a}min) / nullif({size} * ({a}max - {a}min), 0))" for a in "xyz"}
    cells = [F.coalesce(F.expr(e), F.lit(0)).cast("long").alias(f"c{a}") for a, e in at.items()]
    more = []
    if angle is not None:
        more = [
            F.expr(f"cast(floor(round(acos({v.clamp1('nz')}), 9) / {angle}) AS bigint)").alias("ca"),
            F.expr(f"cast(floor(round(atan2(ny, nx) + pi(), 9) / {angle}) AS bigint)").alias("cb"),
        ]
    names = [key, "cx", "cy", "cz", *(["ca", "cb"] if more else [])]
    sums = [F.sum(F.expr(v.fixed(a))).alias(a) for a in ("x", "y", "z", "nx", "ny", "nz")]
    grid = c.select("*", *cells, *more).groupBy(*names).agg(F.count("*").alias("n"), *sums)
    mean = [f"{a} / 1e6 / n AS {a}" for a in "xyz"]
    normal = [f"{e} AS n{a}" for a, e in zip("xyz", v.unit(v.scale(v.vec("n"), "1e-6")), strict=True)]
    return grid.selectExpr(*names, "n", *mean, *normal)


def voxel_nearest(cloud: DataFrame, size: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """Of each cubic cell the point nearest to its centre; ties to the smaller id."""
    cell = {a: f"floor({a} / {size})" for a in "xyz"}
    centre = tuple(f"(({e} + 0.5) * {size})" for e in cell.values())
    d2 = v.norm2(v.sub(v.vec(""), centre))
    c = cloud.selectExpr("*", *[f"cast({e} AS bigint) AS c{a}" for a, e in cell.items()], f"round({d2}, 9) AS centre_d2")
    best = F.min(F.struct("centre_d2", point, "x", "y", "z")).alias("b")
    return c.groupBy(key, "cx", "cy", "cz").agg(best, F.count("*").alias("n")).select(key, f"b.{point}", "b.x", "b.y", "b.z", "n")


def transform(cloud: DataFrame, r: rot.Rot, t: v.Vec) -> DataFrame:
    """R p + t for the points and R n for the normals, where there are any."""
    moved = dict(zip("xyz", v.add(rot.apply(r, v.vec("")), t), strict=True))
    if "nx" in cloud.columns:
        moved |= dict(zip(("nx", "ny", "nz"), rot.apply(r, v.vec("n")), strict=True))
    return cloud.withColumns({c: F.expr(e) for c, e in moved.items()})


def normalize(cloud: DataFrame, scale: float, key: str = "obj") -> DataFrame:
    """Centred on the mean and scaled so that the widest axis spans `scale`; cx, cy, cz and lo, hi are the coefficients."""
    sums = [(F.sum(F.expr(v.fixed(a))) / F.count("*") / 1e6).alias(f"c{a}") for a in "xyz"]
    co = cloud.groupBy(key).agg(*sums, F.min(F.least("x", "y", "z")).alias("lo"), F.max(F.greatest("x", "y", "z")).alias("hi"))
    moved = {a: F.expr(f"({a} - c{a}) * {scale} / nullif(hi - lo, 0)") for a in "xyz"}
    return cloud.join(co, key).withColumns(moved)


def apply_coefficients(cloud: DataFrame, coefficients: DataFrame, scale: float, key: str = "obj") -> DataFrame:
    """The cloud moved and scaled by given coefficients (key, cx, cy, cz, lo, hi), as those of `normalize` for another cloud."""
    co = coefficients.select(key, *[F.col(c).alias(f"_{c}") for c in ("cx", "cy", "cz", "lo", "hi")])
    moved = {a: F.expr(f"({a} - _c{a}) * {scale} / nullif(_hi - _lo, 0)") for a in "xyz"}
    return cloud.join(co, key).withColumns(moved).select(*cloud.columns)


def weighted_centre(cloud: DataFrame, weight: str, key: str = "obj") -> DataFrame:
    """key, cx, cy, cz: the mean of the points by weight; null where all weights are zero."""
    total = F.sum(F.expr(v.fixed(weight, 9)))
    return cloud.groupBy(key).agg(*[(F.sum(F.expr(v.fixed(f"({weight}) * {a}", 9))) / F.nullif(total, F.lit(0))).alias(f"c{a}") for a in "xyz"])


def boxes_meet(left: DataFrame, right: DataFrame, key: str = "obj") -> DataFrame:
    """l_key, r_key of bounds (as of `bounds`) of two sets of clouds that share a point; few rows, one a cloud."""
    a = left.select(F.col(key).alias(f"l_{key}"), *[F.col(f"{c}{e}").alias(f"l{c}{e}") for c in "xyz" for e in ("min", "max")])
    b = right.select(F.col(key).alias(f"r_{key}"), *[F.col(f"{c}{e}").alias(f"r{c}{e}") for c in "xyz" for e in ("min", "max")])
    meet = " AND ".join(f"l{c}min <= r{c}max AND r{c}min <= l{c}max" for c in "xyz")
    return a.join(b, F.expr(meet)).select(f"l_{key}", f"r_{key}")


def add_noise(cloud: DataFrame, scale: float, seed: int, point: str = "pt_id") -> DataFrame:
    """Uniform noise in [-scale/2, scale/2) on each coordinate, fixed by the seed and the point's id."""
    noise = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), point), F.lit(1 << 30)) / (1 << 30) - 0.5) * scale
    return cloud.withColumns({c: F.col(c) + noise(i) for i, c in enumerate("xyz")})


def merge(*clouds: DataFrame) -> DataFrame:
    """All points of the clouds."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def drop_duplicates(cloud: DataFrame, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """Of points at equal coordinates, the one with the smallest id."""
    first = F.min(F.struct(point, *[c for c in cloud.columns if c not in (key, "x", "y", "z", point)])).alias("b")
    return cloud.groupBy(key, "x", "y", "z").agg(first).select(key, "x", "y", "z", "b.*")


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int, key: str | None = None) -> DataFrame:
    """(key,) bin (0 and bins + 1 for values out of range), n."""
    keys = [key] if key else []
    return df.select(*keys, F.width_bucket(value, F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


#: Fixed value: makes the median absolute deviation of normal data its standard deviation.
MAD = "1.48257968"


def rejection_threshold(df: DataFrame, key: str, value: str, scale: float, few: bool = False) -> DataFrame:
    """median + scale * 1.48... * the median absolute deviation, by exact ranks in bounded memory a key."""
    med = ranks.lower_median(df, key, value, few=few)
    dev = df.join(med, key).withColumn("dev", F.abs(F.col(value) - F.col("median")))
    mad = ranks.lower_median(dev, key, "dev", "mad", few)
    return med.join(mad, key).withColumn("threshold", F.expr(f"median + {scale} * {MAD} * mad"))


def robust_inliers(df: DataFrame, key: str, value: str, scale: float, part: float = 10.0, few: bool = False) -> DataFrame:
    """Rows whose value is under the threshold over `part`; `few` as for `ranks.lower_median`."""
    return df.join(rejection_threshold(df, key, value, scale, few), key).where(F.expr(f"{value} < threshold / {part}"))
