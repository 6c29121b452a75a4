"""Pose errors and recognition rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as v
from .clouds import bounds
from .neighbors import nearest


def add_error(truth: DataFrame, found: DataFrame, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """key, n, error: mean distance of corresponding points; sums are whole numbers of 1e-9."""
    both = truth.alias("a").join(found.alias("b"), [key, point])
    far = v.norm(v.sub(v.of("a"), v.of("b")))
    return both.groupBy(key).agg(F.count("*").alias("n"), (F.sum(F.expr(v.fixed(far, 9))) / 1e9 / F.count("*")).alias("error"))


def adi_error(truth: DataFrame, found: DataFrame, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """key, n, error: mean distance of found points to the nearest true point, for symmetric objects."""
    near = nearest(found, truth, radius, key, point)
    return near.groupBy(F.col(f"q_{key}").alias(key)).agg(F.count("*").alias("n"), (F.sum(F.expr(v.fixed("sqrt(d2)", 9))) / 1e9 / F.count("*")).alias("error"))


def recall_by_object(results: DataFrame) -> DataFrame:
    """object, num, den, rate from rows (object, hit)."""
    g = results.groupBy("object").agg(F.count(F.when(F.col("hit"), 1)).alias("num"), F.count("*").alias("den"))
    return g.withColumn("rate", F.col("num") / F.col("den"))


def recall_macro(results: DataFrame) -> DataFrame:
    """objects, rate: the mean of the objects' rates."""
    return recall_by_object(results).agg(F.count("*").alias("objects"), F.avg("rate").alias("rate"))


def recall_rollup(results: DataFrame) -> DataFrame:
    """Each object's rate, and the pooled (micro) rate where object is null."""
    g = results.rollup("object").agg(F.count(F.when(F.col("hit"), 1)).alias("num"), F.count("*").alias("den"))
    return g.withColumn("rate", F.col("num") / F.col("den"))


def compare_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """side (both, left, right) and n of distinct keys found by two methods."""
    a = left.select("key").distinct().withColumn("l", F.lit(True))
    b = right.select("key").distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right")
    return a.join(b, "key", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def compare_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """key of what either method found, once."""
    return left.select("key").union(right.select("key")).distinct()


def adi_and_centre(truth: DataFrame, found: DataFrame, radius: float, share: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """key, adi, centre, hit: whether the mean distance to the nearest true point and the distance of the centres are both under `share` of the true diagonal."""
    mean = lambda c, p: c.groupBy(key).agg(*[(F.sum(F.expr(v.fixed(a, 9))) / 1e9 / F.count("*")).alias(f"{p}{a}") for a in "xyz"])
    both = mean(truth, "t").join(mean(found, "f"), key).join(bounds(truth, key).select(key, "diagonal"), key)
    far = v.norm(v.sub(v.vec("t"), v.vec("f")))
    out = both.join(adi_error(truth, found, radius, key, point), key).select(key, F.col("error").alias("adi"), F.expr(far).alias("centre"), "diagonal")
    return out.withColumn("hit", F.greatest("adi", "centre") < share * F.col("diagonal")).drop("diagonal")
