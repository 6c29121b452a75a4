"""Random samples of points by weight, and of surfaces by area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as v
from ..functions.chance import uniform
from . import mesh, ranks

#: Rows that one row is expanded to at a time, so that no row holds a long array.
CHUNK = 1 << 16


def weighted(cloud: DataFrame, n: int, weight: str, seed: int, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """`n` points of each cloud (all, if fewer) drawn one after the other without replacement by weight; all columns and `draw`.

    Each point has an exponential key, -ln(u) / weight, and those with the least keys are the sample; `draw` is the key.
    The n-th key comes from counted buckets, so no task holds a cloud. Points whose weight is null, not finite or not
    above 0 are never drawn; of equal keys the smaller ids are taken; a null cloud is one of its own.
    """
    rows = cloud.withColumn("_w", F.expr(f"cast({weight} AS double)")).where("_w > 0 AND _w < double('infinity')")
    rows = rows.withColumn("draw", F.expr(f"-ln({uniform(seed, f'coalesce({key}, -1)', point)}) / _w")).drop("_w")
    last = ranks.at_index(rows, key, "draw", F.lit(n - 1), "_last").withColumnRenamed(key, "_key")
    rows = rows.join(last, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").where("draw <= _last")
    # Equal keys at the end of the sample only.
    under = rows.where("draw < _last").drop("_last")
    few = under.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    ends = rows.where("draw = _last").drop("_last").withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(point)))
    ends = ends.join(few, F.col(key).eqNullSafe(F.col("_key")), "left").where(F.col("_at") <= n - F.coalesce("_n", F.lit(0)))
    return under.unionByName(ends.select(*under.columns))


def area_intervals(faces: DataFrame, cloud: DataFrame) -> DataFrame:
    """obj, face, the corners' coordinates, lo, hi: each face's interval of its mesh's area in order of ids, in whole numbers of 1e-9.

    Areas are summed by blocks of ids first, so a large mesh isn't sorted in one task. Faces under half a unit have none.
    """
    f = mesh.with_corners(faces, cloud)
    f = f.withColumn("area", F.expr(v.fixed(f"{v.norm(mesh.normal_exprs())} / 2", 9))).withColumn("b_", F.floor(F.col("face") / 4096)).where("area > 0")
    per = f.groupBy("obj", "b_").agg(F.sum("area").alias("m"))
    per = per.selectExpr("obj", "b_", "sum(m) OVER (PARTITION BY obj ORDER BY b_) - m AS before")
    f = f.withColumn("hi", F.expr("sum(area) OVER (PARTITION BY obj, b_ ORDER BY face, a, b, c ROWS UNBOUNDED PRECEDING)"))
    f = f.join(per, ["obj", "b_"]).withColumn("hi", F.col("before") + F.col("hi")).withColumn("lo", F.col("hi") - F.col("area"))
    return f.select("obj", "face", *[f"{k}_{x}" for k in mesh.CORNERS for x in "xyz"], "lo", "hi")


def _expanded(df: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """A row for each whole number from `first` to `last`."""
    df = df.withColumn("_chunk", F.explode(F.expr(f"sequence(({first}) div {CHUNK}, ({last}) div {CHUNK})")))
    within = f"sequence(greatest({first}, _chunk * {CHUNK}), least({last}, _chunk * {CHUNK} + {CHUNK - 1}))"
    return df.withColumn(name, F.explode(F.expr(within))).drop("_chunk")


def barycentric(seed: int, duck: bool = False) -> tuple[str, str, str]:
    """A uniform point of the sample's face: coordinates by its corners."""
    r, s = uniform(seed + 1, "obj", "sample", duck=duck), uniform(seed + 2, "obj", "sample", duck=duck)
    # The half of the square beyond the diagonal is turned onto the other.
    r, s = (f"(CASE WHEN {r} + {s} > 1 THEN 1 - {x} ELSE {x} END)" for x in (r, s))
    return tuple(f"a_{x} + {r} * (b_{x} - a_{x}) + {s} * (c_{x} - a_{x})" for x in "xyz")


def surface(faces: DataFrame, cloud: DataFrame, n: int, seed: int) -> DataFrame:
    """obj, sample (0 to n - 1), face, x, y, z: `n` points of each mesh, uniform by area (Monte Carlo).

    A sample's place in the mesh's area is found by a join on cells of it, as many as there are faces and samples,
    so that a cell holds one sample on average; a face stands in each cell that it reaches. Repeated faces count each;
    meshes without area have no samples.
    """
    f = area_intervals(faces, cloud)
    total = f.groupBy("obj").agg(F.max("hi").alias("total"), F.count("*").alias("faces"))
    total = total.selectExpr("obj", "total", f"total div (faces + {n}) + 1 AS width")
    cells = _expanded(f.join(total.select("obj", "width"), "obj"), "lo div width", "(hi - 1) div width", "cell").drop("width")
    some = _expanded(total, "0L", f"{n - 1}L", "sample")
    place = F.expr(f"cast(floor({uniform(seed, 'obj', 'sample')} * total) AS bigint)")
    some = some.withColumn("at", place).withColumn("cell", F.expr("at div width")).drop("total", "width")
    hit = some.join(cells, ["obj", "cell"]).where("lo <= at AND at < hi")
    return hit.select("obj", "sample", "face", *[F.expr(e).alias(x) for e, x in zip(barycentric(seed), "xyz", strict=True)])
