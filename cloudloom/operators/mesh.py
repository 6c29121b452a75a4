"""Triangle tables: faces are rows (obj, face, a, b, c) whose corners are point ids of a cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as v

CORNERS = ("a", "b", "c")


def strip(cloud: DataFrame, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """The triangles of each cloud's points taken three in a row, in order of ids."""
    over = f"OVER (PARTITION BY {key} ORDER BY {point})"
    f = cloud.selectExpr(key, f"{point} AS face", f"{point} AS a", f"lead({point}, 1) {over} AS b", f"lead({point}, 2) {over} AS c")
    return f.where("c IS NOT NULL")


def with_corners(faces: DataFrame, cloud: DataFrame, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """The faces with their corners' coordinates a_x to c_z."""
    out = faces
    for k in CORNERS:
        side = cloud.select(key, F.col(point).alias(k), *[F.col(x).alias(f"{k}_{x}") for x in "xyz"])
        out = out.join(side, [key, k])
    return out


def normal_exprs() -> v.Vec:
    """Twice the face's area along its normal."""
    a, b, c = (v.vec(f"{k}_") for k in CORNERS)
    return v.cross(v.sub(b, a), v.sub(c, a))


def areas(faces: DataFrame, cloud: DataFrame) -> DataFrame:
    """obj, n, area of all faces; sums are whole numbers of 1e-9."""
    each = v.fixed(f"{v.norm(normal_exprs())} / 2", 9)
    return with_corners(faces, cloud).groupBy("obj").agg(F.count("*").alias("n"), (F.sum(F.expr(each)) / 1e9).alias("area"))


def vertex_normals(faces: DataFrame, cloud: DataFrame) -> DataFrame:
    """obj, pt_id, faces, nx, ny, nz: area-weighted unit normals of the points that faces use."""
    n = normal_exprs()
    f = with_corners(faces, cloud).selectExpr("obj", "explode(array(a, b, c)) AS pt_id", *[f"{e} AS w{x}" for e, x in zip(n, "xyz", strict=True)])
    g = f.groupBy("obj", "pt_id").agg(F.count("*").alias("faces"), *[F.sum(F.expr(v.fixed(f"w{x}", 9))).alias(f"w{x}") for x in "xyz"])
    return g.selectExpr("obj", "pt_id", "faces", *[f"{e} AS n{x}" for e, x in zip(v.unit(v.scale(v.vec("w"), "1e-9")), "xyz", strict=True)])


def drop_duplicate_faces(faces: DataFrame) -> DataFrame:
    """Of faces with the same corners in any order, the one with the smallest id; faces that repeat a corner go."""
    whole = faces.where("a <> b AND b <> c AND a <> c").withColumn("corners", F.sort_array(F.array(*CORNERS)))
    return whole.groupBy("obj", "corners").agg(F.min(F.struct("face", *CORNERS)).alias("f")).select("obj", "f.*")


def edges(faces: DataFrame) -> DataFrame:
    """obj, p, q (p < q), faces: each edge and how many faces share it; 1 marks a border, over 2 a fold."""
    e = faces.selectExpr("obj", "explode(array(struct(a AS x, b AS y), struct(b AS x, c AS y), struct(c AS x, a AS y))) AS e")
    return e.selectExpr("obj", "least(e.x, e.y) AS p", "greatest(e.x, e.y) AS q").groupBy("obj", "p", "q").agg(F.count("*").alias("faces"))


def euler_numbers(faces: DataFrame) -> DataFrame:
    """obj, points, edges, faces, borders, euler."""
    corner = faces.selectExpr("obj", "explode(array(a, b, c)) AS p").distinct().groupBy("obj").agg(F.count("*").alias("points"))
    e = edges(faces).groupBy("obj").agg(F.count("*").alias("edges"), F.count(F.when(F.col("faces") == 1, 1)).alias("borders"))
    n = faces.groupBy("obj").agg(F.count("*").alias("faces"))
    return corner.join(e, "obj").join(n, "obj").withColumn("euler", F.expr("points - edges + faces"))


def unreferenced(cloud: DataFrame, faces: DataFrame, point: str = "pt_id") -> DataFrame:
    """The points that no face uses."""
    used = faces.selectExpr("obj", f"explode(array(a, b, c)) AS {point}")
    return cloud.join(used, ["obj", point], "left_anti")
