"""Normals, outliers, thinning, planes and connected parts of clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as v
from ..session import checkpointed
from .clouds import numbered
from .neighbors import AROUND, celled, knn, radius_join


def covariances(cloud: DataFrame, k: int, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """cxx..czz: scatter of each point's k nearest (itself among them) about their mean; whole numbers of 1e-9."""
    near = knn(cloud, cloud, k, radius, key, point, include_self=True)
    one = lambda a: F.sum(F.expr(v.fixed(a, 9))).alias(f"s{a}")
    two = lambda a, b: F.sum(F.expr(v.fixed(f"{a} * {b}", 9))).alias(f"s{a}{b}")
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    g = near.groupBy(F.col(f"q_{key}").alias(key), F.col(f"q_{point}").alias(point)).agg(
        F.count("*").alias("n"), *[one(a) for a in "xyz"], *[two(a, b) for a, b in pairs]
    )
    return g.selectExpr(key, point, "n", *[f"s{a}{b} / 1e9 - (s{a} / 1e9) * (s{b} / 1e9) / n AS c{a}{b}" for a, b in pairs])


def normal_steps(key: str, point: str) -> list[list[str]]:
    """Select lists, one upon another, from cxx..czz to the unit direction of least scatter.

    The least eigenvalue is in closed form; the direction is the largest cross product of the
    shifted matrix' rows, its largest component made positive.
    """
    q = "((cxx + cyy + czz) / 3)"
    p2 = f"(((cxx - {q}) * (cxx - {q}) + (cyy - {q}) * (cyy - {q}) + (czz - {q}) * (czz - {q}) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6)"
    det = "((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz))"
    turn = f"acos({v.clamp1(f'(coalesce({det} / nullif(2 * p * p * p, 0), 1e0))')})"
    rows = [("(cxx - least)", "cxy", "cxz"), ("cxy", "(cyy - least)", "cyz"), ("cxz", "cyz", "(czz - least)")]
    crosses = [v.cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    size = [f"round({v.norm2(x)}, 15)" for x in crosses]

    def pick(i: int) -> str:
        first = f"CASE WHEN {size[0]} >= {size[1]} AND {size[0]} >= {size[2]} THEN {crosses[0][i]}"
        return f"{first} WHEN {size[1]} >= {size[2]} THEN {crosses[1][i]} ELSE {crosses[2][i]} END"

    n = f"nullif({v.norm(v.vec('w'))}, 0)"
    lead = "(CASE WHEN abs(wx) >= abs(wy) AND abs(wx) >= abs(wz) THEN wx WHEN abs(wy) >= abs(wz) THEN wy ELSE wz END)"
    return [
        ["*", f"{q} AS q", f"sqrt(greatest({p2}, 0e0)) AS p"],
        ["*", f"q + 2 * p * cos(({turn} + 2 * pi()) / 3) AS least"],
        [key, point, "least", "q", *[f"{pick(i)} AS w{a}" for i, a in enumerate("xyz")]],
        [key, point, *[f"sign({lead}) * w{a} / {n} AS n{a}" for a in "xyz"], "least / nullif(3 * q, 0) AS curvature"],
    ]


def normals(cloud: DataFrame, k: int, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """key, point, nx, ny, nz, curvature by the plane through each point's k nearest, all in generated code."""
    out = covariances(cloud, k, radius, key, point)
    for step in normal_steps(key, point):
        out = out.selectExpr(*step)
    return out


def outlier_scores(cloud: DataFrame, k: int, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """key, point, sigma, score: local outlier probability, 0 for points as dense as their neighbours.

    sigma is the root mean square distance to the k nearest; plof compares it with that of the
    neighbours; the error function is the usual quartic approximation.
    """
    near = knn(cloud, cloud, k, radius, key, point).select(F.col(f"q_{key}").alias(key), F.col(f"q_{point}").alias("q"), F.col(point).alias("r"), "d2")
    sigma = near.groupBy(key, "q").agg(F.sqrt(F.sum(F.expr(v.fixed("d2", 12))) / 1e12 / F.count("*")).alias("sigma"))
    mean = near.join(sigma.withColumnRenamed("q", "r"), [key, "r"]).groupBy(key, "q").agg((F.sum(F.expr(v.fixed("sigma", 9))) / 1e9 / F.count("*")).alias("around"))
    p = sigma.join(mean, [key, "q"]).selectExpr(key, "q", "sigma", "sigma / nullif(around, 0) - 1 AS plof")
    spread = p.groupBy(key).agg(F.sqrt(F.sum(F.expr(v.fixed("plof * plof", 9))) / 1e9 / F.count("*")).alias("nplof"))
    score = outlier_probability()
    return p.join(spread, key).selectExpr(key, f"q AS {point}", "sigma", f"CASE WHEN plof <= 0 THEN 0e0 ELSE {score} END AS score")


def outlier_probability() -> str:
    """The score of plof over its spread nplof, by the quartic approximation of the error function."""
    x = "(plof / nullif(nplof * sqrt(2e0), 0))"
    poly = f"(1 + 0.278393 * {x} + 0.230389 * {x} * {x} + 0.000972 * {x} * {x} * {x} + 0.078108 * {x} * {x} * {x} * {x})"
    return f"coalesce(greatest(0e0, 1 - 1 / ({poly} * {poly} * {poly} * {poly})), 0e0)"


def greedy(nodes: DataFrame, edges: DataFrame, key: str, point: str) -> DataFrame:
    """key, point of the nodes that a greedy choice keeps; edges (key, lo, hi): `hi` goes where `lo`, which comes before it, is kept.

    Rounds: a node is kept once all before it that are near it are gone, and removes its
    neighbours. Each round is a join; the result doesn't depend on partitions.
    """
    edges = checkpointed(edges.select(key, "hi", "lo"))
    state = checkpointed(nodes.select(key, point).withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept IS NULL").isEmpty():
        open_ = state.where("kept IS NULL").select(key, F.col(point).alias("lo"))
        held = edges.join(open_, [key, "lo"]).select(key, F.col("hi").alias(point)).distinct().withColumn("held", F.lit(True))
        new = state.where("kept IS NULL").join(held, [key, point], "left").where("held IS NULL").select(key, point)
        gone = edges.join(new.withColumnRenamed(point, "lo"), [key, "lo"]).select(key, F.col("hi").alias(point)).distinct()
        marks = new.withColumn("m", F.lit(True)).unionByName(gone.withColumn("m", F.lit(False)))
        marks = marks.groupBy(key, point).agg(F.max("m").alias("m"))
        state = checkpointed(state.join(marks, [key, point], "left").select(key, point, F.coalesce("kept", "m").alias("kept")))
        edges = checkpointed(edges.join(state.where("kept IS NULL").select(key, F.col(point).alias("hi")), [key, "hi"], "left_semi"))
    return state.where("kept").select(key, point)


#: Places of each key's order that the first batch of `thinned` takes; each further one ends at four times as many.
BATCH = 1024


def thinned(cloud: DataFrame, radius: float, key: str = "obj", point: str = "pt_id", clash: str = "true") -> DataFrame:
    """Rows that a greedy choice in order of `row` (from 0 in each key) keeps: those that clash with no earlier kept one within the radius.

    `clash` is a condition on a pair, its earlier point with q_. Batches of the order follow one another: pairs are formed
    inside a batch only, and what is kept there removes its neighbours from all that follows. So a later, larger batch
    has few pairs left, and all pairs together are far from the square of the points.
    """
    left, to, out = checkpointed(cloud), BATCH, None
    while not left.isEmpty():
        batch = left.where(F.col("row") < to)
        near = radius_join(batch, batch, radius, key).where(f"q_row < row AND ({clash})")
        new = greedy(batch, near.select(F.col(key), F.col(point).alias("hi"), F.col(f"q_{point}").alias("lo")), key, point)
        new = checkpointed(batch.join(new, [key, point], "left_semi").select(*cloud.columns))
        out = new if out is None else out.unionByName(new)
        rest = left.where(F.col("row") >= to)
        gone = radius_join(new, rest, radius, key).where(clash).select(key, point).distinct()
        left, to = checkpointed(rest.join(gone, [key, point], "left_anti").select(*cloud.columns)), 4 * to
    return left if out is None else out


def poisson_disk(cloud: DataFrame, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """A maximal subset without two points nearer than the radius: the greedy choice in order of ids."""
    kept = thinned(numbered(cloud.select(key, point, "x", "y", "z"), key, point), radius, key, point)
    return cloud.join(kept.select(key, point), [key, point], "left_semi")


def merge_close(cloud: DataFrame, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """key, point, target: each point and the kept point that it is snapped to, nearest first, ties to the smaller id."""
    kept = poisson_disk(cloud, radius, key, point)
    near = radius_join(cloud, kept, radius, key)
    best = near.groupBy(F.col(f"q_{key}").alias(key), F.col(f"q_{point}").alias(point)).agg(F.min(F.struct("d2", F.col(point).alias("t"))).alias("b"))
    return cloud.select(key, point).join(best, [key, point], "left").select(key, point, F.coalesce("b.t", point).alias("target"))


def _least_reached(edges: DataFrame, key: str) -> DataFrame:
    """key, a, part: the least id reachable over edges (key, a, b; both ways and from each node to itself), by label spreading with shortcuts."""
    edges = checkpointed(edges.select(key, "a", "b"))
    label = edges.select(key, "a", F.col("a").alias("part")).distinct()
    while True:
        seen = edges.join(label.withColumnRenamed("a", "b"), [key, "b"]).groupBy(key, "a").agg(F.min("part").alias("part"))
        # A shortcut: the label of the label.
        jump = seen.join(seen.select(F.col(key), F.col("a").alias("part"), F.col("part").alias("p2")), [key, "part"], "left")
        new = checkpointed(jump.select(key, "a", F.least("part", F.coalesce("p2", "part")).alias("part")))
        if label.exceptAll(new).isEmpty():
            return new
        label = new


def connected_parts(cloud: DataFrame, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """key, point, part: the least id reachable over steps shorter than the radius.

    Points of one small cell, or of two cells with a common face, are surely connected, so cells are joined first.
    Pairs of points are only formed where several of these parts meet, and not inside a cloud's largest part.
    """
    real = " AND ".join(f"abs({c}) < double('infinity')" for c in "xyz")
    # Two such cells are twice as long as wide: their diagonal, sqrt(6) sides, stays under the radius.
    points = checkpointed(celled(cloud.select(key, point, "x", "y", "z").where(real), radius * 0.999 / 6**0.5))
    cell = [key, "cx", "cy", "cz"]
    nodes = checkpointed(points.groupBy(*cell).agg(F.min(point).alias("node")))
    faces = ["struct(0 AS a, 0 AS b, 0 AS c)", *[f"struct({a} AS a, {b} AS b, {c} AS c)" for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]]
    moved = nodes.withColumn("s", F.explode(F.expr(f"array({', '.join(faces)})"))).select(key, F.col("node").alias("a"), *[(F.col(f"c{c}") + F.col(f"s.{x}")).alias(f"c{c}") for c, x in zip("xyz", "abc", strict=True)])
    edges = moved.join(nodes, cell).select(key, "a", F.col("node").alias("b"))
    points = points.join(nodes, cell)
    # Rows of one id are one point, wherever they lie.
    twice = points.select(key, "node", F.min("node").over(Window.partitionBy(key, point)).alias("first")).where("node <> first").distinct()
    edges = edges.unionByName(twice.selectExpr(key, "node AS a", "first AS b")).unionByName(twice.selectExpr(key, "first AS a", "node AS b"))
    parts = _least_reached(edges, key)
    points = checkpointed(points.select(key, point, "x", "y", "z", "node").join(parts.withColumnRenamed("a", "node"), [key, "node"]).select(key, point, "x", "y", "z", "part"))
    # Where parts meet: cells as wide as the radius with more than one part in them and around.
    wide = celled(points, radius)
    each = wide.groupBy(*cell).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).withColumn("s", F.explode(F.expr(f"array({', '.join(AROUND)})")))
    each = each.select(key, "lo", "hi", *[(F.col(f"c{c}") + F.col(f"s.{x}")).alias(f"c{c}") for c, x in zip("xyz", "abc", strict=True)])
    mixed = each.groupBy(*cell).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select(*cell)
    border = checkpointed(wide.join(mixed, cell, "left_semi").select(*points.columns))
    largest = points.groupBy(key, "part").agg(F.count("*").alias("n")).groupBy(key).agg(F.max(F.struct("n", "part")).alias("m")).select(key, F.col("m.part").alias("part"))
    links = radius_join(border.join(largest, [key, "part"], "left_anti").select(*border.columns), border, radius, key).where("q_part <> part")
    links = checkpointed(links.select(key, F.col("q_part").alias("a"), F.col("part").alias("b")).distinct())
    own = parts.select(key, F.col("part").alias("a"), F.col("part").alias("b")).distinct()
    whole = _least_reached(own.unionByName(links).unionByName(links.selectExpr(key, "b AS a", "a AS b")), key)
    out = points.select(key, point, F.col("part").alias("a")).distinct().join(whole, [key, "a"])
    return out.select(key, point, "part").distinct()


def drop_small_parts(cloud: DataFrame, radius: float, least: int, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """The cloud without its connected parts of fewer than `least` points."""
    parts = connected_parts(cloud, radius, key, point)
    large = parts.groupBy(key, "part").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return cloud.join(parts.join(large, [key, "part"], "left_semi"), [key, point], "left_semi")


def dominant_plane(cloud: DataFrame, distance: float, trials: int = 64, seed: int = 3, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """key, a, b, c, d, n: of `trials` planes through three points of each cloud, the one with the most points near it.

    The points of the trials are those with the least seeded hashes, so a trial costs one bounded
    row; every point is then scored against its cloud's planes.
    """
    three = F.xxhash64(F.lit(seed), point)
    pick = cloud.withColumn("r", F.row_number().over(_by(key, three, point))).where(F.col("r") <= 3 * trials)
    trial = pick.withColumn("t", F.floor((F.col("r") - 1) / 3)).withColumn("s", F.pmod(F.col("r") - 1, F.lit(3)))
    sides = [F.max(F.when(F.col("s") == i, F.col(c))).alias(f"{c}{i}") for i in range(3) for c in "xyz"]
    g = trial.groupBy(key, "t").agg(*sides, F.count("*").alias("k")).where("k = 3")
    at = [tuple(f"{c}{i}" for c in "xyz") for i in range(3)]
    n = v.cross(v.sub(at[1], at[0]), v.sub(at[2], at[0]))
    g = g.selectExpr(key, "t", *[f"{e} AS w{a}" for a, e in zip("xyz", n, strict=True)], "x0", "y0", "z0")
    long = f"nullif({v.norm(v.vec('w'))}, 0)"
    g = g.selectExpr(key, "t", *[f"w{a} / {long} AS {b}" for a, b in zip("xyz", "abc", strict=True)], f"-(wx * x0 + wy * y0 + wz * z0) / {long} AS d").where("a IS NOT NULL")
    planes = g.groupBy(key).agg(F.collect_list(F.struct("t", "a", "b", "c", "d")).alias("planes"))
    # A point names the planes that it is near to; most are near none, and counts are added up before the shuffle.
    near = F.filter("planes", lambda p: F.abs(p["a"] * F.col("x") + p["b"] * F.col("y") + p["c"] * F.col("z") + p["d"]) <= distance)
    hit = cloud.join(planes, key).select(key, F.explode(near).alias("p")).groupBy(key, "p").agg(F.count("*").alias("n"))
    best = hit.groupBy(key).agg(F.max(F.struct("n", (-F.col("p.t")).alias("t"), "p")).alias("m"))
    return best.select(key, "m.p.a", "m.p.b", "m.p.c", "m.p.d", "m.n")


def subtract_plane(cloud: DataFrame, distance: float, key: str = "obj", **how) -> DataFrame:
    """The cloud without the points near its dominant plane."""
    plane = dominant_plane(cloud, distance, key=key, **how).drop("n")
    out = cloud.join(plane, key, "left").where(F.expr(f"coalesce(abs(a * x + b * y + c * z + d) > {distance}, true)"))
    return out.select(*cloud.columns)


def _by(key: str, *order):
    return Window.partitionBy(key).orderBy(*order)


def smooth(cloud: DataFrame, value: str, k: int, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """key, point, value averaged over the k nearest and the point itself."""
    near = knn(cloud, cloud, k, radius, key, point, include_self=True)
    return near.groupBy(F.col(f"q_{key}").alias(key), F.col(f"q_{point}").alias(point)).agg(
        (F.sum(F.expr(v.fixed(value))) / 1e6 / F.count("*")).alias(value)
    )
