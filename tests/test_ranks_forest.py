"""Exact ranks, spanning forests with signs, and many poses refined at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import rot
from cloudloom.operators import cleaning, clouds, orient, ranks, register
from cloudloom.session import checkpointed


def frame(spark, values):
    return spark.createDataFrame([(k, float(x)) for k, vs in values.items() for x in vs], "obj long, y double")


def test_ranks_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 5)
    monkeypatch.setattr(ranks, "BUCKETS", 8)
    rng = random.Random(3)
    values = {1: [rng.gauss(0, 1) for _ in range(700)], 2: [7.0] * 90, 3: [10.0**-i for i in range(80)] + [0.0] * 30, 4: [float("inf"), -float("inf"), 1e308, -1e308, 5e-324, 0.0] * 3, 5: [2.5]}
    df = frame(spark, values).unionByName(spark.createDataFrame([(1, float("nan")), (9, None), (None, 3.0)], "obj long, y double")).repartition(7)
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = {r["obj"]: r["percentile"] for r in ranks.percentile(df, "obj", "y", share).collect()}
        assert got == {k: sorted(vs)[max(0, int(len(vs) * share) - 1)] for k, vs in values.items()} | {None: 3.0}
    got = {r["obj"]: r["median"] for r in ranks.lower_median(df, "obj", "y").collect()}
    assert got == {k: sorted(vs)[(len(vs) - 1) // 2] for k, vs in values.items()} | {None: 3.0}
    assert ranks.lower_median(df.limit(0), "obj", "y").count() == 0


def test_percentile_isn_t_the_least_value_of_its_share(spark):
    df = frame(spark, {1: range(1, 16)})
    assert ranks.percentile(df, "obj", "y", 0.5).first()["percentile"] == 7
    assert df.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY y)")).first()[0] == 8


def test_histogram_percentile(spark):
    df = frame(spark, {1: [0, 1, 2, 3, 9, 9, 9, 12], 2: [100, 100]})
    counts = clouds.histogram(df, F.col("y"), 1.0, 11.0, 5, "obj")
    got = {share: {r["obj"]: r["percentile"] for r in ranks.histogram_percentile(counts, share, 1.0, 11.0, 5, "obj").collect()} for share in (0.1, 0.25, 0.5, 0.8, 1.0)}
    assert [got[s][1] for s in got] == [1.0, 3.0, 5.0, 11.0, float("inf")] and got[0.5][2] == float("inf")


def kruskal(n, edges):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    tree = []
    for w, a, b, turn in sorted(edges):
        if root(a) != root(b):
            up[root(a)] = root(b)
            tree.append((a, b, turn))
    return tree


def test_forest_is_kruskals(spark):
    rng = random.Random(1)
    n = 60
    pairs = sorted({tuple(sorted(rng.sample(range(n - 4), 2))) for _ in range(110)})
    edges = [(rng.choice([0.1, 0.2, rng.random()]), a, b, rng.choice([1, -1])) for a, b in pairs]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    df = spark.createDataFrame([(a, b, w, t) for w, a, b, t in edges], "a long, b long, w double, turn int")
    tree, at = orient.spanning_forest(nodes, df)
    want = kruskal(n, edges)
    assert sorted((r["a"], r["b"]) for r in tree.collect()) == sorted((a, b) for a, b, _ in want)
    place = {r["id"]: (r["root"], r["sign"]) for r in at.collect()}
    assert len(place) == n and len({p[0] for p in place.values()}) == n - len(want)
    for a, b, turn in want:
        assert place[a][0] == place[b][0] and place[a][1] * place[b][1] == turn


def test_sphere_comes_out_outward(spark):
    rng = np.random.default_rng(5)
    p = rng.standard_normal((150, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    n = p * rng.choice([-1, 1], (150, 1))
    rows = [(0, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, n, strict=True))] + [(0, 900, 0.0, 0.0, 3.0, None, None, None)]
    df = spark.createDataFrame(rows, "obj long, pt_id long, x double, y double, z double, nx double, ny double, nz double")
    out = checkpointed(orient.orient_normals(df, 6, 0.8))
    assert out.columns == df.columns and out.count() == 151
    assert out.where("nx IS NOT NULL AND nx * x + ny * y + nz * z <= 0").count() == 0
    assert out.where("pt_id = 900 AND nx IS NULL").count() == 1


def ellipsoid(spark, n=150):
    rng = np.random.default_rng(1)
    p = rng.standard_normal((n, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    size = np.array([1.0, 0.7, 0.4])
    normal = p / size
    normal /= np.linalg.norm(normal, axis=1, keepdims=True)
    rows = [(0, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p * size, normal, strict=True))]
    return spark.createDataFrame(rows, "obj long, pt_id long, x double, y double, z double, nx double, ny double, nz double")


def test_forest_keeps_sizes_small(spark):
    """The size that Spark expects of a long chain's forest doesn't grow with the rounds."""
    rng = random.Random(7)
    edges = spark.createDataFrame([(i, i + 1, rng.random(), -1) for i in range(120)], "a long, b long, w double, turn int")
    _, at = orient.spanning_forest(spark.range(121), edges)
    assert at._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**63
    assert len({(r["root"], r["sign"] * (-1) ** r["id"]) for r in at.collect()}) == 1


def test_computed_normals_turned(spark, monkeypatch):
    """Normals still to be computed: their expressions don't reach the plans of the neighbour search."""
    df = ellipsoid(spark, 150).drop("nx", "ny", "nz")
    edges, sizes = orient.neighbour_edges, []

    def seen(cloud, *how):
        sizes.append(len(cloud._jdf.queryExecution().analyzed().toString()))
        assert sizes[-1] < 2000
        return edges(cloud, *how)

    monkeypatch.setattr(orient, "neighbour_edges", seen)
    found = cleaning.normals(df, 8, 0.5).select("obj", "pt_id", "nx", "ny", "nz")
    out = orient.orient_normals(df.join(found, ["obj", "pt_id"]), 8, 0.5).collect()
    assert sizes and len(out) == 150
    assert all(r["nx"] * r["x"] + r["ny"] * r["y"] + r["nz"] * r["z"] > 0 for r in out)


def near_poses(spark, n):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        a, b = rng.uniform(-0.04, 0.04, 2)
        rz = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
        rx = np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
        rows.append((1, i, float(i % 5), *(rz @ rx).ravel().tolist(), *rng.uniform(-0.03, 0.03, 3).tolist()))
    return spark.createDataFrame(rows, "scene long, pose_id long, votes double, " + ", ".join(f"{c} double" for c in [*rot.NAMES, "tx", "ty", "tz"]))


def as_matrix(r):
    m = np.eye(4)
    m[:3, :3] = np.array([r[c] for c in rot.NAMES]).reshape(3, 3)
    m[:3, 3] = [r["tx"], r["ty"], r["tz"]]
    return m


def test_many_poses_as_single_runs(spark):
    model, starts = ellipsoid(spark, 80), near_poses(spark, 2)
    cfg = register.IcpConfig(3, 0.02, 100.0, 1)
    got = {r["pose_id"]: r for r in register.refine(starts, model, model, cfg, 0.5).collect()}
    unit = register.scene_unit(model)
    for r in starts.collect():
        m = as_matrix(r)
        motion, error = register.icp(register.moved(model, m), model, cfg, 0.5, unit)
        assert np.allclose(as_matrix(got[r["pose_id"]]), motion @ m, atol=1e-7) and got[r["pose_id"]]["error"] == pytest.approx(error, rel=1e-6)


def test_a_thousand_poses_in_one_run(spark):
    model = ellipsoid(spark, 60)
    cfg = register.IcpConfig(2, 0.02, 100.0, 1)
    jobs = []
    for n in (10, 1000):
        spark.sparkContext.setJobGroup(f"refine-{n}", "refine")
        out = register.post_process(near_poses(spark, n), model, model, 0.01, cfg, 0.5).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"refine-{n}")))
        assert sum(r["error"] is not None for r in out) > 0.5 * len(out)
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[1] <= 1.5 * jobs[0]
    assert np.median([np.abs(as_matrix(r) - np.eye(4)).max() for r in out]) < 0.02
    assert register.refine(near_poses(spark, 1), model, model.limit(0), cfg, 0.3).first()["error"] is None
