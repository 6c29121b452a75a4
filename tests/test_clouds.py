"""Point-cloud operators: properties, known answers and agreement with SQL."""

import os
import tempfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import rot
from cloudloom.functions import vec as v
from cloudloom.operators import cleaning, clouds, evaluate, features, poses, register
from cloudloom.plans import catalogue, views
from cloudloom.sources import maps, ply, posefile
from cloudloom.streaming import match_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_match_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = sql.execute(catalogue.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(cur.fetchall())


@pytest.mark.parametrize("name", ["pose_cluster", "pose_cluster_r3", "nms_center", "nms_bbox", "markley_avg", "spectral_score", "match_clusters", "plane_subtract"])
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def greedy_poses(rows, near):
    """The greedy choice in order of falling votes, as rows of (scene, pose_id, votes, r, t), with each pose's seed."""
    kept, seed = [], {}
    for p in sorted(rows, key=lambda p: (-p[2], p[1])):
        first = next((k for k in kept if k[0] == p[0] and near(k, p)), None)
        if first is None:
            kept.append(p)
        seed[p[0], p[1]] = first[1] if first else p[1]
    return {(p[0], p[1]) for p in kept}, seed


def test_greedy_pose_steps(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 3, i, float(rng.integers(1, 6)), rotation(int(rng.integers(8))), rng.uniform(0, 1, 3)) for i in range(180)]
    df = spark.createDataFrame([(s, i, v_, *map(float, r.ravel()), *map(float, t)) for s, i, v_, r, t in rows], poses.POSE)
    close = lambda d: lambda a, b: np.linalg.norm(a[4] - b[4]) < d
    assert {(r["scene"], r["pose_id"]) for r in poses.nms_centre(df, 0.3).collect()} == greedy_poses(rows, close(0.3))[0]
    half = np.array([0.1, 0.3, 0.2])

    def overlap(a, b):
        (la, ha), (lb, hb) = ((p[4] - np.abs(p[3]) @ half, p[4] + np.abs(p[3]) @ half) for p in (a, b))
        common = np.prod(np.clip(np.minimum(ha, hb) - np.maximum(la, lb), 0, None))
        return common / (np.prod(ha - la) + np.prod(hb - lb) - common)

    assert {(r["scene"], r["pose_id"]) for r in poses.nms_boxes(df, tuple(half), 0.2).collect()} == greedy_poses(rows, lambda a, b: overlap(a, b) > 0.2)[0]
    turn = lambda a, b: np.arccos(np.clip((np.trace(a[3] @ b[3].T) - 1) / 2, -1, 1))
    seeds, seed = greedy_poses(rows, lambda a, b: close(0.4)(a, b) and turn(a, b) < 1.5)
    got = {(r["scene"], r["pose_id"]): r for r in poses.cluster(df, 0.4, 1.5, weighted=True).collect()}
    assert set(got) == seeds
    for key, r in got.items():
        own = [p for p in rows if (p[0], seed[p[0], p[1]]) == key]
        weight = np.array([p[2] for p in own])
        assert r["n"] == len(own) and r["votes"] == pytest.approx(weight.sum())
        assert np.allclose([r["tx"], r["ty"], r["tz"]], weight @ np.array([p[4] for p in own]) / weight.sum())
        mean = np.array([r[n] for n in rot.NAMES]).reshape(3, 3)
        assert np.allclose(mean @ mean.T, np.eye(3), atol=1e-6)
        if len(own) == 1:
            assert np.allclose(mean, own[0][3], atol=1e-5)


def test_mean_rotation(spark):
    rng = np.random.default_rng(5)
    q = rng.standard_normal((40, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    df = spark.createDataFrame([(i % 2, *map(float, x), float(i % 3 + 1)) for i, x in enumerate(q)], "scene long, qw double, qx double, qy double, qz double, votes double")
    for r in poses.mean_rotation(df, weight="votes").collect():
        own = [i for i in range(40) if i % 2 == r["scene"]]
        _, vectors = np.linalg.eigh(sum((i % 3 + 1) * np.outer(q[i], q[i]) for i in own))
        assert abs(vectors[:, -1] @ [r["qw"], r["qx"], r["qy"], r["qz"]]) == pytest.approx(1, abs=1e-6)


def test_sparse_icp_keeps_its_multipliers(spark):
    """With outliers the multipliers of earlier steps matter; the plane mode comes closer on a smooth surface."""
    dst = sphere(spark, 300)
    m = np.eye(4)
    m[:3, 3] = [0.03, -0.02, 0.02]
    src = register.moved(dst, m)
    src = src.withColumn("pt_id", F.col("pt_id") * 64 + 5)
    rough = clouds.add_noise(src, 0.08, 3)
    once, twice = (register.sparse_icp(rough, dst, 0.2, outer=k) for k in (1, 2))
    # Two runs of one step each begin with multipliers of zero twice.
    apart = register.sparse_icp(register.moved(rough, once), dst, 0.2, outer=1) @ once
    assert not np.allclose(twice, apart, atol=1e-6)
    assert np.linalg.norm((register.sparse_icp(src, dst, 0.2, outer=4, plane=True) @ m - np.eye(4))[:3, 3]) < 0.02
    # Strides count rows, not ids.
    pose, _ = register.icp(src, dst, register.IcpConfig(12, 0.01, 25.0, 2), radius=0.2)
    assert np.allclose(pose @ m, np.eye(4), atol=0.03)


def test_refined_poses(spark):
    model, m = sphere(spark, 200), np.eye(4)
    m[:3, 3] = [0.02, 0.01, -0.01]
    scene = register.moved(model, m)
    rows = [(1, *np.eye(3).ravel().tolist(), 0.01, 0.0, 0.0), (2, *np.eye(3).ravel().tolist(), 0.02, 0.01, 0.0)]
    df = spark.createDataFrame(rows, "pose_id long, " + ", ".join(f"{n} double" for n in [*rot.NAMES, "tx", "ty", "tz"]))
    for r in register.refine(df, model, scene, register.IcpConfig(8, 0.01, 25.0, 1), 0.2).collect():
        assert np.allclose([r["tx"], r["ty"], r["tz"]], m[:3, 3], atol=0.02) and (r["error"] is None or r["error"] < 0.01)


def test_centre_and_adi(spark):
    truth = sphere(spark, 100)
    near, far = truth.withColumn("x", F.col("x") + 0.02), truth.withColumn("x", F.col("x") + 0.6)
    assert [evaluate.adi_and_centre(truth, f, 0.2, 0.1).first()["hit"] for f in (near, far)] == [True, False]


def test_features_by_numpy(spark):
    rng = np.random.default_rng(7)
    p, n = rng.standard_normal((2, 3)), rng.standard_normal((2, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    values = {f"{s}{k}{c}": float(a[i][j]) for i, s in enumerate("ab") for k, a in (("", p), ("n", n)) for j, c in enumerate("xyz")}
    got = one(spark, features.feature_exprs(v.vec("a"), v.vec("an"), v.vec("b"), v.vec("bn")), **values)
    d = p[1] - p[0]
    angle = lambda a, b: np.arccos(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert got == pytest.approx([np.linalg.norm(d), angle(n[0], d), angle(n[1], d), angle(n[0], n[1])])
    assert one(spark, [v.dist_so2("a", "b")], a=3.0, b=-3.0)[0] == pytest.approx(2 * np.pi - 6)
    q = [rng.standard_normal(4) for _ in range(2)]
    q = [x / np.linalg.norm(x) for x in q]
    named = {f"{s}{i}": float(x) for s, k in zip("ab", q) for i, x in enumerate(k)}
    sides = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(4)]
    assert one(spark, [v.angle_so3(*sides)], **named)[0] == pytest.approx(2 * np.arccos(abs(q[0] @ q[1])))
    assert one(spark, [v.dist_so3(*sides)], **named)[0] == pytest.approx(((q[0] - q[1]) ** 2).sum())


def one(spark, exprs, **values):
    row = spark.range(1).selectExpr(*[f"cast({x!r} AS double) AS {k}" for k, x in values.items()])
    return [float(x) for x in row.selectExpr(*exprs).first()]


def rotation(seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((3, 3)))
    return q * np.sign(np.linalg.det(q))


@pytest.mark.parametrize("seed", range(6))
def test_quaternion_round_trip(spark, seed):
    r = rotation(seed)
    named = dict(zip(rot.NAMES, r.ravel().tolist(), strict=True))
    q = one(spark, rot.to_quat(rot.NAMES), **named)
    assert np.linalg.norm(q) == pytest.approx(1)
    back = one(spark, rot.quat(("qw", "qx", "qy", "qz")), **dict(zip(("qw", "qx", "qy", "qz"), q, strict=True)))
    assert np.allclose(np.reshape(back, (3, 3)), r)
    angle, *axis = one(spark, [rot.angle(rot.NAMES), *rot.to_axis(rot.NAMES)], **named)
    again = one(spark, rot.axis_angle(v.vec("a"), "t"), t=angle, **dict(zip(("ax", "ay", "az"), axis, strict=True)))
    assert np.allclose(np.reshape(again, (3, 3)), r)


@pytest.mark.parametrize("n", [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0.6, -0.64, 0.48)])
def test_frame_takes_normal_to_x(spark, n):
    r = np.reshape(one(spark, rot.to_x(v.vec("n")), nx=n[0], ny=n[1], nz=n[2]), (3, 3))
    assert np.allclose(r @ n, [1, 0, 0]) and np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) == pytest.approx(1)


def sphere(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.standard_normal((n, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    stretched = p * [1.0, 0.7, 0.5]
    normal = p / [1.0, 0.7, 0.5]
    normal /= np.linalg.norm(normal, axis=1, keepdims=True)
    rows = [(i, 0, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(stretched, normal, strict=True))]
    return spark.createDataFrame(rows, "pt_id long, obj int, x double, y double, z double, nx double, ny double, nz double")


def test_icp_takes_a_copy_back(spark):
    dst = sphere(spark)
    m = np.eye(4)
    m[:3, 3] = [0.01, -0.02, 0.015]
    c, s = np.cos(0.05), np.sin(0.05)
    m[:3, :3] = [[c, -s, 0], [s, c, 0], [0, 0, 1]]
    src = register.moved(dst, m)
    pose, error = register.icp(src, dst, register.IcpConfig(20, 0.01, 25.0, 1), radius=0.2)
    assert error < 1e-2 and np.allclose(pose @ m, np.eye(4), atol=0.03)
    assert np.allclose(register.sparse_icp(src, dst, 0.2, outer=4) @ m, np.eye(4), atol=0.06)


def test_rigid_fit_without_reflection(spark):
    r, t = rotation(3), np.array([5.0, -3.0, 2.0])
    p = np.random.default_rng(1).standard_normal((20, 3)) + 4
    rows = [(0, *map(float, a), *map(float, b)) for a, b in zip(p, p @ r.T + t, strict=True)]
    df = spark.createDataFrame(rows, "obj int, px double, py double, pz double, qx double, qy double, qz double")
    m = register.solve_rigid(register.cross_covariance(df, "obj").first().asDict())
    assert np.allclose(m[:3, :3], r, atol=1e-6) and np.allclose(m[:3, 3], t, atol=1e-5)


def test_normals_of_a_plane(spark):
    rows = [(i, 0, float(i % 10), float(i // 10), 0.25 * (i % 10), 0.0, 0.0, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "pt_id long, obj int, x double, y double, z double, nx double, ny double, nz double")
    got = cleaning.normals(df, 9, 1.5).select("nx", "ny", "nz").collect()
    want = np.array([-0.25, 0, 1]) / np.linalg.norm([-0.25, 0, 1])
    assert all(np.allclose([r["nx"], r["ny"], r["nz"]], want, atol=1e-6) for r in got)
    noisy = df.unionByName(df.limit(5).withColumns({"z": F.lit(50.0), "pt_id": F.col("pt_id") + 1000}))
    assert cleaning.subtract_plane(noisy, 0.01).select("pt_id").count() == 5


def test_poisson_disk_is_greedy_and_maximal(spark):
    df = sphere(spark, 300)
    got = {r["pt_id"] for r in cleaning.poisson_disk(df, 0.2).collect()}
    p = {r["pt_id"]: np.array([r["x"], r["y"], r["z"]]) for r in df.collect()}
    want = []
    for i in sorted(p):
        if all(np.linalg.norm(p[i] - p[j]) >= 0.2 for j in want):
            want.append(i)
    assert got == set(want)
    targets = {r["pt_id"]: r["target"] for r in cleaning.merge_close(df, 0.2).collect()}
    assert set(targets.values()) <= got and all(targets[i] == i for i in got)


def test_matching_finds_the_motion(spark):
    cfg = features.MatchConfig(distance_step=0.1, angle_step=0.2, pair_distance=3.0, scene_step=3)
    model = sphere(spark, 150, seed=4)
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = rotation(5), [0.3, 0.2, -0.1]
    scene = register.moved(model, m).withColumn("obj", F.lit(1))
    h = features.match(scene, model, cfg).orderBy(F.desc("votes")).first()
    got = np.array([h[n] for n in rot.NAMES]).reshape(3, 3)
    # An ellipsoid looks alike after half turns about its axes.
    turns = [np.diag(d) for d in ([1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1])]
    assert min(np.linalg.norm(got - m[:3, :3] @ t) for t in turns) < 0.6
    q = features.hypotheses(features.best_votes(features.votes(features.pairs(scene, cfg, scene.where("pt_id % 3 = 0")), features.train(model, cfg), cfg)), scene, model, cfg)
    q = q.selectExpr("cast(scene AS bigint) AS scene", "s_i AS pose_id", "cast(votes AS double) AS votes", *rot.NAMES, "tx", "ty", "tz")
    best = poses.cluster(q, 0.2, 0.5).orderBy(F.desc("votes")).first()
    assert best["n"] > 1


def test_stream_matches_batch(spark):
    cfg, out = catalogue.CFG, tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    pts = views.points(spark, SF)
    scene, model = pts.where("obj IN (0, 1)"), pts.where("obj = 2")
    scene.write.parquet(f"{out}/in")
    stream = spark.readStream.schema(scene.schema).parquet(f"{out}/in")
    match_stream.match_stream(stream, model, cfg, f"{out}/out", f"{out}/checkpoint").awaitTermination()
    cols = ["scene", "s_i", "m_i", "votes"]
    got = spark.read.parquet(f"{out}/out").select(*cols).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, features.match(scene, model, cfg).select(*cols).collect()))


@pytest.mark.parametrize("encoding", list(ply.ORDERS))
def test_ply_round_trip(spark, encoding):
    spark.dataSource.register(ply.PlySource)
    out = tempfile.mkdtemp(prefix="spark-ply-", dir="/tmp")
    cloud = sphere(spark, 50).repartition(2)
    cloud.select(*ply.COLUMNS).write.format("ply").option("encoding", encoding).mode("overwrite").save(out)
    got = spark.read.format("ply").load(out).select(*ply.COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, cloud.select(*ply.COLUMNS).collect()))
    again = ply.read(spark, out).select(*ply.COLUMNS).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    tips = ply.normal_tips(cloud)
    assert tips.count() == 100
    tips.coalesce(1).write.format("ply").option("encoding", encoding).mode("overwrite").save(f"{out}/tips")
    with open(next(os.path.join(f"{out}/tips", f) for f in os.listdir(f"{out}/tips") if f.endswith(".ply")), "rb") as f:
        red = ply.vertices(f.read())["red"]
    assert sorted(red) == [0] * 50 + [255] * 50


def test_ply_headers():
    for bad in (b"plx\nend_header\n", b"ply\nformat ascii 1.0\nelement vertex 1\nproperty half x\nend_header\n1\n", b"ply\nelement vertex 1\nend_header\n"):
        with pytest.raises(ply.PlyError):
            ply.header(bad)
    short = ply.encoded(np.ones((3, 6)), "binary_big_endian")[:-8]
    with pytest.raises(ply.PlyError):
        ply.vertices(short)
    faces = b"ply\nformat binary_little_endian 1.0\nelement face 1\nproperty list uchar int vertex_indices\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    got = ply.vertices(faces + b"\x03" + np.array([0, 0, 0], "<i4").tobytes() + np.array([1, 2, 3], "<f4").tobytes())
    assert [got[c][0] for c in "xyz"] == [1, 2, 3]


def test_pose_files(spark):
    out = tempfile.mkdtemp(prefix="spark-pose-", dir="/tmp")
    p = posefile.pack(0.5, 7, 1, list(map(float, range(16))), [1.0, 2.0, 3.0], [1.0, 0.0, 0.0, 0.0], 0.25)
    with open(os.path.join(out, "a.bin"), "wb") as f:
        f.write(p + posefile.pack_cluster(3, 14, [p, p]))
    got = posefile.read(spark, out).collect()
    assert [(r["cluster_id"], r["num_votes"], r["angle"], r["t"]) for r in got] == [(None, 7, 0.5, [1.0, 2.0, 3.0]), (3, 7, 0.5, [1.0, 2.0, 3.0]), (3, 7, 0.5, [1.0, 2.0, 3.0])]
    assert posefile.write(posefile.read(spark, out).coalesce(1), f"file://{out}/again") == 3
    cols = ["cluster_id", "cluster_votes", "pose_id", "angle", "num_votes", "model_index", "pose", "t", "q", "residual"]
    both = [sorted(map(str, posefile.read(spark, p).select(*cols).collect())) for p in (f"{out}/a.bin", f"{out}/again")]
    assert both[0] == both[1]


def test_result_maps(spark):
    out = tempfile.mkdtemp(prefix="spark-map-", dir="/tmp")
    for kind, value in (("numbers", {"a": [1.0, 2.0], "b": []}), ("strings", {"a": ["x"]}), ("number", {"a": 1.5})):
        maps.write(maps.to_rows(spark, value, kind), f"{out}/{kind}")
        assert {r["key"]: r["value"] for r in maps.read(spark, f"{out}/{kind}", kind).collect()} == value


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_uniform_sample_and_noise(spark):
    df = sphere(spark, 100)
    assert [r["pt_id"] for r in clouds.sample_uniform(df, 7).orderBy("pt_id").collect()] == list(range(0, 100, 7))
    moved = clouds.add_noise(df, 0.1, 3).join(df.selectExpr("pt_id", "x AS x0"), "pt_id").selectExpr("max(abs(x - x0)) AS m", "min(x - x0) AS lo").first()
    assert 0.03 < moved["m"] <= 0.05 and moved["lo"] < 0
