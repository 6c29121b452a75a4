"""Work that grows with the points, not with their pairs: results against brute force, and rows of joins counted."""

from collections import Counter

import numpy as np
import pytest

from cloudloom.functions import rot
from cloudloom.operators import cleaning, evaluate, features, neighbors, orient, poses, spheres

CLOUD = "obj int, pt_id long, x double, y double, z double, nx double, ny double, nz double"


def crowd(spark, n, seed=1, copies=0, spread=0.1, labels=2):
    """n points in `labels` clouds, the first `copies` of each cloud at one place."""
    rng = np.random.default_rng(seed)
    at, up = rng.standard_normal((n, 3)) * spread, rng.standard_normal((n, 3))
    at[: labels * copies] = at[0]
    up /= np.linalg.norm(up, axis=1, keepdims=True)
    return spark.createDataFrame([(i % labels, i, *map(float, at[i]), *map(float, up[i])) for i in range(n)], CLOUD)


def placed_rows(df):
    rows = df.collect()
    return np.array([r["obj"] for r in rows]), np.array([r["pt_id"] for r in rows]), np.array([[r["x"], r["y"], r["z"]] for r in rows])


@pytest.fixture
def met(monkeypatch):
    """Rows that radius_join gives, call by call."""
    seen, join = [], neighbors.radius_join

    def counted(*a, **b):
        out = join(*a, **b)
        seen.append(out.count())
        return out

    for module in (neighbors, cleaning, poses):
        monkeypatch.setattr(module, "radius_join", counted)
    return seen


@pytest.mark.parametrize("copies", [0, 200])
def test_knn_of_crowded_clouds(spark, met, copies):
    df, k = crowd(spark, 1600, copies=copies), 5
    got = {(r["q_pt_id"], r["rank"]): r["pt_id"] for r in neighbors.knn(df, df, k, 5.0).collect()}
    obj, ids, at = placed_rows(df)
    d2 = ((at[:, None] - at[None]) ** 2).sum(-1)
    d2[obj[:, None] != obj[None]] = np.inf
    np.fill_diagonal(d2, np.inf)
    order = np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :k]
    assert got == {(int(ids[i]), j + 1): int(ids[order[i, j]]) for i in range(len(ids)) for j in range(k)}
    # 640,000 pairs lie within the radius given.
    assert sum(met) < 80 * len(ids)


def test_spheres_in_crowded_columns(spark, monkeypatch):
    """Counts on borders, in crowded places and with blocks split, and nothing joined pair by pair."""
    rng = np.random.default_rng(3)
    at = np.floor(rng.uniform(-6, 6, (1500, 3)) * 2) / 2
    at[:500, 1] = rng.uniform(-1, 1, 500)
    at[500:700] = at[500]
    rows = [(i % 2, i // 3, *map(float, p)) for i, p in enumerate(at)] + [(0, 9000, float("nan"), 0.0, 0.0), (0, 9001, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "obj int, pt_id long, x double, y double, z double")
    monkeypatch.setattr(neighbors, "radius_join", None)
    monkeypatch.setattr(spheres, "MOST", 300)
    got = {(r["obj"], r["pt_id"]): r["n"] for r in spheres.count_in_sphere(df, df, 1.5).collect()}
    d2 = ((at[:, None] - at[None]) ** 2).sum(-1)
    want = {}
    for i in range(len(at)):
        n = int((d2[i, i % 2 :: 2] <= 2.25).sum())
        want[i % 2, i // 3] = want.get((i % 2, i // 3), 0) + n
    assert got == want
    for held in (1 << 20, 64):
        monkeypatch.setattr(spheres, "HELD", held)
        assert (spheres.counted(at, at, 1.5) == (d2 <= 2.25).sum(1)).all()


def crowded_poses(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
        rows.append((i % 2, i, float(1 + i % 7), *map(float, (q * np.sign(np.linalg.det(q))).ravel()), *map(float, rng.standard_normal(3) * 0.1)))
    return rows, spark.createDataFrame(rows, poses.POSE)


def greedily(rows, near):
    kept = []
    for p in sorted(rows, key=lambda p: (-p[2], p[1])):
        if not any(k[0] == p[0] and near(k, p) for k in kept):
            kept.append(p)
    return {p[1] for p in kept}


def test_centres_of_crowded_poses(spark, met, monkeypatch):
    """batches of the order give the greedy choice; 2 * 300 * 299 / 2 pairs lie in one scene before."""
    monkeypatch.setattr(cleaning, "BATCH", 16)
    rows, df = crowded_poses(spark, 600)
    got = {r["pose_id"] for r in poses.nms_centre(df, 0.2).collect()}
    assert got == greedily(rows, lambda a, b: sum((x - y) ** 2 for x, y in zip(a[-3:], b[-3:], strict=True)) < 0.2 * 0.2)
    assert sum(met) < 600 * 20


def test_clusters_of_crowded_poses(spark, met, monkeypatch):
    """poses meet seeds, not one another."""
    monkeypatch.setattr(cleaning, "BATCH", 16)
    rows, df = crowded_poses(spark, 600)
    got = {r["pose_id"]: (r["n"], r["votes"]) for r in poses.cluster(df, 0.2, None).collect()}
    near = lambda a, b: sum((x - y) ** 2 for x, y in zip(a[-3:], b[-3:], strict=True)) < 0.2 * 0.2
    seeds = sorted((p for p in rows if p[1] in greedily(rows, near)), key=lambda p: (-p[2], p[1]))
    want = {}
    for p in rows:
        first = next(s for s in seeds if s[0] == p[0] and near(s, p))
        n, votes = want.get(first[1], (0, 0.0))
        want[first[1]] = n + 1, votes + p[2]
    assert got == want and sum(met) < 600 * 20


def test_votes_in_blocks(spark, monkeypatch):
    """every block counts its votes to the end; as best rows, few leave it."""
    cfg = features.MatchConfig(0.1, 0.5, 12, 0.3, 2)
    df = crowd(spark, 80).selectExpr("obj", "pt_id", "x", "y", "z", *[f"IF(pt_id = 7, null, n{c}) AS n{c}" for c in "xyz"])
    pairs = features.pairs(df, cfg).cache()
    turn = lambda r: None if r["alpha"] is None else int(np.floor(round(r["alpha"] + np.pi, 9) / (2 * np.pi / 12)))
    by = lambda x, r: None if turn(x) is None or turn(r) is None else (turn(x) - turn(r)) % 12
    buckets, want = {}, Counter()
    rows = [r for r in pairs.collect() if None not in [r[k] for k in features.KEYS]]
    for r in rows:
        buckets.setdefault(tuple(r[k] for k in features.KEYS), []).append(r)
    for r in rows:
        for x in buckets[tuple(r[k] for k in features.KEYS)]:
            want[r["obj"], x["obj"], r["i"], x["i"], by(x, r)] += 1
    for name, small in (("SCENE_PAIRS", 300), ("MODEL_PAIRS", 500), ("BATCH", 40)):
        monkeypatch.setattr(features, name, small)
    index = pairs.withColumnRenamed("obj", "model")
    got = features.votes(pairs, index, cfg).collect()
    assert {tuple(r)[:5]: r["votes"] for r in got} == want and len(got) == len(want)
    few = features.votes(pairs, index, cfg, best=True)
    assert few.count() < len(want) / 5
    top = {}
    for (s, m, i, j, b), n in want.items():
        top[s, m, i] = max(top.get((s, m, i), (0, 0, 0)), (n, -j, -12 if b is None else -b))
    assert {tuple(r)[:3]: (r["votes"], -r["m_i"], -12 if r["bin"] is None else -r["bin"]) for r in features.best_votes(few).collect()} == top
    assert any(b is None for *_, b in want)


@pytest.mark.parametrize("spread", [0.04, 0.25])
def test_parts_of_crowded_clouds(spark, met, spread):
    """dense clouds are joined by cells; 500,000 pairs lie within the radius in the denser ones."""
    df = crowd(spark, 1000, spread=spread)
    obj, ids, at = placed_rows(df)
    near = (((at[:, None] - at[None]) ** 2).sum(-1) < 0.01) & (obj[:, None] == obj[None])
    part = ids.copy()
    while (new := np.where(near, part[None], 10**6).min(1)).tolist() != part.tolist():
        part = new
    got = cleaning.connected_parts(df, 0.1).collect()
    assert sorted((r["pt_id"], r["part"]) for r in got) == sorted(zip(ids.tolist(), part.tolist(), strict=True))
    assert sum(met) < 10 * len(ids)


def test_boxes_of_crowded_poses(spark, met, monkeypatch):
    """boxes of poses, in batches of the order as all at once."""
    rows, df = crowded_poses(spark, 300)
    half = np.array([0.1, 0.2, 0.1])

    def overlap(a, b):
        (ra, ta), (rb, tb) = ((np.abs(np.reshape(p[3:12], (3, 3))) @ half, np.array(p[12:])) for p in (a, b))
        common = np.prod(np.maximum(0, np.minimum(ta + ra, tb + rb) - np.maximum(ta - ra, tb - rb)))
        return common > 0.2 * (np.prod(2 * ra) + np.prod(2 * rb) - common)

    monkeypatch.setattr(cleaning, "BATCH", 16)
    assert {r["pose_id"] for r in poses.nms_boxes(df, tuple(half), 0.2).collect()} == greedily(rows, overlap)
    assert sum(met) < 300 * 40


STEPS = {
    "outliers": lambda df: cleaning.outlier_scores(df, 8, 5.0),
    "normals": lambda df: cleaning.normals(df, 6, 5.0),
    "smooth": lambda df: cleaning.smooth(df, "z", 6, 5.0),
    "adi": lambda df: evaluate.adi_error(df, df.withColumn("x", df["x"] + 0.01), 5.0),
}


@pytest.mark.parametrize("name", STEPS)
def test_steps_on_neighbours_of_crowded_clouds(spark, met, name):
    """F11 to F16: 320,000 pairs lie within the radius given."""
    assert STEPS[name](crowd(spark, 800)).count() == (2 if name == "adi" else 800)
    assert sum(met) < 80 * 800


def test_normals_turned_in_crowded_clouds(spark, met):
    """the search of neighbours for the forest's edges."""
    assert orient.neighbour_edges(crowd(spark, 800), 8, 5.0).count() >= 8 * 800 / 2
    assert sum(met) < 100 * 800
