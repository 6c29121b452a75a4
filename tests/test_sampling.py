"""Samples by weight and by area, against plain loops and their rates."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cloudloom.operators import mesh, ranks, sampling


def uniform(seed, *parts):
    return (int(hashlib.md5("-".join(map(str, (seed, *parts))).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def test_weighted_sample(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 20)
    rows = [(o, i, float((i * 7 + o) % 11)) for o in range(3) for i in range(300 if o else 2500)] + [(5, 0, 1.0), (5, 1, 2.0)]
    odd = [(1, 900, None), (1, 901, -2.0), (1, 902, float("nan")), (1, 903, float("inf")), (6, 0, 0.0), (None, 4, 2.0)]
    cloud = spark.createDataFrame(rows + odd, "obj long, pt_id long, weight double")
    want = {(None, 4)}
    for o in {r[0] for r in rows}:
        keys = sorted((-math.log(uniform(3, o, i)) / x, i) for q, i, x in rows if q == o and x > 0)
        want |= {(o, i) for _, i in keys[:40]}
    for parts in (1, 7):
        got = sampling.weighted(cloud.repartition(parts), 40, "weight", 3).collect()
        assert len(got) == len(want) and {(r["obj"], r["pt_id"]) for r in got} == want
    assert sampling.weighted(cloud.limit(0), 40, "weight", 3).count() == 0


def test_weighted_sample_of_repeated_rows(spark):
    cloud = spark.createDataFrame([(1, 1, 1.0)] * 30, "obj long, pt_id long, weight double")
    assert sampling.weighted(cloud, 12, "weight", 3).count() == 12


def test_weighted_rates(spark):
    """One draw from each of 6,000 clouds with weights 1 to 4."""
    cloud = spark.range(24000).selectExpr("id div 4 AS obj", "id % 4 AS pt_id")
    got = Counter(r["pt_id"] for r in sampling.weighted(cloud, 1, "pt_id + 1", 5).collect())
    for i in range(4):
        p = (i + 1) / 10
        assert abs(got[i] - 6000 * p) < 4 * math.sqrt(6000 * p * (1 - p))


@pytest.mark.parametrize("chunk", [1 << 16, 16])
def test_surface_sample(spark, monkeypatch, chunk):
    monkeypatch.setattr(sampling, "CHUNK", chunk)
    points = [(1, i, float(i * i % 17), float(i % 5), float(i % 3)) for i in range(30)] + [(2, i, 0.0, 0.0, float(i)) for i in range(3)]
    points += [(3, 0, 0.0, 0.0, 0.0), (3, 1, 1000.0, 0.0, 0.0), (3, 2, 0.0, 1000.0, 0.0), (3, 3, 1e-3, 0.0, 0.0), (3, 4, 0.0, 1e-3, 0.0)]
    cloud = spark.createDataFrame(points, "obj long, pt_id long, x double, y double, z double")
    faces = mesh.strip(cloud.where("obj < 3")).select("obj", "face", "a", "b", "c")
    faces = faces.unionByName(spark.createDataFrame([(3, 0, 0, 1, 2), (3, 5000, 0, 3, 4)], faces.schema)).repartition(5)
    n = 4000
    got = sampling.surface(faces, cloud, n, 9).collect()
    at = {(o, i): (x, y, z) for o, i, x, y, z in points}
    area, order = {}, {}
    for r in sorted(faces.collect(), key=lambda r: (r["obj"], r["face"])):
        a, b, c = (at[r["obj"], r[k]] for k in "abc")
        u, w = ([q - p for p, q in zip(a, k, strict=True)] for k in (b, c))
        cross = (u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0])
        size = math.floor(math.hypot(*cross) / 2 * 1e9 + 0.5)
        if size:
            area[r["obj"], r["face"]] = (size, a, u, w, cross)
            order.setdefault(r["obj"], []).append(r["face"])
    # No area, no samples; else each sample once, on the face whose part of the area holds its place.
    assert set(order) == {1, 3} and {(r["obj"], r["sample"]) for r in got} == {(o, i) for o in order for i in range(n)} and len(got) == 2 * n
    for r in got:
        o = r["obj"]
        left = math.floor(uniform(9, o, r["sample"]) * sum(area[o, f][0] for f in order[o]))
        for f in order[o]:
            if left < area[o, f][0]:
                break
            left -= area[o, f][0]
        assert f == r["face"]
        _, a, u, w, cross = area[o, f]
        d = [x - y for x, y in zip((r["x"], r["y"], r["z"]), a, strict=True)]
        assert abs(sum(x * y for x, y in zip(d, cross, strict=True))) < 1e-6 * max(1, math.hypot(*cross)) ** 1.5
    counts, total = Counter(r["face"] for r in got if r["obj"] == 1), sum(area[1, f][0] for f in order[1])
    for f in order[1]:
        p = area[1, f][0] / total
        assert abs(counts[f] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1
    assert sampling.surface(faces.limit(0), cloud, n, 9).count() == 0
