"""Point clouds, poses and results as views of the input tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import rot
from ..functions import vec as v
from ..session import table


def nest(base: str, steps: list[list[str]]) -> str:
    """The select lists as nested SQL over a table name."""
    out = f"SELECT {', '.join(steps[0])} FROM {base}"
    for step in steps[1:]:
        out = f"SELECT {', '.join(step)} FROM ({out}) AS t"
    return out


def _unit(names: list[str]) -> list[str]:
    n = "nullif(sqrt(" + " + ".join(f"{a} * {a}" for a in names) + "), 0)"
    return [f"{a} / {n}" for a in names]


_NORMAL = [f"{e} AS n{a}" for a, e in zip("xyz", _unit(["e3", "e4", "e5"]), strict=True)]
_QUAT = [f"{e} AS q{a}" for a, e in zip("wxyz", _unit(["e6", "e7", "e8", "e9"]), strict=True)]
POINTS = ["pt_id", "obj", "e0 AS x", "e1 AS y", "e2 AS z", *_NORMAL]
POSES = [["pose_id", "scene", "votes", *_QUAT, "e10 AS tx", "e11 AS ty", "e12 AS tz"], ["*", *rot.aliased(rot.quat(("qw", "qx", "qy", "qz")))]]


def _components(first: int) -> list[str]:
    return [f"cast(embedding[{i + first}] AS double) AS e{i}" for i in range(13)]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as oriented points: obj is the label, normals are the unit vector of components 4 to 6."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS pt_id", "label AS obj", *_components(0)).selectExpr(*POINTS)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as poses: components 7 to 10 are the quaternion, 11 to 13 the translation."""
    base = ["vec_id AS pose_id", "cast(label AS bigint) AS scene", "1e0 + vec_id % 7 AS votes"]
    df = table(spark, sf_dir, "embeddings").selectExpr(*base, *_components(0))
    for step in POSES:
        df = df.selectExpr(*step)
    return df


DENSE = [
    "l_orderkey * 8 + l_linenumber AS pt_id", "l_linenumber AS obj", "l_quantity AS x", "l_extendedprice / 1000 AS y", "l_discount * 100 AS z",
]


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points: quantity, price in thousands, discount in percent; obj is the line number."""
    return table(spark, sf_dir, "lineitem").selectExpr(*DENSE)


RESULTS = ["concat(cast(user_id AS string), '-', event_type) AS key", "event_type AS object", "user_id", "value"]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as recognition results: object is the event type."""
    return table(spark, sf_dir, "events").selectExpr(*RESULTS)


CTE = {
    "pts": f"pts AS (SELECT {', '.join(POINTS)} FROM (SELECT vec_id AS pt_id, label AS obj, {', '.join(_components(1))} FROM embeddings) AS e)",
    "poses": "poses AS (" + nest(f"(SELECT vec_id AS pose_id, cast(label AS bigint) AS scene, 1e0 + vec_id % 7 AS votes, {', '.join(_components(1))} FROM embeddings) AS e", POSES) + ")",
    "dense": f"dense AS (SELECT {', '.join(DENSE)} FROM lineitem)",
    "results": f"results AS (SELECT {', '.join(RESULTS)} FROM events)".replace("AS string", "AS varchar"),
}


def near(radius: float, cloud: str = "pts", refs: str | None = None, strict: bool = True, name: str = "near", where: str = "true") -> str:
    """SQL of neighbors.radius_join on (obj, pt_id, x, y, z, nx, ny, nz)."""
    cols = ["obj", "pt_id", "x", "y", "z", "nx", "ny", "nz"]
    if cloud == "dense":
        cols = cols[:5]
    d2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"
    q, p = ", ".join(f"q.{c} AS q_{c}" for c in cols), ", ".join(f"p.{c} AS {c}" for c in cols)
    sign = "<" if strict else "<="
    return f"{name} AS (SELECT {q}, {p}, {d2} AS d2 FROM {cloud} q JOIN {refs or cloud} p ON q.obj = p.obj WHERE {d2} {sign} cast({radius * radius!r} AS double) AND {where})"


def knn(k: int, cloud: str = "pts", refs: str | None = None, include_self: bool = False, name: str = "nn") -> str:
    """SQL of neighbors.knn, by ranking all pairs."""
    who = "true" if include_self else "q.pt_id <> p.pt_id"
    pairs = near(1e9, cloud, refs, where=who, name="allp")
    inner = pairs.removeprefix("allp AS (").removesuffix(")")
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_obj, q_pt_id ORDER BY d2, pt_id) AS rank FROM ({inner}) AS a) AS b WHERE rank <= {k})"


def greedy(cloud: str, key: str, point: str, order: str, conflicts: str) -> list[str]:
    """SQL of cleaning.greedy, one row of `cloud` after the other in this order: kp holds key and point of what is kept.

    `conflicts` is a relation of pairs (key, a, b) of points that exclude each other.
    """
    return [
        f"ord AS (SELECT {key}, {point}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {cloud})",
        f"conf AS (SELECT o.{key}, o.k, list(p.k) AS l FROM {conflicts} c JOIN ord o ON o.{key} = c.{key} AND o.{point} = c.a JOIN ord p ON p.{key} = c.{key} AND p.{point} = c.b WHERE p.k < o.k GROUP BY 1, 2)",
        f"""gr AS (SELECT DISTINCT {key}, 0::BIGINT AS k, []::BIGINT[] AS kept FROM ord UNION ALL
        SELECT g.{key}, g.k + 1, CASE WHEN list_has_any(coalesce(c.l, []), g.kept) THEN g.kept ELSE list_append(g.kept, g.k + 1) END
        FROM gr g JOIN ord o ON o.{key} = g.{key} AND o.k = g.k + 1 LEFT JOIN conf c ON c.{key} = g.{key} AND c.k = g.k + 1)""",
        f"kp AS (SELECT f.{key}, o.{point} FROM (SELECT {key}, unnest(max_by(kept, k)) AS k FROM gr GROUP BY {key}) f JOIN ord o USING ({key}, k))",
    ]


def recursive(cte: str) -> str:
    return "RECURSIVE " + CTE[cte]


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(CTE.get(p, p) for p in parts) + "\n" + select


def rounded(names: str, digits: int = 6) -> list[str]:
    return [f"round({n}, {digits}) AS {n}" for n in names.split()]


__all__ = ["CTE", "dense", "knn", "near", "nest", "points", "poses", "results", "rounded", "v", "with_"]
