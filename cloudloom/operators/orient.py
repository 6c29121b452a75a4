"""Normals of one orientation, along a minimum spanning forest of the neighbour graph.

Borůvka's rounds join components of points along their lightest outgoing edges, all
components at once. Every point carries its component and a sign against it; an
edge between turned normals turns the sign, so a merge only multiplies signs and no
tree is walked. Edges are ordered by weight and ends, so the forest is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as v
from ..session import stored
from .neighbors import knn


def spanning_forest(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, w) of the minimum spanning forest, and (id, root, sign): each node's component and its sign against the root.

    nodes: id. edges: a < b, w (not null), turn (1 or -1), one row a pair. Components have at least doubled after each
    round, so there are at most log2(nodes) rounds; within a round, chains of merges are shortened by doubling.
    """
    at = stored(nodes.select("id", F.col("id").alias("root"), F.lit(1).alias("sign")))
    left, tree = stored(edges.select("a", "b", "w", "turn")), []
    while True:
        side = lambda x: at.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"), F.col("sign").alias(f"s{x}"))
        cut = left.join(side("a"), "a").join(side("b"), "b").where("ra <> rb")
        cut = stored(cut.withColumn("flip", F.expr("turn * sa * sb")).select("a", "b", "w", "turn", "ra", "rb", "flip"))
        if cut.isEmpty():
            break
        # Edges inside a component never come back.
        left = cut.select("a", "b", "w", "turn")
        both = cut.select("a", "b", "w", F.col("ra").alias("root"), F.col("rb").alias("to"), "flip").unionByName(cut.select("a", "b", "w", F.col("rb").alias("root"), F.col("ra").alias("to"), "flip"))
        best = stored(both.groupBy("root").agg(F.min(F.struct("w", "a", "b", "to", "flip")).alias("e")).select("root", "e.*"))
        tree.append(best.select("a", "b", "w").distinct())
        # Two components that chose the same edge: the smaller one is the root. No longer circle has a lightest edge.
        back = best.select(F.col("root").alias("to"), F.col("to").alias("root2"))
        hop = best.join(back, "to", "left").select("root", F.expr("IF(root2 = root AND root < to, root, to)").alias("to"), F.expr("IF(root2 = root AND root < to, 1, flip)").alias("flip"))
        hop = stored(hop)
        while not (further := _doubled(hop)).where("more").isEmpty():
            # Two doublings a table.
            hop = stored(_doubled(further.drop("more")).drop("more"))
        at = stored(at.join(hop, "root", "left").selectExpr("id", "coalesce(to, root) AS root", "sign * coalesce(flip, 1) AS sign"))
    if not tree:
        return edges.select("a", "b", "w").limit(0), at
    out = tree[0]
    for t in tree[1:]:
        out = out.unionByName(t)
    return out, at


def _doubled(hop: DataFrame) -> DataFrame:
    """root, to, flip: each hop (to, flip) followed by that of its goal; `more` where that went on."""
    far = hop.select(F.col("root").alias("to"), F.col("to").alias("to2"), F.col("flip").alias("flip2"))
    return hop.join(far, "to").selectExpr("root", "to2 AS to", "IF(to2 = to, flip, flip * flip2) AS flip", "to2 <> to AS more")


def neighbour_edges(cloud: DataFrame, k: int, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """a < b (structs of key and id), w = 1 - |n . n'|, turn: pairs of which one is among the other's k nearest."""
    near = knn(cloud, cloud, k, radius, key, point)
    here, there = F.struct(F.col(f"q_{key}").alias("key"), F.col(f"q_{point}").alias("id")), F.struct(F.col(key).alias("key"), F.col(point).alias("id"))
    dot = F.expr(f"round({v.dot(v.vec('q_n'), v.vec('n'))}, 12)")
    pairs = near.select(F.least(here, there).alias("a"), F.greatest(here, there).alias("b"), dot.alias("dot")).dropDuplicates(["a", "b"])
    return pairs.select("a", "b", (1 - F.abs("dot")).alias("w"), F.when(F.col("dot") < 0, -1).otherwise(1).alias("turn"))


def orient_normals(cloud: DataFrame, k: int, radius: float, key: str = "obj", point: str = "pt_id") -> DataFrame:
    """The cloud with normals turned so that neighbours agree along the lightest paths.

    In each connected part of the neighbour graph the highest point (greatest z, then smallest id) gets a normal that
    doesn't look down. Points without a normal keep none and join nothing.
    """
    # Computed normals first: as plain columns they aren't repeated in the plan by every filter and step below.
    cloud = stored(cloud)
    have = cloud.where("nx IS NOT NULL AND ny IS NOT NULL AND nz IS NOT NULL")
    node = F.struct(F.col(key).alias("key"), F.col(point).alias("id"))
    _, at = spanning_forest(have.select(node.alias("id")), neighbour_edges(have, k, radius, key, point))
    rows = have.select(node.alias("id"), "z", "nz").join(at, "id")
    top = rows.groupBy("root").agg(F.min(F.struct((-F.col("z")).alias("z"), "id", (F.col("sign") * F.col("nz")).alias("up"))).alias("t"))
    turned = at.join(top.select("root", F.when(F.col("t.up") < 0, -1).otherwise(1).alias("side")), "root")
    signs = turned.select(F.col("id.key").alias(key), F.col("id.id").alias(point), (F.col("sign") * F.col("side")).alias("_sign"))
    out = cloud.join(signs, [key, point], "left")
    return out.withColumns({c: F.col(c) * F.coalesce("_sign", F.lit(1)) for c in ("nx", "ny", "nz")}).select(*cloud.columns)
