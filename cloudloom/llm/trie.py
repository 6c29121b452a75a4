"""Prefix trie of conversations from sorted sequences, by range minima of their longest common prefixes.

Every conversation becomes a sequence of turn tokens (a 128-bit hash of role and
text, and the text's length). Sequences are cut into blocks of BLOCK turns; a block
carries a hash of all turns before it, so blocks of one start form a small trie that
hangs below the node where the start ends, and no conversation is too long for a
row. Equal blocks are folded, and the rest are sorted over all tasks.

A task holds one range of the sorted blocks, their common prefixes with the block
before (LCPs) and a sparse table of range minima. The candidate prefixes of a block
are those longer than its LCP. Each searches the left and the right end of its
members by halving steps over the sparse table, on its own and without a stack;
its counts are then differences of running sums. Nodes that touch an end of the
range may go on in the next one; these few are added up by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_spread, mixed, partitions, written

BLOCK, TOKEN = 64, 20
#: Bytes of blocks that a task sorts and searches at a time; conv_ids that are joined to one text.
TASK_BYTES, CHUNK_IDS = 16 << 20, 10_000
_TURN = np.dtype([("lo", ">u8"), ("hi", ">u8"), ("chars", ">u4")])
_KEY = ["b", "s1", "s2"]
_SUMS = ["n", "ends", "kids", "leaves", "saved"]
NODE = "part int, b int, s1 long, s2 long, d int, id1 long, id2 long, p1 long, p2 long, open boolean, popen boolean, conv_id long, parent long, chars long, n long, ends long, kids long, leaves long, saved long, sha string, n1 long, n2 long, path binary"


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Row k holds the minima of 2^k values from each place on."""
    out = [values]
    while 2 << (len(out) - 1) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def left_ends(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First of the rows next to `row` that share `depth` turns with it; `table` is that of the LCPs with the row before."""
    at = row.copy()
    for k in range(len(table) - 1, -1, -1):
        low = at - (1 << k) + 1
        ok = low >= 0
        ok[ok] = table[k][low[ok]] >= depth[ok]
        at[ok] -= 1 << k
    return at


def right_ends(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Last of the rows next to `row` that share `depth` turns with it."""
    at = row.copy()
    for k in range(len(table) - 1, -1, -1):
        ok = at + 1 < len(table[k])
        ok[ok] = table[k][at[ok] + 1] >= depth[ok]
        at[ok] += 1 << k
    return at


def _nodes(part: int, rows: pd.DataFrame, block: int) -> Iterator[pd.DataFrame]:
    """The trie nodes of one sorted range of folded blocks (b, s1, s2, tokens, n, conv_id, ends, sha, n1, n2)."""
    size = rows["tokens"].map(len).to_numpy(np.int64) // TOKEN
    at = np.r_[0, np.cumsum(size)]
    turn = np.frombuffer(b"".join(rows["tokens"]), _TURN)
    lo, hi, chars = (turn[c].astype(t) for c, t in (("lo", np.uint64), ("hi", np.uint64), ("chars", np.int64)))
    b, s1, s2, n, conv, ends = (rows[c].to_numpy(np.int64) for c in (*_KEY, "n", "conv_id", "ends"))
    many = len(rows)
    # Hashes of all prefixes; those of a start alone first.
    top1, top2 = mixed(s1.view(np.uint64) + mixed(b.view(np.uint64)), 2), mixed(s2.view(np.uint64) + mixed(b.view(np.uint64)), 3)
    id1, id2, now1, now2 = np.empty(len(lo), np.uint64), np.empty(len(lo), np.uint64), top1.copy(), top2.copy()
    same = np.r_[False, (b[1:] == b[:-1]) & (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])]
    lcp = np.where(same, 0, -1)
    alike = np.flatnonzero(same)
    for d in range(int(size.max(initial=0))):
        i = np.flatnonzero(size > d)
        id1[at[i] + d] = now1[i] = mixed(mixed(now1[i]) ^ lo[at[i] + d])
        id2[at[i] + d] = now2[i] = mixed(mixed(now2[i], 1) ^ hi[at[i] + d], 1)
        alike = alike[(size[alike] > d) & (size[alike - 1] > d)]
        x, y = at[alike] + d, at[alike - 1] + d
        alike = alike[(lo[x] == lo[y]) & (hi[x] == hi[y])]
        lcp[alike] += 1
    # Candidates in the order of a walk: by row, then by depth. A start alone is one of depth 0.
    first = np.r_[0, np.cumsum(size - lcp)]
    row = np.repeat(np.arange(many), size - lcp)
    depth = np.arange(first[-1]) - first[row] + lcp[row] + 1
    table = sparse_table(lcp)
    left, right = left_ends(table, row, depth), right_ends(table, row, depth)
    up = left_ends(table, row, depth - 1)
    parent = np.where(depth > 0, first[up] + depth - 2 - lcp[up], -1)
    is_open = (left == 0) | (right == many - 1)
    members = np.r_[0, np.cumsum(n)]
    count = members[right + 1] - members[left]
    least = sparse_table(conv)
    k = np.frexp((right - left + 1).astype(float))[1] - 1
    lowest = np.empty(len(row), np.int64)
    for j in range(len(least)):
        m = k == j
        lowest[m] = np.minimum(least[j][left[m]], least[j][right[m] - (1 << j) + 1])
    own = depth == size[row]
    stop = np.where(own, ends[row], 0)
    last = at[row] + depth - 1
    deep = depth > 0
    letters = np.zeros(len(row), np.int64)
    letters[deep] = chars[last[deep]]
    # What closed nodes add to those above them.
    below = first[right + 1]
    here = np.arange(len(row))
    total = lambda v: (s := np.r_[0, np.cumsum(np.where(is_open, 0, v))])[below] - s[here]
    leaves, saved = total(stop == count), total((count - 1) * letters)
    kids = np.bincount(parent[deep & ~is_open], minlength=len(row))
    hashes = []
    for ids, top in ((id1, top1), (id2, top2)):
        h = top[row]
        h[deep] = ids[last[deep]]
        hashes.append(h.view(np.int64))
    goes_on = own & (depth == block) & (stop < n[row])
    named = rows["sha"].to_numpy(object)
    n1, n2 = rows["n1"].to_numpy(np.int64), rows["n2"].to_numpy(np.int64)

    def path(q: int) -> bytes | None:
        """Hashes of the node and of all above it in its block, for the few nodes that need them."""
        if not (is_open[q] or goes_on[q]):
            return None
        i, d = row[q], depth[q]
        return np.stack([np.r_[top[i], ids[at[i] : at[i] + d]] for ids, top in ((id1, top1), (id2, top2))], 1).tobytes()

    for begin in range(0, len(row), 20_000):
        q = slice(begin, min(begin + 20_000, len(row)))
        r, p = row[q], parent[q]
        held = p >= 0
        yield pd.DataFrame({
            "part": part, "b": b[r], "s1": s1[r], "s2": s2[r], "d": depth[q], "id1": hashes[0][q], "id2": hashes[1][q],
            "p1": np.where(held, hashes[0][p], 0), "p2": np.where(held, hashes[1][p], 0), "open": is_open[q], "popen": held & is_open[p],
            "conv_id": lowest[q], "parent": np.where(held, lowest[p], 0), "chars": letters[q], "n": count[q], "ends": stop[q], "kids": kids[q],
            "leaves": leaves[q], "saved": saved[q], "sha": np.where(stop[q] > 0, named[r], None), "n1": np.where(goes_on[q], n1[r], 0), "n2": np.where(goes_on[q], n2[r], 0),
            "path": [path(x) for x in range(q.start, q.stop)],
        })


def ranked(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, r, token) with r from 0 in the order of turn (null first), role, text; and (conv_id, n_turns).

    The rows are sorted over all tasks, so a conversation may fill many of them; what stands before a task's first
    conversation is added afterwards.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    token = "unhex(concat(md5(concat(length(role), ':', role, text)), lpad(hex(length(text)), 8, '0')))"
    rows = turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order).selectExpr("conv_id", f"{token} AS token")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for x in batches:
            if not len(x):
                continue
            c = x["conv_id"].to_numpy()
            new = np.r_[c[0] != last, c[1:] != c[:-1]]
            r = np.arange(len(c)) - np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
            r[: int(new.argmax()) if new.any() else len(c)] += n
            last, n = c[-1], r[-1] + 1
            yield pd.DataFrame({"part": part, "conv_id": c, "r": r, "token": x["token"]})

    local = written(rows.mapInPandas(each, "part int, conv_id long, r long, token binary"), "trie-turns")
    sizes = local.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only the first conversation of a part has turns in earlier parts, so there are no more such rows than parts.
    carried = sizes.withColumn("before", before).where("before > 0").select("part", "conv_id", "before")
    out = local.join(F.broadcast(carried), ["part", "conv_id"], "left").selectExpr("conv_id", "r + coalesce(before, 0) AS r", "token")
    return out, sizes.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))


def rebuilt(turns: DataFrame, heads: int = 6, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, token, len): each conversation with its first h turns taken from conversation c - c % every,
    where h = crc32(decimal c) % heads; and (conv_id, len) of all, those without turns too."""
    rows, sizes = ranked(turns)
    rows, sizes = written(rows, "trie-ranks"), written(sizes, "trie-sizes")
    first = rows.where(F.expr(f"conv_id % {every} = 0 AND r < {heads - 1}")).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("r", "token"))).alias("first"))
    convs = sizes.selectExpr("conv_id", "n_turns", f"conv_id - conv_id % {every} AS base", f"cast(crc32(cast(cast(conv_id AS string) AS binary)) % {heads} AS int) AS h")
    convs = convs.join(first, "base", "left").selectExpr("conv_id", "h", "n_turns", "coalesce(slice(first.token, 1, h), array()) AS head")
    convs = written(convs.selectExpr("*", "size(head) + greatest(n_turns - h, 0) AS len"), "trie-convs")
    given = convs.select("conv_id", F.posexplode("head").alias("pos", "token"), "len")
    own = join_spread(rows, convs.selectExpr("conv_id", "h", "size(head) AS m", "len"), "conv_id", sizes=sizes.withColumnRenamed("n_turns", "n"))
    own = own.where("r >= h").selectExpr("conv_id", "cast(m + r - h AS long) AS pos", "token", "len")
    return given.select("conv_id", F.col("pos").cast("long"), "token", "len").unionByName(own), convs.select("conv_id", "len")


def blocks(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, b, s1, s2 (the hash of all blocks before), tokens (of at most `block` turns, joined), final.

    The hash of a start is the XOR of its blocks' numbered hashes. It is summed up in two levels of 64 blocks, so
    that no task holds a whole conversation's blocks but for one row in 4,096 of its turns.
    """
    cut = turns.groupBy("conv_id", F.expr(f"cast(pos div {block} AS int)").alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"), F.max("len").alias("len"))
    joined = F.aggregate("t", F.lit(b""), lambda acc, x: F.concat(acc, x["token"]))
    cut = cut.select("conv_id", "b", joined.alias("tokens"), (F.col("b") == F.expr(f"(len - 1) div {block}")).alias("final"))
    none = convs.where("len = 0").selectExpr("conv_id", "0 AS b", "X'' AS tokens", "true AS final")
    cut = written(cut.unionByName(none), "trie-blocks")
    full = cut.where("NOT final").selectExpr("conv_id", "b", "b div 64 AS w", "xxhash64(b, tokens) AS x1", "xxhash64(7, b, tokens) AS x2")
    inside = Window.partitionBy("conv_id", "w").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    wide = full.groupBy("conv_id", "w").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    wide = wide.select("conv_id", "w", *[F.coalesce(F.bit_xor(f"y{k}").over(before), F.lit(0)).alias(f"o{k}") for k in (1, 2)])
    sums = full.select("conv_id", "w", "b", *[F.bit_xor(f"x{k}").over(inside).alias(f"c{k}") for k in (1, 2)]).join(wide, ["conv_id", "w"])
    starts = sums.select("conv_id", (F.col("b") + 1).alias("b"), *[F.col(f"c{k}").bitwiseXOR(F.col(f"o{k}")).alias(f"s{k}") for k in (1, 2)])
    zero = [F.lit(0).cast("long").alias(s) for s in ("s1", "s2")]
    return cut.where("b = 0").select("*", *zero).unionByName(cut.where("b > 0").join(starts, ["conv_id", "b"]).select(*cut.columns, "s1", "s2"))


def id_hashes(rows: DataFrame) -> DataFrame:
    """e1, e2, sha: the SHA-256 of the conv_ids of each (e1, e2), in ascending order and joined by commas.

    The ids are sorted over all tasks and joined in chunks; a hot key's chunks are then hashed as a stream.
    """
    by = ["e1", "e2", "conv_id"]
    dealt = rows.select(*by).repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            e1, e2, c = (x[k].to_numpy() for k in by)
            new = np.flatnonzero(np.r_[True, (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])][: len(c)])
            cuts = sorted({*new.tolist(), *range(0, len(c), CHUNK_IDS), len(c)})
            ids = c.astype(str)
            yield pd.DataFrame({"e1": e1[cuts[:-1]], "e2": e2[cuts[:-1]], "conv_id": c[cuts[:-1]], "ids": [",".join(ids[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, h = None, hashlib.sha256()
        for x in batches:
            done = []
            for e1, e2, ids in zip(x["e1"], x["e2"], x["ids"], strict=True):
                if (e1, e2) == last:
                    h.update(f",{ids}".encode())
                    continue
                if last is not None:
                    done.append((*last, h.hexdigest()))
                last, h = (e1, e2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["e1", "e2", "sha"])
        if last is not None:
            yield pd.DataFrame([(*last, h.hexdigest())], columns=["e1", "e2", "sha"])

    joined = dealt.mapInPandas(chunks, "e1 long, e2 long, conv_id long, ids string")
    return joined.repartition("e1", "e2").sortWithinPartitions(*by).mapInPandas(hashed, "e1 long, e2 long, sha string")


def _all_nodes(cut: DataFrame, block: int) -> DataFrame:
    """Nodes of each range of sorted blocks, those of its ends in part only."""
    spark = cut.sparkSession
    cut = written(cut.selectExpr("*", "xxhash64(b, s1, s2, tokens) AS e1", "xxhash64(7, b, s1, s2, tokens) AS e2"), "trie-starts")
    sha = id_hashes(cut.where("final"))
    folded = cut.groupBy(*_KEY, "tokens", "e1", "e2").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.count_if("final").alias("ends"))
    folded = written(folded.join(sha, ["e1", "e2"], "left").drop("e1", "e2"), "trie-folded")
    size = folded.agg(F.sum(F.length("tokens") + 64)).first()[0] or 0
    parts = max(partitions(spark), size // TASK_BYTES + 1)
    order = [*_KEY, "tokens"]
    dealt = folded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.selectExpr("*", "s1 ^ xxhash64(b, tokens) AS n1", "s2 ^ xxhash64(7, b, tokens) AS n2")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for x in batches if len(x)]
        if held:
            yield from _nodes(TaskContext.get().partitionId(), pd.concat(held, ignore_index=True), block)

    return written(dealt.mapInPandas(each, NODE), "trie-nodes")


def _up(rows: DataFrame, *sums: str) -> DataFrame:
    """The sums of `rows` for each node on their paths: id1, id2 and the sums."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            size = x["path"].map(len).to_numpy() // 16
            ids = np.frombuffer(b"".join(x["path"]), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"id1": ids[:, 0], "id2": ids[:, 1]} | {s: np.repeat(x[s].to_numpy(), size) for s in sums})

    out = rows.select("path", *sums).mapInPandas(each, "id1 long, id2 long, " + ", ".join(f"{s} long" for s in sums))
    return out.groupBy("id1", "id2").agg(*[F.sum(s).alias(s) for s in sums])


def _joined(nodes: DataFrame) -> DataFrame:
    """One row a node within its block: what nodes at the ends of ranges hold is added up over the ranges."""
    inner, ends = nodes.where("NOT open"), nodes.where("open")
    same = ["b", "s1", "s2", "d", "id1", "id2", "p1", "p2", "chars"]
    whole = ends.groupBy(*same).agg(*[F.sum(c).alias(c) for c in _SUMS], F.min("conv_id").alias("conv_id"), F.max("sha").alias("sha"), F.max(F.struct(F.expr("n1 <> 0 OR n2 <> 0"), "n1", "n2")).alias("go"), F.max("path").alias("path"))
    whole = written(whole.selectExpr(*same, *_SUMS, "conv_id", "sha", "go.n1 AS n1", "go.n2 AS n2", "path"), "trie-ends")
    more = _up(whole.selectExpr("path", "cast(n = ends AS long) AS leaves", "(n - 1) * chars AS saved"), "leaves", "saved").withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"})
    kids = whole.where("d > 0").groupBy(F.col("p1").alias("id1"), F.col("p2").alias("id2")).agg(F.count("*").alias("more_kids"))
    above = whole.selectExpr("id1 AS p1", "id2 AS p2", "conv_id AS parent")
    full = whole.join(more, ["id1", "id2"]).join(kids, ["id1", "id2"], "left").join(above, ["p1", "p2"], "left")
    full = full.withColumns({"kids": F.expr("kids + coalesce(more_kids, 0)"), "leaves": F.expr("leaves + more_leaves"), "saved": F.expr("saved + more_saved")})
    # A closed node's open parent is looked up by range, so that no key has more rows than one range.
    named = ends.select("part", "id1", "id2").join(whole.select("id1", "id2", "conv_id"), ["id1", "id2"]).selectExpr("part", "id1 AS p1", "id2 AS p2", "conv_id AS above")
    lower = inner.where("popen").join(named, ["part", "p1", "p2"]).withColumn("parent", F.col("above"))
    columns = [*same, *_SUMS, "conv_id", "parent", "sha", "n1", "n2", "path"]
    return full.select(*columns).unionByName(inner.where("NOT popen").select(*columns)).unionByName(lower.select(*columns))


def _across_blocks(nodes: DataFrame) -> DataFrame:
    """Blocks' tries joined into one: a start's node gets the children and sums of the trie that hangs below it.

    Sums over all tries below a trie are taken in rounds that double the distance, so a conversation of any length
    takes as many rounds as its number of blocks has bits.
    """
    tops = nodes.where("n1 <> 0 OR n2 <> 0").selectExpr("b + 1 AS b", "n1 AS s1", "n2 AS s2", "conv_id AS top", "id1", "id2", "path", "b AS pb", "s1 AS t1", "s2 AS t2")
    roots = nodes.where("b > 0 AND d = 0").select(*_KEY, "kids", "leaves", "saved")
    tries = written(roots.join(tops, _KEY), "trie-links")
    link = tries.selectExpr("b", "s1", "s2", "leaves", "saved", "pb AS ab", "t1 AS a1", "t2 AS a2")
    while link.where("ab > 0").take(1):
        to_add = link.where("ab > 0").groupBy(F.col("ab").alias("b"), F.col("a1").alias("s1"), F.col("a2").alias("s2")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("v"))
        far = link.selectExpr("b AS ab", "s1 AS a1", "s2 AS a2", "ab AS fb", "a1 AS f1", "a2 AS f2")
        on = link.where("ab > 0")
        on = join_spread(on, far, "ab", "a1", "a2").selectExpr("b", "s1", "s2", "leaves", "saved", "fb AS ab", "f1 AS a1", "f2 AS a2")
        link = on.unionByName(link.where("ab <= 0").select(*on.columns)).join(to_add, _KEY, "left")
        link = written(link.selectExpr(*_KEY, "leaves + coalesce(l, 0) AS leaves", "saved + coalesce(v, 0) AS saved", "ab", "a1", "a2"), "trie-doubled")
    below = tries.drop("leaves", "saved").join(link.select(*_KEY, "leaves", "saved"), _KEY)
    sums = _up(below, "leaves", "saved").withColumnsRenamed({"leaves": "l", "saved": "v"})
    hung = tries.selectExpr("id1", "id2", "kids AS k")
    high = nodes.where("b > 0 AND d = 1").withColumnRenamed("parent", "old")
    high = join_spread(high, tries.selectExpr(*_KEY, "top AS parent"), *_KEY).select(*nodes.columns)
    nodes = nodes.where("d <> 1 OR b = 0").unionByName(high)
    nodes = nodes.join(sums, ["id1", "id2"], "left").join(hung, ["id1", "id2"], "left")
    return nodes.withColumns({"kids": F.expr("kids + coalesce(k, 0)"), "leaves": F.expr("leaves + coalesce(l, 0)"), "saved": F.expr("saved + coalesce(v, 0)")})


def trie(turns: DataFrame, heads: int = 6, every: int = 100, block: int = BLOCK) -> DataFrame:
    """The nodes of the rebuilt conversations' prefix trie, one row each.

    `turns`: conv_id, turn, role, text; further columns aren't read. Null roles and texts are empty ones, null turns
    come first, equal turns of a conversation stand in the order of role and text, and repeated rows are turns of
    their own. Rows with a null conv_id take no part. Without conversations there is no node; a conversation that
    ends up without turns is a member of the root. `%` is that of SQL, with the sign of conv_id.
    """
    turns = turns.where("conv_id IS NOT NULL").selectExpr("cast(conv_id AS long) AS conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
    nodes = _joined(_all_nodes(blocks(*rebuilt(turns, heads, every), block), block))
    nodes = written(nodes, "trie-joined")
    if nodes.where("b > 0").take(1):
        nodes = _across_blocks(nodes)
    return nodes.where("d > 0 OR b = 0").select(
        "conv_id",
        (F.col("b").cast("long") * block + F.col("d")).alias("depth"),
        F.expr("IF(b = 0 AND d = 0, NULL, parent)").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT DISTINCT conv_id AS c, xor(4294967295, list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
          lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda v, k: xor(v >> 1, 3988292384::BIGINT * (v & 1))))) AS crc
        FROM t),
c AS (SELECT c, crc % 6 AS h, c - c % 100 AS base,
             (SELECT count(*) FROM t WHERE conv_id = crc.c - crc.c % 100 AND i <= crc.crc % 6) AS m FROM crc),
r AS (SELECT c, i AS pos, role, text FROM c JOIN t ON conv_id = base AND i <= h
      UNION ALL SELECT c, m + i - h, role, text FROM c JOIN t ON conv_id = c AND i > h),
p AS (SELECT c, pos AS depth, md5(to_json(list([role, text]) OVER w)) AS key, length(text) AS chars,
             pos = max(pos) OVER (PARTITION BY c) AS stops
      FROM r WINDOW w AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)
      UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM r) FROM c),
n AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE stops), '') AS ends FROM p GROUP BY key, depth),
u AS (SELECT n.*, p.key AS parent_key, q.conv_id AS parent_conv_id FROM n
      LEFT JOIN p ON p.c = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n q ON q.key = p.key),
k AS (SELECT parent_key AS key, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY 1),
s AS (SELECT p.key, sum((n_convs - 1) * u.chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
      FROM u LEFT JOIN k USING (key) JOIN p ON p.c = u.conv_id AND p.depth <= u.depth GROUP BY p.key)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM u JOIN s USING (key) LEFT JOIN k USING (key)
"""
