"""SimHash near-duplicate groups by multi-index hashing.

Each text gets a fingerprint of its word shingles, of 64 bits or more (`parts` of 64).
Equal fingerprints are folded first, so a group of copies costs one entry. The fingerprint is cut into
segments; for `radius` = a * segments + b, some segment of any pair within the
radius differs by at most a bits (one of the first b + 1), or by at most a - 1
(one of the others). Every entry stands in one table a segment under its exact
value and enumerates the Hamming ball of that segment as probes; matches are
verified over all bits. Buckets of more than `dense` entries would emit pairs
with the square of their size: their probes and entries are instead compared
block by block, and each block returns only edges that connect what its pairs connect.
Components come from star contraction over written tables.

`near_duplicates` links fingerprints within a radius, all of them. `similar` looks for
texts that share shingles: its balls are limited (`ball`), the fingerprint only finds
candidates, and the shingles themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_path, join_spread, mixed, new_path, partitions, word_hashes, written

#: Fixed: the words' separators are \x20 and \x09 to \x0D; A-Z become lower case.
PLAIN = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Texts of a block of a dense bucket, and their shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22


def words_of(text: str | None) -> list[bytes]:
    """The runs between separators, in UTF-8, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def fingerprint(text: str | None, words: int = 4) -> int:
    """Bit i is set where over half of the shingles' XXH64 hashes have it; 0 for a text without words.

    Repeats count, and a text of fewer than `words` words is one shingle.
    """
    w = words_of(text)
    if not w:
        return 0
    digest, one = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(w) - words + 1)
    total = np.zeros(64, np.int64)
    step = 1 << 14
    for at in range(0, n, step):
        last = min(n, at + step)
        shingles = map(one, zip(*(w[at + k : last + k] for k in range(words)), strict=True)) if len(w) >= words else [one(w)]
        total += bit_counts(np.fromiter((digest(s, 42) for s in shingles), np.uint64, last - at))
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits: a byte for each bit, 255 hashes at a time."""
    bits = np.unpackbits(h.astype("<u8", copy=False).view(np.uint8), bitorder="little").view("<u8").reshape(-1, 8)
    return np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The different hashes of the text's shingles, ascending; a text of fewer words is one shingle, one without words none."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = word_hashes(w)
    n, size = (len(w) - words + 1, words) if len(w) >= words else (1, len(w))
    out = h[:n]
    for k in range(1, size):
        out = mixed(out) + h[k : n + k]
    return np.unique(mixed(out))


def sketch(h: np.ndarray, parts: int) -> np.ndarray:
    """The fingerprint of different shingles: 64 bits for each part."""
    if not len(h):
        return np.zeros(parts, np.uint64)
    bits = np.stack([bit_counts(mixed(h, k)) for k in range(parts)]) * 2 > len(h)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as an array of one long) of each row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [np.array([fingerprint(t, words)], np.uint64).view(np.int64) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(each, "doc_id long, fp array<long>")


#: A null doc_id, where keys are joined.
_NO_ID = -(2**63)
#: Rows of a table that is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, did (doc_id, never null), th (a hash of the text), text."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")


def sketches(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """doc_id, did, th, fp of each row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = [sketch(shingles(t, words), parts).view(np.int64) for t in b["text"]]
            yield b[["doc_id", "did", "th"]].assign(fp=fp)

    return _keyed(docs).mapInPandas(each, "doc_id long, did long, th long, fp array<long>")


def shingle_sets(docs: DataFrame, asked: DataFrame, sizes: DataFrame, words: int) -> DataFrame:
    """id, shingles (32 bits of each hash) of the rows of `docs` that `asked` (id, did, th) names; `sizes` (did, th, n)."""
    rows = _keyed(docs).drop("doc_id")
    few = asked.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(asked), ["did", "th"]) if few else join_spread(rows, asked, "did", "th", sizes=sizes)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                short = [np.unique((shingles(t, words) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"], "shingles": short})

    return rows.select("id", "text").mapInPandas(each, "id long, shingles array<int>").dropDuplicates(["id"])


def plan(bits: int, radius: int, segments: int, ball: int | None = None) -> list[tuple[int, int, int]]:
    """(shift, bits, ball) of each segment, none of which crosses a border of 64 bits."""
    a, b = divmod(radius, segments)
    sizes = [bits // segments + (i < bits % segments) for i in range(segments)]
    # The wider segments take the larger balls.
    balls = [a if i <= b else a - 1 for i in range(segments)]
    if ball is not None:
        balls = [min(r, ball) for r in balls]
    out = [(sum(sizes[:i]), s, r) for i, (s, r) in enumerate(zip(sizes, balls, strict=True)) if r >= 0]
    assert all(at // 64 == (at + s - 1) // 64 for at, s, _ in out), "a segment crosses a border"
    return out


def _masks(bits: int, ball: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(ball + 1) for c in combinations(range(bits), r)]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the edges of a spanning forest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, np.int64)


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's edges, those of a spanning forest, a batch at a time."""
    for b in batches:
        yield b.iloc[forest(b["a"].to_numpy(), b["b"].to_numpy())]


def _block(radius: int, spare: int | None, cuts: list[tuple[int, int, int]]):
    def each(key, g: pd.DataFrame) -> pd.DataFrame:
        """Edges between the entries and the probes of one pair of blocks.

        Without `spare`: each probe's nearest entry of every part that it joins. Else its `spare` nearest
        entries of other groups, and an edge to itself where it has more of them; pairs that meet in an
        earlier segment too are left to that one.
        """
        t, p = g[g["probe"] == 0], g[g["probe"] == 1]
        xs, ys, ds = [], [], []
        names = np.zeros(0, np.int64)
        if len(t) and len(p):
            wide = lambda d: np.array(d["fp"].to_list(), np.int64).view(np.uint64)
            fp, ids, groups = wide(t), t["id"].to_numpy(), t["label"].to_numpy()
            names, code = np.unique(np.concatenate([ids, p["id"].to_numpy()]), return_inverse=True)
            part, code, own = np.arange(len(names)), code[: len(ids)], code[len(ids) :]
            earlier = _earlier(int(key[0]) >> 56, cuts) if spare else []
            for x, i, label in zip(wide(p), own.tolist(), p["label"].to_numpy(), strict=True):
                apart = fp ^ x
                d = np.bitwise_count(apart).sum(1, dtype=np.int64)
                near = np.flatnonzero((d <= radius) & (code != i) & (groups != label))
                for k, mask, ball in earlier:
                    near = near[np.bitwise_count(apart[near, k] & mask) > ball]
                near = near[np.argsort(d[near], kind="stable")]
                if spare is None:
                    near = near[np.sort(np.unique(part[code[near]], return_index=True)[1])]
                    for j, far in zip(code[near].tolist(), d[near].tolist(), strict=True):
                        if part[j] != part[i]:
                            part[part == part[j]] = part[i]
                            xs.append(i)
                            ys.append(j)
                            ds.append(far)
                else:
                    ends = [*code[near[:spare]].tolist(), *([i] if len(near) > spare else [])]
                    xs += [i] * len(ends)
                    ys += ends
                    ds += [*d[near[:spare]].tolist(), *([0] if len(near) > spare else [])]
        return pd.DataFrame({"a": names[np.array(xs, np.int64)], "b": names[np.array(ys, np.int64)], "d": np.array(ds, np.int32)})

    return each


def _earlier(segment: int, cuts: list[tuple[int, int, int]]) -> list[tuple[int, np.uint64, int]]:
    """Word, mask and ball of the segments before this one."""
    return [(at // 64, np.uint64(((1 << n) - 1) << at % 64), ball) for at, n, ball in cuts[:segment]]


def _deciding(radius: int, cuts: list[tuple[int, int, int]], similarity: float):
    def each(key, g: pd.DataFrame) -> pd.DataFrame:
        """Edges that connect the labels of one pair of blocks by texts within the radius whose sets of shingles are similar.

        Pairs that meet in an earlier segment too are left to that one.
        """
        t, p = g[g["probe"] == 0], g[g["probe"] == 1]
        edges: list[tuple[int, int]] = []
        if len(t) and len(p):
            wide = lambda d: np.array(d["fp"].to_list(), np.int64).view(np.uint64)
            names, part = np.unique(np.concatenate([t["label"].to_numpy(), p["label"].to_numpy()]), return_inverse=True)
            part, own = part[: len(t)], part[len(t) :]
            fp, ids, n = wide(t), t["id"].to_numpy(), t["shingles"].map(len).to_numpy()
            # Who holds a shingle: a run of `owner` for each.
            flat, owner = np.concatenate(t["shingles"].to_list()), np.repeat(np.arange(len(t)), n)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            earlier = _earlier(int(key[0]) >> 56, cuts)
            for x, i, k, s in zip(wide(p), p["id"].tolist(), range(len(p)), p["shingles"], strict=True):
                apart = fp ^ x
                near = (part != own[k]) & (np.bitwise_count(apart).sum(1, dtype=np.int64) <= radius)
                for word, mask, ball in earlier:
                    near &= np.bitwise_count(apart[:, word] & mask) > ball
                if not near.any():
                    continue
                runs = zip(np.searchsorted(flat, s).tolist(), np.searchsorted(flat, s, "right").tolist(), strict=True)
                shared = np.bincount(np.concatenate([owner[:0], *(owner[a:b] for a, b in runs if a < b)]), minlength=len(t))
                for j in np.flatnonzero(near & (shared >= similarity * (len(s) + n - shared))).tolist():
                    if (old := part[j]) != (new := own[k]):
                        part[part == old], own[own == old] = new, new
                        edges.append((i, int(ids[j])))
        return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    return each


@dataclass
class Buckets:
    """The tables of a multi-index over nodes (id, fp, label): who stands in a bucket (v), and who asks it."""

    radius: int
    parts: int
    cuts: list[tuple[int, int, int]]
    table: DataFrame
    probes: DataFrame
    #: v, n of the buckets with more than `dense` entries, and whether there are any.
    hot: DataFrame
    some_hot: bool

    def sparse(self) -> DataFrame:
        """a, b: all pairs of different nodes within the radius that meet in a bucket that isn't dense."""
        t = self.table.select("v", F.col("id").alias("b"), *[F.col(f"f{k}").alias(f"g{k}") for k in range(self.parts)])
        probes = self.probes
        if self.some_hot:
            t, probes = (x.join(self.hot.select("v"), "v", "left_anti") for x in (t, probes))
        d = sum(F.bit_count(F.col(f"f{k}").bitwiseXOR(F.col(f"g{k}"))) for k in range(self.parts))
        return probes.join(t, "v").where((d <= self.radius) & (F.col("id") != F.col("b"))).select(F.col("id").alias("a"), "b")

    def dense(self, spare: int | None = None) -> DataFrame:
        """a, b, d: edges between nodes of different labels in dense buckets, block by block."""
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        fp = F.array(*[F.col(f"f{k}") for k in range(self.parts)]).alias("fp")
        spread = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
        every = F.explode(F.sequence(F.lit(0), blocks - 1))
        cols = ["v", "id", "label", fp]
        te = self.table.join(self.hot, "v").select(*cols, F.lit(0).alias("probe"), spread("id").alias("tb"), every.alias("pb"))
        pr = self.probes.join(self.hot, "v").select(*cols, F.lit(1).alias("probe"), every.alias("tb"), spread("id").alias("pb"))
        cols = ["v", "id", "label", "fp", "probe", "tb", "pb"]
        both = te.select(*cols).unionByName(pr.select(*cols))
        return both.groupBy("v", "tb", "pb").applyInPandas(_block(self.radius, spare, self.cuts), "a long, b long, d int")

    def meeting(self, asking: DataFrame) -> DataFrame:
        """v, id, label, fp, probe: entries (0) and the probes (1) of `asking` (id) in dense buckets where labels differ."""
        fp = F.array(*[F.col(f"f{k}") for k in range(self.parts)]).alias("fp")
        cols = ["v", "id", "label", fp]
        hot = self.hot.select("v")
        probes = self.probes.join(asking, "id", "left_semi").join(hot, "v").select(*cols, F.lit(1).alias("probe"))
        both = self.table.join(hot, "v").select(*cols, F.lit(0).alias("probe")).unionByName(probes)
        both = written(both, "simhash-dense-rows")
        kept = both.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("probe").alias("asked"))
        return both.join(kept.where("lo <> hi AND asked = 1").select("v"), "v")

    def decided(self, rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
        """a, b: edges that connect the labels of the rows of `meeting` as similar sets of shingles (id, shingles) do, block by block.

        A block has about `BLOCK` texts and `BLOCK_SHINGLES` shingles at most.
        """
        size = sets.select("id", F.size("shingles").alias("size"))
        blocks = rows.join(size, "id").groupBy("v").agg(
            F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
        )
        own, every = F.pmod(F.xxhash64("id"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = rows.join(blocks, "v").select("*", own.alias("own"), every.alias("other"))
        probe = F.col("probe") == 1
        dealt = dealt.select(
            "v", "id", "label", "fp", "probe", F.when(probe, F.col("other")).otherwise(F.col("own")).alias("tb"),
            F.when(probe, F.col("own")).otherwise(F.col("other")).alias("pb"),
        )
        # As many tasks as there are partitions: the rows are few, their comparisons aren't.
        dealt = dealt.join(sets, "id").repartition(partitions(rows.sparkSession), "v", "tb", "pb")
        return dealt.groupBy("v", "tb", "pb").applyInPandas(_deciding(self.radius, self.cuts, similarity), "a long, b long")

    def nearest(self, spare: int) -> DataFrame:
        """a, b: each node's `spare` nearest of `dense`, and an edge to itself where it has more."""
        found = self.dense(spare).groupBy("a", "b").agg(F.min("d").alias("d"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy("itself", "d", "b"))
        found = found.withColumn("itself", F.col("a") == F.col("b")).withColumn("rank", rank).where(F.col("itself") | (F.col("rank") <= spare + 1))
        return found.select("a", F.when(F.col("rank") <= spare, F.col("b")).otherwise(F.col("a")).alias("b"))


def buckets(nodes: DataFrame, radius: int, segments: int, dense: int, parts: int, ball: int | None, hot: DataFrame | None = None) -> Buckets:
    """The multi-index of nodes (id, fp, and label, their ids if they have none); `hot`: that of the same nodes, if known."""
    cuts = plan(64 * parts, radius, segments, ball)
    value = lambda s, n: F.shiftrightunsigned(F.col("fp")[s // 64], s % 64).bitwiseAND((1 << n) - 1)
    # A bucket's name: the segment's number above its value.
    named = lambda i, v: v.bitwiseOR(F.lit(i << 56))

    def ball_of(i: int, s: int, n: int, most: int) -> Column:
        """The buckets of a segment that a node asks: of a pair that differs by one bit in it, the side without that bit."""
        v = value(s, n)
        flips = F.array(*[F.lit(m).cast("long") for m in _masks(n, most)])
        asked = F.filter(flips, lambda m: (F.bit_count(m) != 1) | (v.bitwiseAND(m) == 0))
        return F.transform(asked, lambda m: named(i, v.bitwiseXOR(m)))

    label = F.col("label" if "label" in nodes.columns else "id").alias("label")
    words = [F.col("fp")[k].alias(f"f{k}") for k in range(parts)]
    table = nodes.select("id", label, *words, F.explode(F.array(*[named(i, value(s, n)) for i, (s, n, _) in enumerate(cuts)])).alias("v"))
    probes = nodes.select("id", label, *words, F.explode(F.concat(*[ball_of(i, *cut) for i, cut in enumerate(cuts)])).alias("v"))
    if hot is None:
        hot = written(table.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > dense), "simhash-dense")
    return Buckets(radius, parts, cuts, table, probes, hot, bool(hot.take(1)))


def links(nodes: DataFrame, radius: int = 4, segments: int = 3, dense: int = 256) -> DataFrame:
    """Edges a, b (ids) that connect exactly what the pairs of nodes (id, fp of 64 bits) within the radius connect."""
    b = buckets(nodes, radius, segments, dense, 1, None)
    out = b.sparse().mapInPandas(_thin, "a long, b long")
    return out.unionByName(b.dense().select("a", "b")) if b.some_hot else out


def components(edges: DataFrame) -> DataFrame:
    """id, root: the least id connected with each node of the edges a, b, by alternating star contraction.

    Each round is written to the shared folder. Nodes without edges have no row.
    """
    spark = edges.sparkSession

    def table(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "star")
        df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path), path

    # a > b in every row.
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur, path = table(down)
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: the greater neighbours of each node go to its least neighbour or itself.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its lesser neighbours go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        new, new_at = table(small.distinct())
        drop_path(spark, path)
        cur, path = new, new_at
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return cur.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def _groups(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, id, component_id of each of the rows (doc_id, id): the least doc_id of the nodes that edges connect with its own."""
    # One doc_id with several fingerprints joins these.
    named = rows.where("doc_id IS NOT NULL")
    shared = named.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("hi")).where("b <> hi")
    extra = named.join(shared, "doc_id").select(F.col("id").alias("a"), "b").where("a <> b")
    at = nodes.join(components(edges.unionByName(extra)), "id", "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    at = written(at, "simhash-roots")
    least = at.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(join_spread(at.select("id", "root"), least, "root").select("id", "component_id"), "simhash-groups")
    return join_spread(rows, named, "id")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, segments: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable by links) of each row of `docs`.

    A null text counts as empty; texts without words have fingerprint 0. A repeated
    doc_id links its rows; a null doc_id names no group, so a group of such rows alone
    has a null component_id. An empty table gives an empty one.
    """
    rows = written(fingerprints(docs, words).withColumn("id", F.col("fp")[0]), "fingerprints")
    nodes = written(rows.groupBy("id").agg(F.min("doc_id").alias("least")).withColumn("fp", F.array("id")), "simhash-nodes")
    return _groups(rows, nodes, links(nodes, radius, segments)).select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    fp = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return near_duplicates(docs).select("doc_id", fp.alias("fingerprint"), "component_id")


def similar(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, parts: int = 3, radius: int = 42, segments: int = 12, ball: int = 1,
    dense: int | None = None, spare: int = 4,
) -> DataFrame:
    """doc_id, component_id of each row: groups of texts linked by a similarity of their sets of shingles of `words` words.

    At a similarity of 0.8 fingerprints differ in 15 % of their bits on average: 29 of 192 and seldom over 42;
    one of 12 segments of 16 bits differs by one bit or none in 98 of 100 such pairs, and in all but 4 of 1,000
    pairs at 0.85. These candidates are joined with the shingles, so no pair below `similarity` is linked.
    In buckets of more than `dense` texts (8, and twice the mean, if not given) a text first names its `spare` nearest candidates.
    For those that have more, the sets of shingles go to blocks of the buckets where not all is linked yet, and blocks return links only.
    A null text counts as empty, and texts without words are alike. Rows of one doc_id are linked, and a null
    doc_id names no group. An empty table gives an empty one.
    """
    rows = written(sketches(docs, words, parts).withColumn("id", F.xxhash64("fp")), "sketches")
    # Equal fingerprints have as good as equal shingles: any row stands for them.
    nodes = rows.groupBy("id", "fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("did", "th")).alias("one"))
    nodes = written(nodes.select("id", "fp", "least", "one.did", "one.th"), "simhash-nodes")
    sizes = rows.groupBy("did", "th").agg(F.count("*").alias("n"))
    dense = dense or 8 + 2 * nodes.count() // 2 ** (64 * parts // segments)
    at = buckets(nodes.select("id", "fp"), radius, segments, dense, parts, ball)
    pairs = at.sparse()
    if at.some_hot:
        pairs = pairs.unionByName(at.nearest(spare))
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    between = pairs.where("a <> b")

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = written(ids.distinct().join(nodes.select("id", "did", "th"), "id"), "simhash-asked")
        return written(shingle_sets(docs, asked, sizes, words), "simhash-shingles")

    sets = sets_of(between.select(F.col("a").alias("id")).unionByName(between.select(F.col("b").alias("id"))))
    edges = written(_alike(sets, between, similarity), "simhash-edges")
    asking = pairs.where("a = b").select(F.col("a").alias("id"))
    if at.some_hot and asking.take(1):
        labels = nodes.join(components(edges), "id", "left").select("id", "fp", F.coalesce("root", "id").alias("label"))
        at = buckets(written(labels, "simhash-labels"), radius, segments, dense, parts, ball, at.hot)
        rows_left = written(at.meeting(asking), "simhash-meeting")
        edges = edges.unionByName(at.decided(rows_left, sets_of(rows_left.select("id")), similarity))
        edges = written(edges, "simhash-edges")
    return _groups(rows.select("doc_id", "id"), nodes.select("id", "least"), edges).select("doc_id", "component_id")


def _alike(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles (id, shingles) are similar."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias("s" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, with all their columns, whose doc_id is the least of its group: one document of each group stays.

    Groups are those of `similar`. Rows with a null doc_id all stay; repeated rows of the document that
    stays are all kept. An empty table gives an empty one.
    """
    gone = similar(docs, **how).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(written(gone, "simhash-gone"), "doc_id", "left_anti").select(*docs.columns)
