"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a table bucketed and sorted by the 128-bit hash of a line's key, with
`n_docs` (documents of its batches that hold the key) and `keeper` (the document
that keeps the line). A new batch merge-joins the runs: what it shares with them
is only counted, what is new to all of them (the anti-join) names its keeper.
The batch then becomes a run of level 0; `fanout` runs of a level are merged
into one of the next. As runs share bucketing, neither the merge joins nor the
compactions shuffle a run.

Rules: a text is split at newlines, and a null or empty text is one empty line.
The key is the line without ASCII white space at both ends, A-Z in lower case.
A key of `min_chars` code points or more that `min_docs` documents hold loses all
its lines but those of the largest doc_id that holds it. Rows with equal doc_ids are
one document; null doc_ids are one too, the smallest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_spread, partitions, written

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH = ["h1", "h2"]


class LineRuns:
    """Levelled runs in the session's warehouse; `fanout` runs of a level make one of the next."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = [[]]

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        return name

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Both runs' keys once: counts add up, and the keeper stays the one first named."""
        a, b = a.alias("a"), b.alias("b")
        on = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
        return a.join(b, on, "full_outer").select(
            *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in HASH],
            (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"),
            F.coalesce("a.keeper", "b.keeper").alias("keeper"),
        )

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The batch's keys that no run holds."""
        for r in self.runs():
            batch = batch.join(self.spark.table(r), HASH, "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Count the batch's keys (h1, h2, n_docs, keeper) and name keepers for those new to all runs."""
        for r in self.runs():
            seen = self.spark.table(r).select(*HASH, F.lit(True).alias("seen"))
            batch = batch.join(seen, HASH, "left").withColumn(
                "keeper", F.when(F.col("seen").isNull(), F.col("keeper"))
            ).drop("seen")
        self.levels[0].append(self._write(batch))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge(level)
            level += 1

    def _merge(self, level: int) -> None:
        old = self.levels[level]
        out = self.spark.table(old[0])
        for r in old[1:]:
            out = self._merged(out, self.spark.table(r))
        new = self._write(out)
        for r in old:
            self.spark.sql(f"DROP TABLE {r}")
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(new)

    def all(self) -> DataFrame:
        """One row for each key of all runs, by merge joins of the runs."""
        names = self.runs()
        out = self.spark.table(names[0])
        for r in names[1:]:
            out = self._merged(self.spark.table(r), out)
        return out

    def drop(self) -> None:
        for r in self.runs():
            self.spark.sql(f"DROP TABLE {r}")
        self.levels = [[]]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """did, th, h: the hash of each line's key in order, null for short ones; u: h without repeats, where it has any."""
    keys = _lines(F.translate("text", UPPER, UPPER.lower()))
    long = lambda k: F.length(k) >= min_chars
    return (
        docs.select(
            F.coalesce("doc_id", F.lit(-(2**63))).alias("did"),
            F.xxhash64("text").alias("th"),
            F.transform(keys, lambda k: F.trim(k, F.lit(WHITE))).alias("keys"),
        )
        .select("did", "th", "keys", F.array_distinct(F.filter("keys", long)).alias("once"))
        .select(
            "did",
            "th",
            F.transform("keys", lambda k: F.when(long(k), _hash(k))).alias("h"),
            F.when(F.size("once") < F.size(F.filter("keys", long)), F.transform("once", _hash)).alias("u"),
        )
    )


def _batches(docs: DataFrame, n: int) -> list[int]:
    """Lower ends of `n` ranges of doc_id with about as many rows each, largest first."""
    at = [i / n for i in range(1, n)]
    cuts = docs.agg(F.percentile_approx("did", at, 1000)).first()[0] or []
    return [*sorted(set(cuts), reverse=True), -(2**63)]


def dropped_lines(hashes: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """did, th, drop: numbers of the lines to drop, for the documents that lose some."""
    spark = hashes.sparkSession
    runs, above = LineRuns(spark, fanout), None
    # Rows with one doc_id count a key once.
    twice = written(hashes.groupBy("did").agg(F.count("*").alias("n")).where("n > 1").select("did"), "line-repeats")
    some = bool(twice.take(1))
    for low in _batches(hashes, batches):
        part = hashes.where(F.col("did") >= low)
        if above is not None:
            part = part.where(F.col("did") < above)
        each = F.explode(F.coalesce("u", F.filter("h", lambda x: x.isNotNull()))).alias("k")
        keys = part.select("did", each)
        if some:
            keys = part.join(twice, "did", "left_anti").select("did", each).unionByName(part.join(twice, "did", "left_semi").select("did", each).distinct())
        stats = keys.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        runs.add(stats.agg(F.count("*").alias("n_docs"), F.max("did").alias("keeper")))
        above = low
    often = written(runs.all().where(F.col("n_docs") >= min_docs), "line-often")
    runs.drop()
    lines = hashes.select("did", "th", F.posexplode("h").alias("i", "k")).where("k IS NOT NULL")
    lines = lines.select("did", "th", "i", "k.h1", "k.h2")
    hit = join_spread(lines, often.select(*HASH, "keeper"), *HASH, sizes=often.select(*HASH, F.col("n_docs").alias("n"))).where("did <> keeper")
    return hit.groupBy("did", "th").agg(F.collect_list("i").alias("drop"))


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 3
) -> DataFrame:
    """`docs` (doc_id, text, more) with repeated lines dropped from `text`, and n_lines and n_dropped.

    Columns of `docs` named n_lines or n_dropped are replaced. An empty table gives
    an empty one. A null text stays null.
    """
    hashes = written(line_hashes(docs, min_chars), "line-hashes")
    drop = dropped_lines(hashes, min_docs, batches, fanout)
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    keyed = docs.select(
        *rest, "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("_did"), F.xxhash64("text").alias("_th")
    )
    drop = drop.select(F.col("did").alias("_did"), F.col("th").alias("_th"), F.col("drop").alias("_drop"))
    out = keyed.join(drop, ["_did", "_th"], "left").withColumn("_lines", _lines(F.col("text")))
    kept = F.expr("transform(array_except(sequence(0, size(_lines) - 1), _drop), i -> _lines[i])")
    return out.select(
        *rest,
        F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.array_distinct("_drop")), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
