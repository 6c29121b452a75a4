"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


_WORD, _FOREIGN = re.compile(r"\w+"), re.compile(r"[^\w\x00-\x7f]")
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def lower_words(text: str | None) -> list[bytes]:
    r"""The runs of \w in the lower-case text, as UTF-8; none for a null text."""
    low = (text or "").lower()
    # With no other characters above ASCII, the ASCII ones alone part words.
    if low.isascii() or not _FOREIGN.search(low):
        return low.encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(low)]


def mixed(h: np.ndarray, k: int = 0) -> np.ndarray:
    """Hashes of 64-bit numbers, others for each k."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """Hashes of the words met lately."""

    def __missing__(self, w: str | bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


_MET = _Words()


def word_hashes(words: list[str] | list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(_MET.__getitem__, words), np.uint64, len(words))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a local one for a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return _FALLBACK[0]


_ROOTS: dict[str, str] = {}
_MADE: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the application's own folder of the shared one, which is deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = f"{shared_dir(spark)}/cloudloom-{app}-{uuid.uuid4().hex[:8]}"
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = p.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(p)
        system.deleteOnExit(p)
        _ROOTS[app] = root
    _MADE.append(f"{_ROOTS[app]}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> list[str]:
    """The paths given by `new_path` that haven't been dropped."""
    return list(_MADE)


def written(df: DataFrame, what: str, codec: str = "zstd", by: list[str] | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, what)
    out = df.write.option("compression", codec)
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table made by `written` that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_spread(rows: DataFrame, by: DataFrame, *keys: str, sizes: DataFrame | None = None) -> DataFrame:
    """`rows` (with further columns) joined with `by` (one row a key at most) on keys that aren't null, hot keys cut into parts.

    A key with more than its share of a task's rows is salted, and its row of `by` is copied
    to each part. There are fewer such keys than four a partition, so they are broadcast.
    `sizes` (keys, n) spares counting the rows of each key.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")) if sizes is None else sizes
    sizes = written(sizes, "key-sizes")
    most = max(1000, (sizes.agg(F.sum("n")).first()[0] or 0) // (4 * partitions(rows.sparkSession)))
    hot = sizes.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_parts"))
    if not hot.take(1):
        return rows.join(by, list(keys))
    hot = F.broadcast(hot)
    rest = [c for c in rows.columns if c not in keys]
    left = rows.join(hot, list(keys), "left")
    left = left.withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rest), F.col("_parts")).cast("int")))
    right = by.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [*keys, "_salt"]).drop("_salt")
