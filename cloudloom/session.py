"""Session defaults and table loading shared by every query."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "cloudloom", cores: str = "8", shuffle: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; `sf_dir` may be any URI that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SENT: set[str] = set()


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package sent to the executors first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sc = spark.sparkContext
        if sc.applicationId not in _SENT:
            root = Path(__file__).resolve().parent
            to = Path(tempfile.mkdtemp(prefix="spark-package-"))
            shutil.copytree(root, to / "tree" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
            sc.addPyFile(shutil.make_archive(str(to / root.name), "zip", to / "tree"))
            _SENT.add(sc.applicationId)
        return query(spark, sf_dir)

    return run


def _shared_dir(df: DataFrame) -> str:
    """The checkpoint folder of spark.checkpoint.dir; where that is unset, a local one for a local session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    _shared_dir(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which is deleted when the application ends.

    For loops of joins: a checkpoint keeps the estimated size of its plan, the product of the joined sizes, whose digits
    double with each round until they fill the driver. A table has the size of its files.
    """
    spark, path = df.sparkSession, f"{_shared_dir(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
