"""String-keyed result maps as rows: name -> numbers, strings or one number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KINDS = {"numbers": "map<string,array<double>>", "strings": "map<string,array<string>>", "number": "map<string,double>"}


def to_rows(spark: SparkSession, values: dict, kind: str) -> DataFrame:
    """One row (key, value) an entry."""
    return spark.createDataFrame([(values,)], f"m {KINDS[kind]}").selectExpr("explode(m) AS (key, value)")


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    value = KINDS[kind].removeprefix("map<string,").removesuffix(">") + (">" if kind != "number" else "")
    return spark.read.schema(f"key string, value {value}".replace(">>", ">")).json(path)
