"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def path_of(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(path_of(folder, name))


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Register temporary views of the named tables."""
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)
