"""Named Parquet tables below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``root/name.parquet``, as a file or a folder of part files; nothing is read yet."""
    return spark.read.parquet(f"{root}/{name}.parquet")
