"""Readers of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The whole parquet table `name` under `root`; filters and projections reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
