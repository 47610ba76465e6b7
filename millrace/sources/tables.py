"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str, *columns: str) -> DataFrame:
    """The table `name` of `data_dir`; with columns given, only those are scanned."""
    df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
