"""Readers for the named input tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One named table; the path may live in any store that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
