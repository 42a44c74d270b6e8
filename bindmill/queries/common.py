"""Helpers of the registered queries, which run the operators on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(col: Column | str) -> Column:
    """Rounded to six decimals, without a negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def big(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("long")
