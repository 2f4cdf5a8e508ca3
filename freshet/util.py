"""Small helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def c(name: str) -> Column:
    """Column by exact name: dots and blanks in a name are taken literally."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_time(first: Column, last: Column) -> Column:
    """A flow has a time if neither bound is NULL or 0."""
    return first.isNotNull() & last.isNotNull() & (first != 0) & (last != 0)
