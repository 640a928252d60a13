"""Interactions drawn from an orders / lineitem star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_interactions(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """One row per order line, ``user`` = the customer and ``item`` = the part.

    ``where`` is a condition on columns of orders or lineitem; Catalyst moves it to the scan.
    """
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    if where is not None:
        joined = joined.where(where)
    return joined.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
