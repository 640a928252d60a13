"""Distributed prefix sums: rows are range-sorted over many partitions, and each partition starts from
the sum of those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covote.llm.common import kept

PART = "_part"


def ranged(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` sorted over partitions by ``by`` and kept, with the number of each row's partition in ``_part``.

    The table is written once, so that every later step sees the same cuts, whatever the sample
    was that they were drawn from. Only rows that are equal in all of ``by`` are bound to one partition.
    """
    return kept(df.repartitionByRange(*by).withColumn(PART, F.spark_partition_id()), name)


def totals_before(ranged_df: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """``group, _part`` and, by each name in ``sums``, its sum over the earlier partitions of the group.

    As many rows as there are partitions and groups together, since the groups are sorted too.
    """
    totals = ranged_df.groupBy(*group, PART).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, PART, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums])


def with_before(
    ranged_df: DataFrame, before: DataFrame, group: list[str], by: list[Column], sums: dict[str, Column]
) -> DataFrame:
    """The rows with, by each name in ``sums``, the exclusive prefix sum within their group.

    ``before`` is ``totals_before`` of them, to which columns of the group may have been added: these
    come along, and no row has to meet its group in a join on the group alone.
    """
    added = [c for c in before.columns if c not in (*group, PART, *sums)]
    base = before.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col(PART).alias("_g_part"),
        *[F.col(c).alias(f"_b_{c}") for c in sums],
        *added,
    )
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    here = Window.partitionBy(*group, PART).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged_df.withColumns({f"_w_{c}": F.coalesce(F.sum(v).over(here), F.lit(0)) for c, v in sums.items()})
    joined = within.join(base, [*on, F.col(PART) == F.col("_g_part")])
    own = [c for c in ranged_df.columns if c != PART]
    return joined.select(*own, *[(F.col(f"_w_{c}") + F.col(f"_b_{c}")).alias(c) for c in sums], *added)


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with the exclusive prefix sums ``sums`` in ``order`` within ``group`` (none: over all rows)."""
    rows = ranged(df, [*[F.col(c).asc_nulls_first() for c in group], *order], name)
    return with_before(rows, totals_before(rows, group, sums), group, order, sums)
