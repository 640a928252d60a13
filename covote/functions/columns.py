"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(common: Column, degree_product: Column) -> Column:
    """Cosine of two binary vectors from their overlap and the product of their sizes.

    Written as one square root over one quotient of whole numbers. Both steps round
    correctly, so cosines that are equal as numbers are equal as doubles and can be
    ordered and compared without rounding them first. Doubles, because the product of the
    degrees of two very popular entities is beyond a BIGINT.
    """
    overlap = common.cast("double")
    return F.sqrt(overlap * overlap / degree_product.cast("double"))


def degree_product(first: str, second: str) -> Column:
    return F.col(first).cast("double") * F.col(second).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NaN, not an error, where the denominator is zero."""
    return F.when(denominator == 0, F.lit(float("nan"))).otherwise(
        numerator.cast("double") / F.when(denominator != 0, denominator.cast("double"))
    )


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def accuracy(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return ratio(tp + tn, tp + tn + fp + fn)


def f1_score(precision_: Column, recall_: Column) -> Column:
    both = precision_ + recall_
    # NaN equals NaN and nothing else is NaN here, so an undefined part stays undefined
    return F.when(F.isnan(both), F.lit(float("nan"))).otherwise(
        ratio(2 * precision_ * recall_, both)
    )


def dominates(better: list[Column], other: list[Column]) -> Column:
    """True where ``better`` is at least ``other`` on every feature both have and above it on one."""
    pairs = list(zip(better, other, strict=True))
    never_below = reduce(lambda a, b: a & b, [F.coalesce(x >= y, F.lit(True)) for x, y in pairs])
    once_above = reduce(lambda a, b: a | b, [F.coalesce(x > y, F.lit(False)) for x, y in pairs])
    return never_below & once_above


def metrics_line(columns: list[str]) -> Column:
    """One text line of the metrics, separated by a comma and a space."""
    return F.concat_ws(", ", *[F.col(c).cast("string") for c in columns])


def feature_text(feature: Column, sim: Column) -> Column:
    """``feature , similarity`` with the word NULL for what is absent."""
    return F.concat_ws(
        " , ",
        F.coalesce(feature.cast("string"), F.lit("NULL")),
        F.coalesce(sim.cast("string"), F.lit("NULL")),
    )
