"""Co-occurrence counts and exact cosine similarity between the entities of a pair set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covote.functions.columns import cosine, degree_product
from covote.operators.compact import best_by_feature, feature_matrix, fits, packed, packed_of
from covote.operators.skew import (
    DEFAULT_SKEW,
    Skew,
    all_slices,
    heavy_keys,
    keep_keys,
    key_counts,
    listed,
    most_rows,
    narrowed,
    own_slice,
    tag_heavy,
)


def interaction_counts(
    df: DataFrame, first: str = "user", second: str = "item", *, text: str | None = None
) -> DataFrame:
    """Distinct pairs with ``times``, how often each occurs; rows with a NULL are no interaction.

    Ids are cast to BIGINT, but for the column ``text`` where it holds strings: these are taken whole.

    The one aggregation all operators start from. The grouping order does not depend on
    which column is asked for first, so Spark shuffles the input once for all of them.
    """
    columns = sorted((first, second))
    whole = [c for c, kind in df.select(*columns).dtypes if c == text and kind == "string"]
    return (
        df.select(*[F.col(c) if c in whole else F.col(c).cast("long").alias(c) for c in columns])
        .where(F.col(first).isNotNull() & F.col(second).isNotNull())
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("times"))
        .select(first, second, "times")
    )


def binary_pairs(df: DataFrame, entity: str, basis: str) -> DataFrame:
    """The binary vectors as distinct ``(entity, basis)`` pairs."""
    counted = interaction_counts(df, entity, basis, text=basis)
    # always true; keeps the count in the plan so that it equals the plan the votes use
    return counted.where(F.col("times") > 0).select(
        F.col(entity).alias("entity"), F.col(basis).alias("basis")
    )


def id_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Largest value of each column, one row."""
    return df.agg(*[F.max(F.col(c).cast("long")).alias(f"max_{c}") for c in columns])


CELL = ["basis", "_lo_cell", "_hi_cell"]


def in_cells(tagged: DataFrame, role: str) -> DataFrame:
    """One side of the self-join on ``basis``, with every column but the basis named for its role.

    The members of a popular basis key are cut into slices, and any two slices meet in a
    cell of their own: no task gets more than two slices of one key, however popular.
    """
    other = {"lo": "hi", "hi": "lo"}[role]
    rest = [c for c in tagged.columns if c not in ("basis", "entity", "place", "splits")]
    return tagged.select(
        "basis",
        F.col("entity").alias(role),
        *[F.col(c).alias(f"{c}_{role}") for c in rest],
        own_slice("entity").alias(f"_{role}_cell"),
        all_slices().alias(f"_{other}_cell"),
    )


def meet(lo: DataFrame, hi: DataFrame, targets) -> DataFrame:
    """Join both sides: each pair once (``lo < hi``), or every partner of the wanted ``lo``."""
    wanted = F.col("lo") < F.col("hi") if targets is None else F.col("lo") != F.col("hi")
    return lo.join(hi, CELL).where(wanted)


def both_directions(df: DataFrame) -> DataFrame:
    """Turn ``(lo, hi, …)`` into ``(src, dst, …)`` once each way, in one pass."""
    rest = [c for c in df.columns if c not in ("lo", "hi")]
    return df.select(
        F.inline(
            F.array(
                F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")),
                F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")),
            )
        ),
        *rest,
    )


def sides(df: DataFrame, entity: str, basis: str, targets) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides of the self-join on the basis, and the rows to count the degrees of all entities in them from.

    With ``targets`` the first side has only these. If they have few basis keys between them, the
    second has only the rows of these keys; and if few entities are met on these, the third has only
    the rows of these entities. Each list is short (``skew.LISTED``) or not used at all. The columns
    are those of ``df``; repeated rows are still there.
    """
    if targets is None:
        return df, df, df
    mine = keep_keys(df, entity, listed(df.sparkSession, targets)).select(entity, basis)
    others = narrowed(df, basis, mine)
    return mine, others, df if others is df else narrowed(df, entity, others)


def meetings(df: DataFrame, entity: str, basis: str, targets, skew: Skew, degrees: bool = True) -> DataFrame:
    """One row per pair and basis key they share: ``lo, hi`` and, if asked for, their degrees ``n_lo, n_hi``.

    A key of more than ``skew.block`` members is cut into cells; whether there is one is measured first.
    """
    mine, others, counted = sides(df, entity, basis, targets)
    hi = binary_pairs(others, entity, basis)
    lo = hi if mine is others else binary_pairs(mine, entity, basis)
    cells = most_rows(others, basis) > skew.block
    if cells:
        heavy = heavy_keys(key_counts(hi, "basis"), "basis", skew)
        hi, lo = (tag_heavy(side, "basis", heavy) for side in (hi, lo))
    if degrees:
        degree = key_counts(binary_pairs(counted, entity, basis), "entity")
        hi, lo = (side.join(degree, "entity") for side in (hi, lo))
    if cells:
        return meet(in_cells(lo, "lo"), in_cells(hi, "hi"), targets)
    wanted = F.col("lo") < F.col("hi") if targets is None else F.col("lo") != F.col("hi")
    return named(lo, "lo").join(named(hi, "hi"), "basis").where(wanted)


def named(side: DataFrame, role: str) -> DataFrame:
    """One side of the join on ``basis`` with every other column named for its role."""
    rest = [c for c in side.columns if c not in ("basis", "entity")]
    return side.select("basis", F.col("entity").alias(role), *[F.col(c).alias(f"{c}_{role}") for c in rest])


def packed_lists(df: DataFrame, entity: str, basis: str, targets, skew: Skew) -> DataFrame | None:
    """The packed lists of the keys of each entity, or of the targets; None where the joins are to be used.

    That is if some key or entity is large, or the targets narrow the other side.
    """
    mine, others, counted = sides(df, entity, basis, targets)
    if (targets is not None and others is not df) or not fits(df, entity, basis, skew):
        return None
    hi = binary_pairs(others, entity, basis)
    lo = hi if mine is others else binary_pairs(mine, entity, basis)
    return packed(lo, hi, key_counts(binary_pairs(counted, entity, basis), "entity"))


def cooccurrence(
    df: DataFrame, entity: str, basis: str, *, targets=None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Every pair of entities that share a basis key: ``src, dst, common``.

    Without ``targets`` each pair appears once, with ``src < dst``; with them, once for
    each target it contains, with the target as ``src``.
    """
    met = meetings(df, entity, basis, targets, skew, degrees=False)
    return met.groupBy(F.col("lo").alias("src"), F.col("hi").alias("dst")).agg(F.count(F.lit(1)).alias("common"))


def weighted_meetings(df: DataFrame, entity: str, basis: str, targets, skew: Skew) -> DataFrame:
    """One row ``lo, hi, nn`` per pair and shared basis key; ``nn`` is the product of both degrees."""
    met = meetings(df, entity, basis, targets, skew)
    return met.select("lo", "hi", degree_product("n_lo", "n_hi").alias("nn"))


def directed(df: DataFrame, targets) -> DataFrame:
    """From ``lo, hi`` to ``src, dst``: both ways, or only from the targets."""
    if targets is None:
        return both_directions(df)
    return df.withColumnsRenamed({"lo": "src", "hi": "dst"})


def similarity(
    df: DataFrame, entity: str, basis: str, *, targets=None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """The whole similarity matrix ``src, dst, sim``: symmetric, without diagonal and zeros."""
    lists = packed_lists(df, entity, basis, targets, skew)
    if lists is not None:
        return feature_matrix([lists]).withColumnRenamed("f0", "sim")
    sims = (
        weighted_meetings(df, entity, basis, targets, skew)
        .groupBy("lo", "hi", "nn")
        .agg(F.count(F.lit(1)).alias("common"))
        .select("lo", "hi", cosine(F.col("common"), F.col("nn")).alias("sim"))
    )
    return directed(sims, targets)


def feature_similarity(
    features: list[DataFrame],
    entity: str = "user",
    basis: str = "item",
    *,
    targets=None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """The matrices of several data sets side by side: ``src, dst, f0, f1, …``.

    A feature in which a pair shares nothing is NULL. The overlaps of all features are
    counted in one aggregation.
    """
    if not features:
        raise ValueError("at least one feature is needed")
    lists = [packed_lists(df, entity, basis, targets, skew) for df in features]
    if all(part is not None for part in lists):
        return feature_matrix(lists)
    met = [
        weighted_meetings(df, entity, basis, targets, skew).withColumn("feature", F.lit(i))
        for i, df in enumerate(features)
    ]
    counted = []
    for i in range(len(features)):
        here = F.when(F.col("feature") == i, F.col("nn"))
        counted += [F.count(here).alias(f"common{i}"), F.max(here).alias(f"nn{i}")]
    sims = (
        reduce(DataFrame.unionByName, met)
        .groupBy("lo", "hi")
        .agg(*counted)
        .select(
            "lo",
            "hi",
            *[
                cosine(F.col(f"common{i}"), F.col(f"nn{i}")).alias(f"f{i}")
                for i in range(len(features))
            ],
        )
    )
    return directed(sims, targets)


def feature_columns(sims: DataFrame) -> list[str]:
    return [c for c in sims.columns if c[0] == "f" and c[1:].isdigit()]


def feature_rows(sims: DataFrame) -> DataFrame:
    """The long form ``src, dst, feature, sim`` of a feature matrix, without absent features."""
    names = feature_columns(sims)
    return sims.select(
        "src",
        "dst",
        F.inline(
            F.array(*[F.struct(F.lit(int(c[1:])).alias("feature"), F.col(c).alias("sim")) for c in names])
        ),
    ).where(F.col("sim").isNotNull())


def most_similar(sims: DataFrame, m: int) -> DataFrame:
    """Keep, per feature, the ``m`` most similar of each ``src`` with ties; drop pairs left with none.

    A pre-selection that makes later steps cheaper and may change their result. The features are ranked one
    below the other, so that one window serves all and Spark cuts a ``src`` with very many candidates
    before the shuffle.
    """
    names, lists = feature_columns(sims), packed_of(sims)
    if lists is not None:
        return lists.by_feature(best_by_feature(m))
    rank = F.rank().over(Window.partitionBy("src", "feature").orderBy(F.col("sim").desc()))
    first = feature_rows(sims).withColumn("place", rank).where(F.col("place") <= m)
    return first.groupBy("src", "dst").agg(
        *[F.max(F.when(F.col("feature") == int(c[1:]), F.col("sim"))).alias(c) for c in names]
    )
