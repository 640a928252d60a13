"""Neighbours by Pareto dominance over several similarity features.

The input is a feature matrix ``src, dst, f0, f1, …`` with NULL for an absent feature. A
candidate is dominated by another of the same ``src`` that is at least as similar on every
feature and more similar on one. ``missing`` says what an absent feature means: "shared"
compares only features both have, "zero" takes it as similarity 0.

Neighbours are added front by front: the candidates no other remaining one dominates, then
the same among the rest, until a ``src`` has n. Fronts are never cut, so it may get more.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covote.operators.compact import dominators, packed_of
from covote.operators.compact import thin as thinned
from covote.operators.lineage import cut_lineage, stored
from covote.operators.neighbours import check_size
from covote.operators.similarity import feature_columns
from covote.operators.skew import DEFAULT_SKEW, Skew, heavy_keys, key_counts, most_rows, own_slice, tag_heavy

ROUNDS_PER_PLAN = 10
BLOCK_VALUES = 4_000_000  # comparisons held in memory at once by the pandas helper


def pareto_neighbours(
    sims: DataFrame, n: int, *, missing: str = "shared", skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Neighbours of each ``src`` with the front they are in: ``src, dst, layer``."""
    check_size("n", n)
    if missing not in ("shared", "zero"):
        raise ValueError(f'missing must be "shared" or "zero", got {missing!r}')
    names = feature_columns(sims)
    fill = F.lit(0.0) if missing == "zero" else F.lit(None).cast("double")
    points = sims.select("src", "dst", *[F.coalesce(F.col(c), fill).alias(c) for c in names])
    if len(names) == 1:
        return _one_feature(points, n)
    lists = packed_of(sims)
    thin = _thin(points, names, n) if lists is None else lists.by_feature(thinned(n, missing == "zero"))
    if len(names) == 2:
        thin = stored(thin, "candidates")
        if most_rows(thin, "src") > skew.block:
            return _rounds(thin, n, lambda left: dominance_witnesses(left).select("src", "dst"))
        return _two_features(thin, n)
    # of equal vectors all are left, so that none is missed when those reached are looked up
    if lists is None:
        return _many_features(points, names, n, skew)
    return _many_features(stored(thin, "candidates"), names, n, skew, thick=False, pruned=missing == "zero")


def pareto_front(sims: DataFrame, *, missing: str = "shared", skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """The candidates that no other one dominates: ``src, dst``."""
    return pareto_neighbours(sims, 1, missing=missing, skew=skew).select("src", "dst")


def dominated(sims: DataFrame, *, missing: str = "shared", skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """The candidates that some other one dominates: ``src, dst``."""
    if packed_of(sims) is not None and len(feature_columns(sims)) <= 2:
        return dominance_witnesses(sims, missing=missing).select("src", "dst")
    front = pareto_front(sims, missing=missing, skew=skew)
    return sims.select("src", "dst").join(front, ["src", "dst"], "left_anti")


SLICES = 64  # of the first feature, of equal width: similarities are between 0 and 1


def dominance_witnesses(sims: DataFrame, *, missing: str = "shared") -> DataFrame:
    """One dominator for each dominated candidate: ``src, dst, by``, without comparing candidates in pairs.

    Of those that dominate a candidate with both features it is one that has both, if there is one: the
    one with the greatest f1, then f0, then the lowest id. Otherwise it is the one with the greatest
    f0 of those that lack f1, and then of those with the greatest f1 that lack f0. A candidate without f1 has the
    one with the greatest f0, one without f0 that with the greatest f1. For one or two features.

    Equal vectors are one point, named by its lowest id. Points are swept from the greatest f0 down, and
    the best f1 so far goes along with its identity. The sweep runs in slices of f0; a slice begins
    with the best of those before it, so a ``src`` with very many points is dealt over several tasks.
    """
    names = feature_columns(sims)
    if len(names) > 2:
        raise ValueError("witnesses are found for one or two features")
    if missing not in ("shared", "zero"):
        raise ValueError(f'missing must be "shared" or "zero", got {missing!r}')
    lists = packed_of(sims)
    if lists is not None:
        return lists.made(dominators(missing == "zero"), "src long, dst long, by long")
    value = lambda c: (F.col(c) if missing == "shared" else F.coalesce(F.col(c), F.lit(0.0))) if c in names else F.lit(None)
    points = sims.select("src", "dst", *[value(c).cast("double").alias(c) for c in ("f0", "f1")])
    x, y = F.col("f0"), F.col("f1")
    vectors = points.groupBy("src", "f0", "f1").agg(F.min("dst").alias("id"))
    vectors = vectors.withColumn("slice", F.least(F.floor(x * SLICES), F.lit(SLICES)).cast("int"))
    lowest = F.bitwise_not("id")  # greatest for the lowest id
    both = x.isNotNull() & y.isNotNull()

    def best(of: Column, *order: Column) -> Column:
        return F.max(F.when(of, F.struct(*order, lowest.alias("last"), F.col("id").alias("id"))))

    found = {
        "top": best(both, y.alias("f1"), x.alias("f0")),
        "any_x": best(x.isNotNull(), x.alias("f0")),
        "any_y": best(y.isNotNull(), y.alias("f1")),
        "alone_x": best(x.isNotNull() & y.isNull(), x.alias("f0")),
        "alone_y": best(y.isNotNull() & x.isNull(), y.alias("f1")),
    }
    by_slice = vectors.groupBy("src", "slice").agg(*[c.alias(name) for name, c in found.items()])
    whole = Window.partitionBy("src")
    earlier = whole.orderBy(F.col("slice").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    carried = by_slice.select(
        "src",
        F.col("slice").alias("_slice"),
        F.max("top").over(earlier).alias("before"),
        *[F.max(c).over(whole).alias(c) for c in found if c != "top"],
    )
    here = Window.partitionBy("src", "slice").orderBy(x.desc_nulls_last(), y.desc_nulls_last())
    here = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = vectors.withColumn("within", found["top"].over(here)).withColumnRenamed("src", "_src")
    same = (F.col("_src") == F.col("src")) & F.col("slice").eqNullSafe(F.col("_slice"))
    leader = F.greatest("within", "before")
    beaten = (leader["f1"] > y) | ((leader["f1"] == y) & (leader["f0"] > x))
    alone = F.when(F.col("alone_x")["f0"] > x, F.col("alone_x")["id"]).when(F.col("alone_y")["f1"] > y, F.col("alone_y")["id"])
    by = (
        F.when(both, F.when(beaten, leader["id"]).otherwise(alone))
        .when(x.isNotNull(), F.when(F.col("any_x")["f0"] > x, F.col("any_x")["id"]))
        .when(y.isNotNull(), F.when(F.col("any_y")["f1"] > y, F.col("any_y")["id"]))
    )
    beaten_by = swept.join(carried, same).select("src", x.alias("_f0"), y.alias("_f1"), by.alias("by")).where("by IS NOT NULL")
    points = points.withColumnRenamed("src", "_src")
    on = (F.col("_src") == F.col("src")) & F.col("f0").eqNullSafe(F.col("_f0")) & F.col("f1").eqNullSafe(F.col("_f1"))
    return points.join(beaten_by, on).select("src", "dst", "by")


def neighbour_counts(neighbours: DataFrame) -> DataFrame:
    """How many neighbours each ``src`` got."""
    return neighbours.groupBy("src").agg(F.count(F.lit(1)).alias("neighbours"))


def _one_feature(points: DataFrame, n: int) -> DataFrame:
    # a front is added iff fewer than n candidates are better, which is what rank() counts
    order = Window.partitionBy("src").orderBy(F.col("f0").desc())
    return (
        points.withColumn("rank", F.rank().over(order))
        .where(F.col("rank") <= n)
        .select("src", "dst", F.dense_rank().over(order).alias("layer"))
    )


def _thin(points: DataFrame, names: list[str], n: int) -> DataFrame:
    """Drop candidates with n better ones that differ from them in one feature only.

    Such a candidate is never reached, and whatever it dominates the n others dominate too.
    The groups are small, and Spark cuts them before the shuffle, so a ``src`` with very
    many candidates is thinned out before it is gathered.
    """
    for ranked in names:
        others = [c for c in names if c != ranked]
        group = Window.partitionBy("src", *others, F.col(ranked).isNull()).orderBy(F.col(ranked).desc())
        points = points.withColumn("better", F.rank().over(group)).where(F.col("better") <= n)
    return points.drop("better")


def _two_features(points: DataFrame, n: int) -> DataFrame:
    """At most n rounds, each two windows over data that is partitioned and sorted once.

    Every round adds at least one candidate per unfinished ``src`` or changes nothing more.
    """
    x, y = F.col("f0"), F.col("f1")
    points = points.withColumn("layer", F.lit(None).cast("int"))

    everyone = Window.partitionBy("src")
    so_far = everyone.orderBy(x.desc_nulls_last(), y.desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    left = F.col("layer").isNull()
    for round_ in range(1, n + 1):
        # of those with at least this f0, the largest f1, and its f0 where f1 is the same
        leader = F.max(F.when(left & x.isNotNull() & y.isNotNull(), F.struct("f1", "f0"))).over(so_far)
        # a feature that only one of two candidates lacks is decided by the other feature
        points = points.withColumn("leader", leader).withColumns(
            {
                "chosen": F.count("layer").over(everyone),
                "max_x": F.max(F.when(left, x)).over(everyone),
                "max_y": F.max(F.when(left, y)).over(everyone),
                "max_x_alone": F.max(F.when(left & y.isNull(), x)).over(everyone),
                "max_y_alone": F.max(F.when(left & x.isNull(), y)).over(everyone),
            }
        )
        behind = (
            F.when(y.isNull(), F.col("max_x") > x)
            .when(x.isNull(), F.col("max_y") > y)
            .otherwise(
                (F.col("leader") > F.struct("f1", "f0"))
                | F.coalesce(F.col("max_x_alone") > x, F.lit(False))
                | F.coalesce(F.col("max_y_alone") > y, F.lit(False))
            )
        )
        reached = left & (F.col("chosen") < n) & ~behind
        points = points.select(
            "src", "dst", "f0", "f1", F.when(reached, F.lit(round_)).otherwise(F.col("layer")).alias("layer")
        )
        if round_ % ROUNDS_PER_PLAN == 0 and round_ < n:
            points = cut_lineage(points)
    return points.where(F.col("layer").isNotNull()).select("src", "dst", "layer")


def _rounds(points: DataFrame, n: int, dominated_of) -> DataFrame:
    """The fronts one after the other, for any ``src`` size: ``dominated_of(points left)`` are those not in the next front.

    Each round is kept in the shared folder, and only while some ``src`` has fewer than n is there another.
    """
    left, layers = points, []
    for round_ in range(1, n + 1):
        behind = stored(dominated_of(left), "dominated")
        front = stored(left.join(behind, ["src", "dst"], "left_anti").select("src", "dst", F.lit(round_).alias("layer")), "front")
        layers.append(front)
        chosen = reduce(DataFrame.unionByName, layers).groupBy("src").agg(F.count(F.lit(1)).alias("chosen"))
        # an empty front means that those left dominate each other in a circle
        open_ = chosen.where(F.col("chosen") < n).join(front.select("src").distinct(), "src", "left_semi").select("src")
        left = stored(left.join(behind, ["src", "dst"], "left_semi").join(open_, "src", "left_semi"), "left")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, layers)


GRID = 4  # cells of a feature


def _slices(vectors: DataFrame, names: list[str], skew: Skew) -> DataFrame:
    """``vectors`` with the ``slice`` each is in: a cell of a grid, and if that holds more than ``skew.block``, a part of it."""
    cell = F.concat_ws(",", *[F.when(F.col(c) < 0, -1).otherwise(F.floor(F.col(c) * GRID)).cast("string") for c in names])
    placed = vectors.withColumn("spot", F.struct("src", cell.alias("cell")))
    tagged = tag_heavy(placed, "spot", heavy_keys(key_counts(placed, "spot"), "spot", skew))
    part = F.concat_ws("/", F.col("spot.cell"), own_slice(*names).cast("string"))
    return tagged.select(*vectors.columns, part.alias("slice"))


def _dominated_by_slices(names: list[str], skew: Skew):
    """Those of ``src, dst, names`` that are dominated, for a ``src`` of any size.

    Vectors are cut into slices by a grid. What is dominated within its slice goes at once; what is
    left is compared with every slice whose corner of greatest values is not below its own corner of least ones.
    A slice is compared whole, since with absent features a dominated vector may be the only one to dominate another.
    No group holds more than two slices, of about ``skew.block`` vectors each.
    """

    def dominated_of(points: DataFrame) -> DataFrame:
        vectors = points.groupBy("src", *names).agg(F.count(F.lit(1)).alias("size"))
        sliced = stored(_slices(vectors, names, skew), "slices")
        schema = sliced.schema

        def in_front(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf[_dominators(pdf[names].to_numpy(), pdf["size"].to_numpy()) == 0]

        front = stored(sliced.groupBy("src", "slice").applyInPandas(in_front, schema), "local-fronts")
        # an absent feature is never compared, so it bounds nothing
        least = [F.min(F.when(F.col(c) < 0, -1.0).otherwise(F.col(c))).alias(f"least_{c}") for c in names]
        most = [F.max(F.when(F.col(c) < 0, 2.0).otherwise(F.col(c))).alias(f"most_{c}") for c in names]
        mine = front.groupBy("src", "slice").agg(*least)
        other = sliced.groupBy("src", F.col("slice").alias("rival")).agg(*most)
        reach = reduce(lambda a, b: a & b, [F.col(f"most_{c}") >= F.col(f"least_{c}") for c in names])
        pairs = stored(mine.join(other, "src").where(reach & (F.col("slice") != F.col("rival"))).select("src", "slice", "rival"), "slice-pairs")
        left = front.join(pairs, ["src", "slice"])
        right = sliced.withColumnRenamed("slice", "rival").join(pairs, ["src", "rival"])
        right = right.select(*[F.col(c).alias(f"r_{c}") for c in ("src", "slice", "rival")], *names, "size")

        def beaten(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
            own = mine[names].to_numpy()
            both = np.vstack([own, other[names].to_numpy()])
            weight = np.r_[np.zeros(len(own), np.int64), np.ones(len(other), np.int64)]
            return mine[_dominators(both, weight)[: len(own)] > 0][["src", *names]]

        by_rivals = (
            left.groupBy("src", "slice", "rival")
            .cogroup(right.groupBy("r_src", "r_slice", "r_rival"))
            .applyInPandas(beaten, f"src long, {', '.join(f'{c} double' for c in names)}")
            .distinct()
        )
        stay = front.join(by_rivals, ["src", *names], "left_anti").select("src", *names)
        return points.join(stay, ["src", *names], "left_anti").select("src", "dst")

    return dominated_of


def _many_features(points: DataFrame, names: list[str], n: int, skew: Skew, thick: bool = True, pruned: bool = False) -> DataFrame:
    """Three features and more, in pandas on groups that Spark keeps small.

    The groups are distinct vectors, so that ties of any number are one row. First come
    slices of at most ``skew.block`` vectors, to drop those with n better ones; then what is
    left of each ``src``, if this is no more than such a slice for any, and otherwise slices
    against slices, front by front. Points that are not ``thick`` have been thinned before, and of those
    ``pruned`` most with n better ones are gone.
    """
    absent = F.lit(-1.0)  # below every cosine, and unlike NULL it can be grouped and joined on
    filled = [F.coalesce(F.col(c), absent).alias(c) for c in names]
    vectors = (
        (_thin(points, names, n) if thick else points)
        .groupBy("src", *filled)
        .agg(F.count(F.lit(1)).alias("size"))
    )
    has = F.concat(*[(F.col(c) < 0).cast("int").cast("string") for c in names])
    heavy = heavy_keys(key_counts(vectors, "src"), "src", skew)
    sliced = tag_heavy(vectors, "src", heavy).select(
        *vectors.columns, has.alias("has"), own_slice(*names).alias("slice")
    )

    def reachable(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[_dominators(pdf[names].to_numpy(), pdf["size"].to_numpy()) < n]

    def layers(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, size = pdf[names].to_numpy(), pdf["size"].to_numpy()
        layer = np.zeros(len(vectors), dtype=np.int32)
        chosen = round_ = 0
        while chosen < n:
            round_ += 1
            left = np.flatnonzero(layer == 0)
            front = left[_dominators(vectors[left], size[left]) == 0]
            if len(front) == 0:
                break
            layer[front] = round_
            chosen += int(size[front].sum())
        return pdf[["src", *names]].assign(layer=layer)[layer > 0]

    reached = vectors if pruned else sliced.groupBy("src", "has", "slice").applyInPandas(reachable, sliced.schema)
    reached = stored(reached, "reachable")
    if most_rows(reached, "src") > skew.block:
        left = points.select("src", "dst", *filled).join(reached.select("src", *names), ["src", *names], "left_semi")
        return _rounds(stored(left, "candidates"), n, _dominated_by_slices(names, skew))
    layered = reached.groupBy("src").applyInPandas(
        layers, f"src long, {', '.join(f'{c} double' for c in names)}, layer int"
    )
    return (
        points.select("src", "dst", *filled)
        .join(layered, ["src", *names])
        .select("src", "dst", "layer")
    )


def _dominators(vectors: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many rows dominate each vector; a feature that either lacks is not compared."""
    values = np.where(vectors < 0, np.nan, vectors)
    count = np.zeros(len(values), dtype=np.int64)
    step = max(1, BLOCK_VALUES // max(1, values.size))
    for start in range(0, len(values), step):
        other = values[start : start + step, None, :]
        never_below = ~(values[None, :, :] < other).any(axis=2)
        once_above = (values[None, :, :] > other).any(axis=2)
        count[start : start + step] = (never_below & once_above) @ size
    return count
