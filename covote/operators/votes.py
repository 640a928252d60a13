"""Votes for items and the top-k lists cut from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covote.operators.neighbours import check_size
from covote.operators.similarity import binary_pairs, interaction_counts
from covote.operators.skew import (
    DEFAULT_SKEW,
    HeavyKeys,
    Skew,
    all_slices,
    heavy_keys,
    keep_keys,
    key_counts,
    most_rows,
    own_slice,
    salted_join,
    tag_heavy,
)

FEW_TARGETS = 16  # each row of a user is a vote for so many at most
MAX_HEAVY_VOTERS = 4  # their sets are listed, so it stays small


def user_votes(
    neighbours: DataFrame, interactions: DataFrame, *, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """What the neighbours of each user have: ``user, item, votes``.

    Every interaction row of a neighbour is one vote. ``interactions`` need not be the data
    the neighbours were found on.
    """
    if most_rows(interactions, "user") <= skew.block:
        return _plain_votes(interactions, neighbours)
    voters = neighbours.select(F.col("src").alias("target"), F.col("dst").alias("user"))
    counted = interaction_counts(interactions)
    heavy = _heavy(interactions, "user", "item", skew)
    return (
        salted_join(counted, voters, "user", heavy)
        .groupBy(F.col("target").alias("user"), "item")
        .agg(F.sum("times").alias("votes"))
    )


def _plain_votes(interactions: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Votes where no user has many rows: one join, which Spark may split at a neighbour of very many, and one sum."""
    owned = interactions.select(F.col("user").cast("long").alias("voter"), F.col("item").cast("long").alias("item"))
    owned = owned.where(F.col("voter").isNotNull() & F.col("item").isNotNull())
    voters = neighbours.select(F.col("src").alias("user"), F.col("dst").alias("voter"))
    return owned.join(voters, "voter").groupBy("user", "item").agg(F.count(F.lit(1)).alias("votes"))


def top_user_items(
    neighbours: DataFrame,
    interactions: DataFrame,
    k: int,
    *,
    targets: int | None = None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """``top_k(user_votes(neighbours, interactions), k)`` without listing what heavy users have.

    How many rows the heaviest user has is measured first, unless ``targets``, the number of users there are lists
    for, is so small that no row can be voted with often. With up to ``skew.block`` rows a user the
    votes are simply summed; otherwise as follows.

    A user with a large share of all rows may be a neighbour of very many others, and all
    its items would be voted for once for each of them. So for the few heaviest users their
    votes are summed beforehand, per item and per set of heavy users. A target whose
    neighbours include such a set gets the k best items of that set, and the set's votes for
    the items its other neighbours have. Any item left out stands behind those k.
    """
    check_size("k", k)
    if (targets is not None and targets <= FEW_TARGETS) or most_rows(interactions, "user") <= skew.block:
        return top_k(_plain_votes(interactions, neighbours), k)
    bits = MAX_HEAVY_VOTERS
    counted = interaction_counts(interactions)
    heavy = _heavy(interactions, "user", "item", skew)
    tagged = tag_heavy(counted, "user", heavy)
    is_hot = F.coalesce(F.col("place") < bits, F.lit(False))
    bit = F.when(is_hot, F.expr("shiftleft(1, place)")).otherwise(0)
    zero = F.lit(0).cast("long")

    # item -> votes of every set of heavy users, the set being the index
    from_heavy = (
        tagged.where(is_hot)
        .groupBy("item")
        .agg(F.collect_list(F.struct(bit.alias("bit"), "times")).alias("hot"))  # at most ``bits`` entries
        .select(
            "item",
            F.expr(
                f"""transform(sequence(0, {2**bits - 1}), s ->
                aggregate(hot, 0L, (sum, h) -> sum + if((s & h.bit) != 0, h.times, 0L)))"""
            ).alias("by_set"),
        )
    )
    best = (
        from_heavy.select("item", F.posexplode("by_set").alias("set", "votes"))
        .where(F.col("votes") > 0)
        .withColumn("rank", F.row_number().over(Window.partitionBy("set").orderBy(F.col("votes").desc(), "item")))
        .where(F.col("rank") <= k)
        # they take the place of the items of the first user of the set
        .withColumn("place", F.expr("bit_count((`set` & -`set`) - 1)"))
    )
    first_users = heavy.first.where(F.col("place") < bits).select("user", "place")
    stand_ins = best.join(F.broadcast(first_users), "place").select(
        "user",
        "item",
        zero.alias("times"),
        F.array_repeat("votes", 2**bits).alias("by_set"),
        F.col("set").alias("only_set"),
        zero.alias("_cell"),
    )
    ordinary = (
        tagged.where(~is_hot)
        .join(from_heavy, "item", "left")
        .select(
            "user",
            "item",
            "times",
            "by_set",
            F.lit(None).cast("int").alias("only_set"),
            own_slice("item").alias("_cell"),
        )
    )
    # Of the items only one neighbour of a target has, just its k best can be in the list.
    # The window needs no shuffle of its own, it uses the one of the join.
    items = ordinary.unionByName(stand_ins)
    by_times = Window.partitionBy("user", "_cell").orderBy(F.col("times").desc(), "item")
    items = items.withColumn("leads", F.row_number().over(by_times) <= k)
    chosen = neighbours.select(F.col("src").alias("target"), F.col("dst").alias("user"))
    voters = tag_heavy(chosen, "user", heavy)
    slices = F.when(is_hot, F.lit(1)).otherwise(F.col("splits"))
    voters = voters.withColumn("set", F.sum(bit).over(Window.partitionBy("target")).cast("int")).select(
        "target", "user", "set", F.explode(F.sequence(zero, slices - 1)).alias("_cell")
    )
    # A hub, in the lists of very many targets, has these cut into slices as well, and its items
    # are repeated for each. The windows above hide it from Spark's own skew join.
    hubs = heavy_keys(key_counts(chosen, "user"), "user", skew)
    items = tag_heavy(items, "user", hubs).withColumn("_hub_cell", all_slices()).drop("place", "splits")
    voters = tag_heavy(voters, "user", hubs).withColumn("_hub_cell", own_slice("target")).drop("place", "splits")
    votes = (
        items.join(voters, ["user", "_cell", "_hub_cell"])
        .where(F.col("only_set").isNull() | (F.col("only_set") == F.col("set")))
        .groupBy(F.col("target").alias("user"), "item")
        .agg(
            F.sum("times").alias("times"),
            F.max(F.coalesce(F.get("by_set", F.col("set")), zero)).alias("heavy"),
            F.max("leads").alias("leads"),
            F.count(F.lit(1)).alias("voters"),
        )
        .where(F.col("leads") | (F.col("voters") > 1) | (F.col("heavy") > 0))
        .select("user", "item", (F.col("times") + F.col("heavy")).alias("votes"))
    )
    return top_k(votes, k)


def item_votes(
    neighbours: DataFrame, interactions: DataFrame, *, users=None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """The items most like those each user has: ``user, item, votes``, one vote per interaction row."""
    if most_rows(interactions, "item") <= skew.block:
        owned = keep_keys(interactions.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item")), "user", users)
        owned = owned.where(F.col("user").isNotNull() & F.col("item").isNotNull())
        similar = neighbours.select(F.col("src").alias("item"), F.col("dst").alias("similar"))
        return owned.join(similar, "item").groupBy("user", F.col("similar").alias("item")).agg(F.count(F.lit(1)).alias("votes"))
    owned = keep_keys(interaction_counts(interactions), "user", users)
    heavy = _heavy(interactions, "item", "user", skew)
    similar = neighbours.select(F.col("src").alias("item"), F.col("dst").alias("similar"))
    return (
        salted_join(owned, similar, "item", heavy)
        .groupBy("user", F.col("similar").alias("item"))
        .agg(F.sum("times").alias("votes"))
    )


def _heavy(interactions: DataFrame, key: str, other: str, skew: Skew) -> HeavyKeys:
    counts = key_counts(binary_pairs(interactions, key, other), "entity")
    return heavy_keys(counts.withColumnRenamed("entity", key), key, skew)


def drop_seen(votes: DataFrame, interactions: DataFrame) -> DataFrame:
    """Votes for items the user does not have yet."""
    seen = interaction_counts(interactions).select("user", "item")
    return votes.join(seen, ["user", "item"], "left_anti")


def top_k(votes: DataFrame, k: int) -> DataFrame:
    """The ``k`` items with most votes per user, lower ids first among equals: ``user, item, votes, rank``."""
    check_size("k", k)
    order = Window.partitionBy("user").orderBy(F.col("votes").desc(), "item")
    return (
        votes.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("user", "item", "votes", "rank")
    )


def popular_items(interactions: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent items over all users: ``item, votes``."""
    check_size("k", k)
    return (
        interactions.select(F.col("item").cast("long").alias("item"))
        .where(F.col("item").isNotNull())
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("votes"))
        .orderBy(F.col("votes").desc(), "item")
        .limit(k)
    )
