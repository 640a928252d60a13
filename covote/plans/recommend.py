"""The recommenders, each one lazy plan from interactions to top-k lists.

``targets`` restricts a plan to some users: None for all, a few literal ids, or a
one-column DataFrame of any size. The lists are those of the full run for these users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covote.operators.lineage import stored
from covote.operators.neighbours import check_size, top_neighbours
from covote.operators.pareto import pareto_neighbours
from covote.operators.similarity import feature_similarity, most_similar
from covote.operators.skew import DEFAULT_SKEW, Skew, keep_keys, listed
from covote.operators.votes import drop_seen, item_votes, top_k, top_user_items, user_votes


BROADCAST_ROWS = 100_000  # of two numbers, that go to every task


def target_users(interactions: DataFrame) -> DataFrame:
    """All users there is data for."""
    return interactions.select(F.col("user").cast("long").alias("user")).where("user is not null").distinct()


def user_neighbours(
    interactions: DataFrame, n: int, *, ties: bool = False, targets=None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """The ``n`` users most like each user, with ``ties`` also those as similar as the n-th."""
    return top_neighbours(interactions, "user", "item", n, ties=ties, targets=targets, skew=skew)


def item_neighbours(
    interactions: DataFrame, n: int, *, ties: bool = False, targets=None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """The ``n`` items most like each item; with ``targets`` only for the items these users have."""
    if targets is not None:
        targets = keep_keys(interactions.select("user", "item"), "user", listed(interactions.sparkSession, targets))
        targets = targets.select("item").distinct()
    return top_neighbours(interactions, "item", "user", n, ties=ties, targets=targets, skew=skew)


def recommend_from_users(
    neighbours: DataFrame,
    interactions: DataFrame,
    k: int,
    *,
    targets: int | None = None,
    exclude_seen: bool = False,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Top-k lists from the items of given neighbours, e.g. ones found earlier or on other data.

    ``targets`` is the number of users these are the neighbours of, where it is known.
    """
    if exclude_seen:
        return top_k(drop_seen(user_votes(neighbours, interactions, skew=skew), interactions), k)
    return top_user_items(neighbours, interactions, k, targets=targets, skew=skew)


def recommend_from_items(
    neighbours: DataFrame,
    interactions: DataFrame,
    k: int,
    *,
    targets=None,
    exclude_seen: bool = False,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Top-k lists from given neighbours of the items each user has."""
    votes = item_votes(neighbours, interactions, users=targets, skew=skew)
    return top_k(drop_seen(votes, interactions) if exclude_seen else votes, k)


def recommend_user(
    interactions: DataFrame,
    n: int,
    k: int,
    *,
    targets=None,
    exclude_seen: bool = False,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """User-based collaborative filtering: ``user, item, votes, rank``."""
    if targets is not None:
        targets = listed(interactions.sparkSession, targets)
    found = user_neighbours(interactions, n, targets=targets, skew=skew)
    few = len(targets) if isinstance(targets, list) else None
    if few is not None and few * n <= BROADCAST_ROWS:
        found = F.broadcast(found)  # n rows for each of these targets at most
    return recommend_from_users(found, interactions, k, targets=few, exclude_seen=exclude_seen, skew=skew)


def recommend_item(
    interactions: DataFrame,
    n: int,
    k: int,
    *,
    targets=None,
    exclude_seen: bool = False,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Item-based collaborative filtering: ``user, item, votes, rank``."""
    if targets is not None:
        targets = listed(interactions.sparkSession, targets)
    found = item_neighbours(interactions, n, targets=targets, skew=skew)
    return recommend_from_items(
        found, interactions, k, targets=targets, exclude_seen=exclude_seen, skew=skew
    )


def combine(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Vote again over two finished lists: an item counts two if it is in both."""
    both = first.select("user", "item").unionByName(second.select("user", "item"))
    return top_k(both.groupBy("user", "item").agg(F.count(F.lit(1)).alias("votes")), k)


def recommend_hybrid(
    interactions: DataFrame,
    n: int,
    k: int,
    *,
    targets=None,
    exclude_seen: bool = False,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """User-based and item-based lists combined: ``user, item, votes, rank`` with votes 1 or 2."""
    if targets is not None:
        targets = listed(interactions.sparkSession, targets)
    options = dict(targets=targets, exclude_seen=exclude_seen, skew=skew)
    # one after the other, so that what is shuffled for one is gone before the other begins
    first = stored(recommend_user(interactions, n, k, **options), "user-lists")
    return combine(first, stored(recommend_item(interactions, n, k, **options), "item-lists"), k)


def multi_objective_neighbours(
    features: list[DataFrame],
    n: int,
    *,
    missing: str = "shared",
    preselect: int | None = None,
    targets=None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Pareto neighbours of each user over one similarity per data set: ``src, dst, layer``.

    ``preselect`` keeps only that many most similar users per feature, with ties, before
    the fronts are formed; it saves work and may change the result.
    """
    if preselect is not None:
        check_size("preselect", preselect)
    if len(features) == 1:  # the fronts are the levels of similarity, and none is cut
        found = user_neighbours(features[0], n, ties=True, targets=targets, skew=skew)
        level = Window.partitionBy("src").orderBy(F.col("sim").desc())
        layers = found.select("src", "dst", F.dense_rank().over(level).alias("layer"), "rank")
        return layers.where(F.col("rank") <= (preselect or n)).drop("rank")
    sims = feature_similarity(features, targets=targets, skew=skew)
    if preselect is not None:
        sims = most_similar(sims, preselect)
    return pareto_neighbours(sims, n, missing=missing, skew=skew)


def recommend_multi_objective(
    features: list[DataFrame],
    n: int,
    k: int,
    *,
    base: int = 0,
    missing: str = "shared",
    preselect: int | None = None,
    targets=None,
    exclude_seen: bool = False,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """User-based lists with Pareto neighbours; the votes come from ``features[base]``."""
    found = multi_objective_neighbours(
        features, n, missing=missing, preselect=preselect, targets=targets, skew=skew
    )
    return recommend_from_users(found, features[base], k, exclude_seen=exclude_seen, skew=skew)
