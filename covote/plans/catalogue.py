"""The registered queries: every operator over whole tables of the test schema.

A user is a customer and an item a part they ordered. The further similarity features are
the returned and the fulfilled lines. Interactions before SPLIT_DATE train, the later ones
are held out. Target queries run for the customers of one market segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import covote
from covote.operators.lineage import scratch_path
from covote.sources.tables import order_interactions, table

N = 10  # neighbours
K = 5  # list length
FRONTS = 2  # neighbours wanted by the Pareto queries
SPLIT_DATE = "2000-01-01"
SEGMENT = "BUILDING"
WORD = "widget"
USERS = [4, 7, 31]  # asked for by their ids


def inter(spark, sf):
    return order_interactions(spark, sf)


def train(spark, sf):
    return order_interactions(spark, sf, f"o_orderdate < timestamp '{SPLIT_DATE}'")


def held_out(spark, sf):
    return order_interactions(spark, sf, f"o_orderdate >= timestamp '{SPLIT_DATE}'")


def features(spark, sf, count=2):
    wanted = [None, "l_returnflag = 'R'", "l_linestatus = 'F'"]
    return [order_interactions(spark, sf, where) for where in wanted[:count]]


def targets(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_mktsegment") == SEGMENT).select("c_custkey")


# sources and sinks


def read_wide(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "wide")
    covote.wide_lines(covote.chunk_by_user(inter(spark, sf))).write.text(path)
    return covote.read_wide(spark, path)


def read_wide_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """How often each bad token occurs, after some lines have been spoilt, and how many pairs are good."""
    path = scratch_path(spark, "spoilt")
    lines = covote.wide_lines(covote.chunk_by_user(inter(spark, sf)))
    user = F.split_part("value", F.lit(","), F.lit(1)).cast("long")
    spoilt = (
        F.when(user % 50 == 0, F.concat(F.lit("u"), "value"))
        .when(user % 50 == 1, F.concat("value", F.lit(",12 ,,99999999999999999999")))
        .otherwise(F.col("value"))
    )
    lines.select(spoilt.alias("value")).write.text(path)
    found = covote.read_wide_checked(spark, path).where(F.col("file").isNotNull())
    return found.groupBy("token", "reason").agg(F.count(F.lit(1)).alias("times"), F.count("item").alias("pairs"))


def write_pairs(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pairs")
    covote.write_pairs(inter(spark, sf), path, format="csv")
    return spark.read.schema("user long, item long").csv(path)


def chunk_by_user(spark: SparkSession, sf: str) -> DataFrame:
    return covote.chunk_by_user(inter(spark, sf))


def number_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return covote.number_chunks([train(spark, sf), held_out(spark, sf)])


def replay_chunks(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "replay")
    covote.write_chunks(covote.chunk_by_user(inter(spark, sf)), f"{path}/chunks")
    stream = covote.chunk_stream(spark, f"{path}/chunks", files_per_batch=8)
    covote.replay_chunks(stream, f"{path}/store", f"{path}/checkpoint").awaitTermination()
    return covote.stored_interactions(spark, f"{path}/store")


def _kept_up(spark, sf):
    """The similarities of users after all chunks, each added in its turn."""
    path = scratch_path(spark, "deltas")
    covote.write_chunks(covote.chunk_by_user(inter(spark, sf)), f"{path}/chunks")
    store = covote.SimilarityStore(f"{path}/store").create(spark)
    covote.replay_in_order(spark, f"{path}/chunks", f"{path}/checkpoint", store.add)
    return store


def replay_neighbours(spark, sf):
    return _kept_up(spark, sf).neighbours(spark, N)


def replay_recommendations(spark, sf):
    store = _kept_up(spark, sf)
    return covote.recommend_from_users(store.neighbours(spark, N), store.interactions(spark), K)


# building blocks


def interaction_counts(spark, sf):
    return covote.interaction_counts(inter(spark, sf))


def target_users(spark, sf):
    return covote.target_users(inter(spark, sf))


def id_bounds(spark, sf):
    return covote.id_bounds(inter(spark, sf), ["user", "item"])


def sum_values(spark, sf):
    return table(spark, sf, "lineitem").agg(F.sum(F.col("l_linenumber").cast("long")).alias("total"))


def count_containing(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").contains(WORD)).agg(F.count(F.lit(1)).alias("lines"))


def left_outer_interactions(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user"))
    events = table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("item"))
    return users.join(events, "user", "left").select("user", F.coalesce("item", F.lit("none")).alias("item"))


def popular_items(spark, sf):
    return covote.popular_items(inter(spark, sf), K)


def cooccurrence(spark, sf):
    return covote.cooccurrence(inter(spark, sf), "user", "item")


def user_similarity(spark, sf):
    return covote.similarity(inter(spark, sf), "user", "item")


def item_similarity(spark, sf):
    return covote.similarity(inter(spark, sf), "item", "user")


def user_neighbours(spark, sf):
    return covote.user_neighbours(inter(spark, sf), N)


def item_neighbours(spark, sf):
    return covote.item_neighbours(inter(spark, sf), N)


def user_neighbours_target(spark, sf):
    return covote.user_neighbours(inter(spark, sf), N, targets=targets(spark, sf))


def item_neighbours_target(spark, sf):
    return covote.item_neighbours(inter(spark, sf), N, targets=targets(spark, sf))


def neighbours_with_ties(spark, sf):
    return covote.user_neighbours(inter(spark, sf), N, ties=True)


def event_neighbours_with_ties(spark, sf):
    """Users by shared event names; nearly all similarities are equal."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("user"), F.col("event_type").alias("item")
    )
    return covote.user_neighbours(events, N, ties=True)


def user_votes(spark, sf):
    data = inter(spark, sf)
    return covote.user_votes(covote.user_neighbours(data, N), data)


def item_votes(spark, sf):
    data = inter(spark, sf)
    return covote.item_votes(covote.item_neighbours(data, N), data)


# recommenders


def rec_user_cf(spark, sf):
    return covote.recommend_user(inter(spark, sf), N, K)


def rec_user_cf_target(spark, sf):
    return covote.recommend_user(inter(spark, sf), N, K, targets=targets(spark, sf))


def rec_user_cf_unseen(spark, sf):
    return covote.recommend_user(inter(spark, sf), N, K, exclude_seen=True)


def rec_user_cf_other_data(spark, sf):
    """Neighbours from the earlier interactions, votes from the later ones."""
    found = covote.user_neighbours(train(spark, sf), N)
    return covote.recommend_from_users(found, held_out(spark, sf), K)


def rec_item_cf(spark, sf):
    return covote.recommend_item(inter(spark, sf), N, K)


def rec_item_cf_target(spark, sf):
    return covote.recommend_item(inter(spark, sf), N, K, targets=targets(spark, sf))


def rec_item_cf_other_data(spark, sf):
    """Item neighbours from the earlier interactions, votes by the later ones."""
    found = covote.item_neighbours(train(spark, sf), N)
    return covote.recommend_from_items(found, held_out(spark, sf), K)


def rec_hybrid(spark, sf):
    return covote.recommend_hybrid(inter(spark, sf), N, K)


def rec_hybrid_target(spark, sf):
    return covote.recommend_hybrid(inter(spark, sf), N, K, targets=targets(spark, sf))


def user_neighbours_literal(spark, sf):
    return covote.user_neighbours(inter(spark, sf), N, targets=USERS)


def item_neighbours_literal(spark, sf):
    return covote.item_neighbours(inter(spark, sf), N, targets=USERS)


def rec_user_cf_literal(spark, sf):
    return covote.recommend_user(inter(spark, sf), N, K, targets=USERS)


def rec_item_cf_literal(spark, sf):
    return covote.recommend_item(inter(spark, sf), N, K, targets=USERS)


def rec_hybrid_literal(spark, sf):
    return covote.recommend_hybrid(inter(spark, sf), N, K, targets=USERS)


def rec_multi_objective_literal(spark, sf):
    return covote.recommend_multi_objective(features(spark, sf), FRONTS, K, targets=USERS)


def rec_item_cf_unseen(spark, sf):
    return covote.recommend_item(inter(spark, sf), N, K, exclude_seen=True)


def rec_hybrid_unseen(spark, sf):
    return covote.recommend_hybrid(inter(spark, sf), N, K, exclude_seen=True)


# several objectives


def feature_similarity(spark, sf):
    return covote.feature_similarity(features(spark, sf))


def feature_text(spark, sf):
    """Both features of every pair as text, read back as numbers."""
    rows = covote.feature_rows(covote.feature_similarity(features(spark, sf)))
    parts = F.split(covote.feature_text(F.col("feature"), F.col("sim")), " , ")
    return rows.select("src", "dst", parts[0].cast("int").alias("feature"), parts[1].cast("double").alias("sim"))


def most_similar(spark, sf):
    return covote.most_similar(covote.feature_similarity(features(spark, sf)), N)


def pareto_front(spark, sf):
    return covote.pareto_front(covote.feature_similarity(features(spark, sf)))


def dominated_candidates(spark, sf):
    return covote.dominated(covote.feature_similarity(features(spark, sf)))


def dominance_pairs(spark, sf):
    """One dominator of each dominated candidate."""
    return covote.dominance_witnesses(covote.feature_similarity(features(spark, sf)))


def dominance_pairs_zero(spark, sf):
    return covote.dominance_witnesses(covote.feature_similarity(features(spark, sf)), missing="zero")


def mo_neighbours_preselected(spark, sf):
    """Fronts among the N most similar by either feature."""
    return covote.multi_objective_neighbours(features(spark, sf), FRONTS, preselect=N)


def rec_multi_objective_preselected(spark, sf):
    return covote.recommend_multi_objective(features(spark, sf), FRONTS, K, preselect=N)


def mo_neighbours_one_feature(spark, sf):
    return covote.multi_objective_neighbours(features(spark, sf, 1), FRONTS)


def mo_neighbours_shared(spark, sf):
    return covote.multi_objective_neighbours(features(spark, sf), FRONTS)


def mo_neighbours_zero(spark, sf):
    return covote.multi_objective_neighbours(features(spark, sf), FRONTS, missing="zero")


def mo_neighbours_three_features(spark, sf):
    return covote.multi_objective_neighbours(features(spark, sf, 3), FRONTS, missing="zero")


def neighbour_counts(spark, sf):
    return covote.neighbour_counts(mo_neighbours_zero(spark, sf))


def rec_multi_objective(spark, sf):
    return covote.recommend_multi_objective(features(spark, sf), FRONTS, K)


def rec_multi_objective_zero(spark, sf):
    return covote.recommend_multi_objective(features(spark, sf), FRONTS, K, missing="zero")


def rec_multi_objective_target(spark, sf):
    return covote.recommend_multi_objective(features(spark, sf), FRONTS, K, targets=targets(spark, sf))


# evaluation


def _trained(spark, sf):
    return covote.recommend_user(train(spark, sf), N, K)


def rec_hits(spark, sf):
    return covote.hits(_trained(spark, sf), held_out(spark, sf))


def unseen_items(spark, sf):
    return covote.unseen(_trained(spark, sf), inter(spark, sf))


def evaluate_user_cf(spark, sf):
    return covote.evaluate(_trained(spark, sf), held_out(spark, sf))


def evaluate_item_cf(spark, sf):
    return covote.evaluate(covote.recommend_item(train(spark, sf), N, K), held_out(spark, sf))


def evaluate_multi_objective(spark, sf):
    """One feature, the interactions before the split."""
    return covote.evaluate(covote.recommend_multi_objective([train(spark, sf)], FRONTS, K), held_out(spark, sf))


def evaluate_hybrid(spark, sf):
    return covote.evaluate(covote.recommend_hybrid(train(spark, sf), N, K), held_out(spark, sf))


def evaluation_report(spark, sf):
    """The seven values of the report line, read back as numbers."""
    line = F.split(F.col("value"), ", ")
    names = ("tp", "fp", "tn", "fn", "precision", "recall", "f1")
    return covote.report(evaluate_user_cf(spark, sf)).select(
        F.size(line).alias("values"), *[line[i].cast("double").alias(c) for i, c in enumerate(names)]
    )


QUERIES = {
    f.__name__: f
    for f in (
        read_wide, read_wide_rejects, write_pairs, chunk_by_user, number_chunks, replay_chunks,
        replay_neighbours, replay_recommendations,
        interaction_counts, target_users, id_bounds, sum_values, count_containing,
        left_outer_interactions, popular_items,
        cooccurrence, user_similarity, item_similarity,
        user_neighbours, item_neighbours, user_neighbours_target, item_neighbours_target,
        neighbours_with_ties, event_neighbours_with_ties, user_votes, item_votes,
        rec_user_cf, rec_user_cf_target, rec_user_cf_unseen, rec_user_cf_other_data,
        rec_item_cf, rec_item_cf_target, rec_item_cf_other_data, rec_hybrid, rec_hybrid_target,
        user_neighbours_literal, item_neighbours_literal, rec_user_cf_literal, rec_item_cf_literal, rec_hybrid_literal,
        rec_multi_objective_literal, rec_item_cf_unseen, rec_hybrid_unseen,
        feature_similarity, feature_text, most_similar, pareto_front, dominated_candidates,
        dominance_pairs, dominance_pairs_zero, mo_neighbours_preselected, rec_multi_objective_preselected,
        mo_neighbours_one_feature, mo_neighbours_shared, mo_neighbours_zero,
        mo_neighbours_three_features, neighbour_counts,
        rec_multi_objective, rec_multi_objective_zero, rec_multi_objective_target,
        rec_hits, unseen_items, evaluate_user_cf, evaluate_item_cf, evaluate_hybrid, evaluate_multi_objective,
        evaluation_report,
    )
}
