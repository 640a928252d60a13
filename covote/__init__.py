"""Collaborative filtering on Spark DataFrames."""

from covote.functions.columns import dominates, feature_text
from covote.operators.evaluate import evaluate, hits, report, unseen
from covote.operators.neighbours import neighbours, top_neighbours
from covote.operators.pareto import dominance_witnesses, dominated, neighbour_counts, pareto_front, pareto_neighbours
from covote.operators.similarity import (
    cooccurrence,
    feature_rows,
    feature_similarity,
    id_bounds,
    interaction_counts,
    most_similar,
    similarity,
)
from covote.operators.skew import Skew
from covote.operators.votes import drop_seen, item_votes, popular_items, top_k, top_user_items, user_votes
from covote.plans.recommend import (
    combine,
    item_neighbours,
    multi_objective_neighbours,
    recommend_from_items,
    recommend_from_users,
    recommend_hybrid,
    recommend_item,
    recommend_multi_objective,
    recommend_user,
    target_users,
    user_neighbours,
)
from covote.sources.chunks import chunk_by_user, number_chunks, write_chunks
from covote.sources.wide import checked_wide, from_rows, parse_wide, read_wide, read_wide_checked, wide_lines, write_pairs
from covote.streaming.deltas import SimilarityStore, replay_in_order
from covote.streaming.replay import chunk_stream, replay_chunks, stored_interactions
