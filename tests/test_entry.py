"""The registered queries against their SQL, where DuckDB and the test tables are at hand.

By default a query of each kind; COVOTE_ALL=1 runs them all.
"""

import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from covote.plans import catalogue, oracle

DATA = Path("/root/testdata/sf0.001")
SOME = [
    "read_wide", "chunk_by_user", "left_outer_interactions", "item_similarity", "item_neighbours_target",
    "rec_user_cf_unseen", "event_neighbours_with_ties", "feature_text", "unseen_items", "evaluation_report",
    "evaluate_multi_objective", "rec_item_cf_other_data", "rec_hybrid_target", "most_similar", "mo_neighbours_shared",
    "mo_neighbours_three_features", "evaluate_item_cf", "dominance_pairs", "replay_neighbours", "read_wide_rejects",
    "rec_hybrid_literal", "rec_multi_objective_preselected",
]
duckdb = pytest.importorskip("duckdb")


def test_every_query_has_its_sql():
    assert catalogue.QUERIES.keys() == oracle.statements().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.skipif(not DATA.is_dir(), reason="test tables are not here")
@pytest.mark.parametrize("name", oracle.statements() if os.environ.get("COVOTE_ALL") else SOME)
def test_query_equals_sql(spark, name):
    tables = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        tables.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got = contract.queries()[name](spark, str(DATA)).toPandas()
    expected = tables.execute(contract.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    order = sorted(got.columns)
    got, expected = (df[order].sort_values(order).reset_index(drop=True) for df in (got, expected))
    assert len(got) == len(expected) > 0
    for column in order:
        assert got[column].equals(expected[column].astype(got[column].dtype)), column


@pytest.mark.skipif(not DATA.is_dir(), reason="test tables are not here")
def test_entry(spark):
    recs = contract.entry(spark)
    assert recs.columns == ["user", "item", "votes", "rank"]
    assert recs.count() > 0
