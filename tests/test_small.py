"""Results on the five-user data set."""

import pytest

import covote
from tests import small


@pytest.fixture(scope="module")
def train(spark):
    return covote.from_rows(spark, small.pairs(small.TRAIN))


@pytest.fixture(scope="module")
def test(spark):
    return covote.from_rows(spark, small.pairs(small.TEST))


def grouped(df, key, *values):
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r[key], r["rank"] if "rank" in r else 0)):
        out.setdefault(row[key], []).append(tuple(row[v] for v in values) if len(values) > 1 else row[values[0]])
    return out


@pytest.mark.parametrize("entity,basis,expected", [("user", "item", small.USER_SIM), ("item", "user", small.ITEM_SIM)])
def test_similarity(train, entity, basis, expected):
    got = {(r["src"], r["dst"]): r["sim"] for r in covote.similarity(train, entity, basis).collect()}
    both = expected | {(b, a): s for (a, b), s in expected.items()}
    assert got.keys() == both.keys()
    assert got == pytest.approx(both, abs=1e-11)


def test_neighbours(train):
    assert grouped(covote.user_neighbours(train, 2), "src", "dst") == small.USER_TOP2
    assert grouped(covote.item_neighbours(train, 2), "src", "dst") == small.ITEM_TOP2
    ties = covote.neighbours(covote.similarity(train, "user", "item"), 2, ties=True)
    assert {s: set(d) for s, d in grouped(ties, "src", "dst").items()} == small.USER_TIES2


@pytest.mark.parametrize(
    "recommend,expected",
    [
        (covote.recommend_user, small.USER_RECS),
        (covote.recommend_item, small.ITEM_RECS),
        (covote.recommend_hybrid, small.HYBRID_RECS),
        (lambda df, n, k, **kw: covote.recommend_multi_objective([df], n, k, **kw), small.MO_RECS),
    ],
    ids=["user", "item", "hybrid", "multi-objective"],
)
def test_recommendations(train, spark, recommend, expected):
    assert grouped(recommend(train, 2, 3), "user", "item", "votes") == expected
    some = {u: r for u, r in expected.items() if u in (2, 4)}
    assert grouped(recommend(train, 2, 3, targets=[2, 4]), "user", "item", "votes") == some
    wanted = spark.createDataFrame([(2,), (4,)], "id int")
    assert grouped(recommend(train, 2, 3, targets=wanted), "user", "item", "votes") == some


def test_exclude_seen(train):
    seen = set(small.pairs(small.TRAIN))
    everything = grouped(covote.recommend_user(train, 2, 99), "user", "item", "votes")
    fresh = grouped(covote.recommend_user(train, 2, 3, exclude_seen=True), "user", "item", "votes")
    assert fresh == {
        u: left[:3] for u, recs in everything.items() if (left := [r for r in recs if (u, r[0]) not in seen])
    }


@pytest.mark.parametrize("n,missing", small.PARETO)
def test_two_feature_pareto(spark, train, n, missing):
    second = covote.from_rows(spark, small.SECOND)
    got = covote.multi_objective_neighbours([train, second], n, missing=missing)
    assert {s: set(d) for s, d in grouped(got, "src", "dst").items()} == small.PARETO[n, missing]


@pytest.mark.parametrize("method", small.METRICS)
def test_evaluation(train, test, method):
    recs = {
        "user": covote.recommend_user,
        "item": covote.recommend_item,
        "hybrid": covote.recommend_hybrid,
        "mo": lambda df, n, k: covote.recommend_multi_objective([df], n, k),
    }[method](train, 2, 3)
    row = covote.evaluate(recs, test).first()
    assert tuple(row)[:7] == pytest.approx(small.METRICS[method], abs=1e-6)
    assert row["accuracy"] == pytest.approx(row["tp"] / (row["tp"] + row["fp"] + row["fn"]))


def test_report_line(train, test):
    line = covote.report(covote.evaluate(covote.recommend_user(train, 2, 3), test)).first()["value"]
    assert line == "6.0, 9.0, 0.0, 3.0, 0.4, 0.6666666666666666, 0.5"
