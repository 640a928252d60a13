"""Pareto neighbours against the rounds written out in Python."""

import random

import pytest
from pyspark.sql import functions as F

import covote
from covote import Skew


def better(a, b, missing):
    above = False
    for x, y in zip(a, b, strict=True):
        if missing == "zero":
            x, y = x or 0.0, y or 0.0
        if x is None or y is None:
            continue
        if x < y:
            return False
        above |= x > y
    return above


def rounds(rows, n, missing):
    out = set()
    for src in {r[0] for r in rows}:
        left, got, layer = [r for r in rows if r[0] == src], 0, 0
        while got < n:
            layer += 1
            front = [r for r in left if not any(better(o[2:], r[2:], missing) for o in left)]
            if not front:
                break
            out |= {(src, r[1], layer) for r in front}
            got += len(front)
            left = [r for r in left if r not in front]
    return out


def candidates(seed, features):
    rng = random.Random(seed)
    levels = [None, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
    rows = [
        (src, dst, *[rng.choice(levels) for _ in range(features)])
        for src in range(20)
        for dst in range(100, 100 + rng.randint(1, 40))
    ]
    return [r for r in rows if any(v is not None for v in r[2:])]


@pytest.mark.parametrize("missing", ["shared", "zero"])
@pytest.mark.parametrize("features,n", [(1, 3), (2, 1), (2, 4), (2, 13), (3, 1), (3, 4), (4, 6)])
def test_against_rounds(spark, features, n, missing):
    rows = candidates(features * 100 + n, features)
    columns = ", ".join(f"f{i} double" for i in range(features))
    sims = spark.createDataFrame(rows, f"src long, dst long, {columns}")
    expected = rounds([r for r in rows if features > 1 or r[2] is not None], n, missing)
    sliced = features > 1 and (n == 1 or (n == 4 and missing == "zero"))
    for skew in (Skew(), Skew(block=5)) if sliced else (Skew(),):
        got = {tuple(r) for r in covote.pareto_neighbours(sims, n, missing=missing, skew=skew).collect()}
        assert got == expected


def test_front_and_dominated_split_the_candidates(spark):
    rows = candidates(9, 2)
    sims = spark.createDataFrame(rows, "src long, dst long, f0 double, f1 double")
    front = {tuple(r) for r in covote.pareto_front(sims).collect()}
    rest = {tuple(r) for r in covote.dominated(sims).collect()}
    assert front == {r[:2] for r in rounds(rows, 1, "shared")}
    assert front | rest == {r[:2] for r in rows} and not front & rest
    counts = {r["src"]: r["neighbours"] for r in covote.neighbour_counts(covote.pareto_front(sims)).collect()}
    assert sum(counts.values()) == len(front)


def test_dominates_expression(spark):
    from pyspark.sql import functions as F

    vectors = [(0.5, 0.5), (0.5, 0.4), (0.5, None), (None, 0.6), (0.6, 0.1), (None, None)]
    rows = [(*a, *b) for a in vectors for b in vectors]
    df = spark.createDataFrame(rows, "a0 double, a1 double, b0 double, b1 double")
    flag = covote.dominates([F.col("a0"), F.col("a1")], [F.col("b0"), F.col("b1")])
    got = [r["flag"] for r in df.select("*", flag.alias("flag")).collect()]
    assert got == [better(r[:2], r[2:], "shared") for r in rows]


def test_features_are_joined_and_listed(spark):
    first = covote.from_rows(spark, [(1, 1), (2, 1), (3, 2)])
    second = covote.from_rows(spark, [(1, 5), (3, 5), (2, 6), (2, 7), (1, 7)])
    sims = covote.feature_similarity([first, second])
    got = {(r["src"], r["dst"]): (r["f0"], r["f1"]) for r in sims.where("src = 1").collect()}
    assert got == {(1, 2): (1.0, 0.5), (1, 3): (None, pytest.approx(0.5**0.5))}
    long = {(r["dst"], r["feature"], round(r["sim"], 3)) for r in covote.feature_rows(sims).where("src = 1").collect()}
    assert long == {(2, 0, 1.0), (2, 1, 0.5), (3, 1, 0.707)}
    assert {(r["src"], r["dst"]) for r in covote.most_similar(sims, 1).where("src = 1").collect()} == {(1, 2), (1, 3)}
    with pytest.raises(ValueError):
        covote.feature_similarity([])


def test_base_data_decides_the_votes(spark):
    first = covote.from_rows(spark, [(1, 1), (2, 1), (2, 2)])
    second = covote.from_rows(spark, [(1, 9), (2, 9)])
    items = lambda base: {
        (r["user"], r["item"]) for r in covote.recommend_multi_objective([first, second], 1, 5, base=base).collect()
    }
    assert items(0) == {(1, 1), (1, 2), (2, 1)}
    assert items(1) == {(1, 9), (2, 9)}
    plain = covote.recommend_multi_objective([first, second], 1, 5, preselect=5)
    assert {(r["user"], r["item"]) for r in plain.collect()} == items(0)


@pytest.mark.parametrize("missing", ["shared", "zero"])
def test_witnesses_dominate(spark, missing):
    """Every dominated candidate has one witness, which dominates it; ties and absent features included."""
    rng = random.Random(8)
    some = [None, 0.0, 0.25, 0.5, 0.75, 1.0, 0.015625]
    rows = [(src, dst, rng.choice(some), rng.choice(some)) for src in range(12) for dst in range(rng.choice([1, 2, 9, 40]))]
    rows = [r for r in rows if r[2] is not None or r[3] is not None]
    got = covote.dominance_witnesses(spark.createDataFrame(rows, "src long, dst long, f0 double, f1 double"), missing=missing)
    by = {(r["src"], r["dst"]): r["by"] for r in got.collect()}
    vectors = {r[:2]: [0.0 if v is None and missing == "zero" else v for v in r[2:]] for r in rows}

    def beats(q, p):
        both = [(a, b) for a, b in zip(q, p, strict=True) if a is not None and b is not None]
        return all(a >= b for a, b in both) and any(a > b for a, b in both)

    dominated = {k for k, p in vectors.items() if any(j[0] == k[0] and beats(q, p) for j, q in vectors.items())}
    assert set(by) == dominated and got.count() == len(dominated)
    assert all(beats(vectors[k[0], v], vectors[k]) for k, v in by.items())
    one = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.75), (1, 4, 0.75), (1, 5, None)], "src long, dst long, f0 double")
    found = {tuple(r) for r in covote.dominance_witnesses(one, missing=missing).collect()}
    assert found == {(1, 2, 3)} | ({(1, 5, 3)} if missing == "zero" else set())
    with pytest.raises(ValueError):
        covote.dominance_witnesses(covote.feature_similarity([one.select(F.col("src").alias("user"), F.col("dst").alias("item"))] * 3))


def test_preselection_is_cut_before_the_shuffle(spark):
    sims = spark.createDataFrame([(1, d, d / 10, 1 - d / 10) for d in range(10)], "src long, dst long, f0 double, f1 double")
    kept = covote.most_similar(sims, 2)
    assert {tuple(r) for r in kept.collect()} == {(1, 9, 0.9, None), (1, 8, 0.8, None), (1, 0, None, 1.0), (1, 1, None, 0.9)}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")  # before and after the exchange


def test_slices_of_a_large_src_are_small(spark):
    """A grid and, in a full cell, its parts: no group of the front search grows with its ``src``."""
    from covote.operators.pareto import _slices

    rng = random.Random(3)
    rows = [(1, rng.choice([-1.0, rng.random()]), rng.random() / 4, rng.random(), 1) for _ in range(3000)]
    names = ["f0", "f1", "f2"]
    vectors = spark.createDataFrame(rows, "src long, f0 double, f1 double, f2 double, size long")
    sliced = _slices(vectors, names, Skew(block=50))
    sizes = [r["count"] for r in sliced.groupBy("slice").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 100 and len(sizes) > 40
