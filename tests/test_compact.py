"""Overlaps counted from packed lists, against the joins and plain Python."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

import covote
from covote.operators import compact
from covote.operators.skew import Skew

JOINS = Skew(wide=1)  # every shared key is wide, so nothing is packed
FAR = [-(1 << 62), -5, 0, 3, 70_000, 1 << 62]


def pairs(seed, users=40, items=25, rows=300):
    """Repeated rows, ids below zero and far apart, and rows with a NULL."""
    draw = random.Random(seed)
    ids = FAR + list(range(100, 100 + users - len(FAR)))
    return [(draw.choice(ids), draw.randrange(-3, items)) for _ in range(rows)] + [(None, 1), (7, None)]


def frames(spark, count):
    base = pairs(1)
    return [spark.createDataFrame([p for k, p in enumerate(base) if k % (f + 1) == 0], "user long, item long") for f in range(count)]


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def similarities(base):
    has = defaultdict(set)
    for user, item in base:
        if user is not None and item is not None:
            has[user].add(item)
    return {
        (a, b): math.sqrt(len(x & y) ** 2 / (len(x) * len(y)))
        for a, x in has.items() for b, y in has.items() if a != b and x & y
    }


def test_numbers_of_any_size_are_packed():
    values = np.array([0, 1, 127, 128, 300, 1 << 14, (1 << 35) + 9, (1 << 64) - 1], np.uint64)
    data, size = compact.varints(values)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 6, 10]
    assert compact.numbers(data).tolist() == values.tolist()


def test_nth_value_keeps_ties_apart_from_near_ones():
    s, value = np.array([0, 0, 0, 2, 2, 2, 2]), np.array([0.5, 0.5 + 1e-12, 0.5, 1.0, 0.25, 0.25, 0.125])
    assert compact.nth(s, value, 2, 3).tolist() == [0.5, -np.inf, 0.25]
    assert compact.nth(s, value, 4, 3).tolist() == [-np.inf, -np.inf, 0.125]


@pytest.mark.parametrize("ties", [False, True])
def test_lists_are_those_of_plain_python_and_of_the_index(spark, ties):
    (df,) = frames(spark, 1)
    found = covote.user_neighbours(df, 3, ties=ties)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # no row for each meeting
    by = defaultdict(list)
    for (a, b), sim in similarities(pairs(1)).items():
        by[a].append((-sim, b))
    expected = []
    for a, of in by.items():
        for k, (sim, b) in enumerate(sorted(of)):
            rank = 1 + sum(x < sim for x, _ in of) if ties else k + 1
            if rank <= 3:
                expected.append((b, rank, -sim, a))
    assert rows(found) == sorted(expected, key=repr)
    assert rows(found) == rows(covote.user_neighbours(df, 3, ties=ties, skew=JOINS))
    some = spark.createDataFrame([(a,) for a in [*FAR, 100, 101, None]], "user long")
    wanted = [r for r in rows(found) if r[-1] in {*FAR, 100, 101}]
    assert rows(covote.user_neighbours(df, 3, ties=ties, targets=some)) == wanted


def test_matrix_with_text_and_targets(spark):
    (df,) = frames(spark, 1)
    text = df.selectExpr("user", "concat('x', item) AS item")
    expected = sorted(((b, sim, a) for (a, b), sim in similarities(pairs(1)).items()), key=repr)
    assert rows(covote.similarity(df, "user", "item")) == rows(covote.similarity(text, "user", "item")) == expected


@pytest.mark.parametrize("count", [1, 2, 3])
def test_several_features_are_those_of_the_joins(spark, count):
    features = frames(spark, count)
    sims, joined = covote.feature_similarity(features), covote.feature_similarity(features, skew=JOINS)
    assert compact.packed_of(sims) is not None and compact.packed_of(joined) is None
    assert sims.columns == joined.columns and rows(sims) == rows(joined)
    assert rows(covote.most_similar(sims, 2)) == rows(covote.most_similar(joined, 2))
    for missing in ("shared", "zero"):
        for n in (1, 4):
            kept, wanted = (covote.pareto_neighbours(x, n, missing=missing) for x in (sims, joined))
            assert rows(kept) == rows(wanted)
        assert rows(covote.dominated(sims, missing=missing)) == rows(covote.dominated(joined, missing=missing))
        if count < 3:
            by, wanted = (covote.dominance_witnesses(x, missing=missing) for x in (sims, joined))
            assert rows(by) == rows(wanted)


def test_whole_groups_and_single_members():
    import pyarrow as pa

    batch = lambda b, e: pa.RecordBatch.from_arrays(
        [pa.array(b), pa.array(e), pa.array([1] * len(b), pa.int64()), pa.array([True] * len(b))], ["basis", "entity", "n", "asks"]
    )
    batches = [batch([1, 1], [4, 6]), batch([1, 2], [9, 4]), batch([3, 3], [6, 4611686018427387904])]
    out = [(s, compact.numbers(np.frombuffer(b, np.uint8)).tolist()) for x in compact.pack(iter(batches)) for s, b in zip(*x.to_pydict().values())]
    assert out == [(e, [8, 1, 2, 1, 3, 1]) for e in (4, 6, 9)] + [(e, [12, 1, (1 << 62) - 6, 1]) for e in (6, 1 << 62)]
