"""Neighbour search and votes on random data with very popular keys, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

import covote
from covote import Skew

# every way to treat hot keys, down to splitting and summarising almost all of them
SKEWS = [Skew(), Skew(block=3)]


def hot_rows(seed, users=90):
    """Item 0 holds about a third of all rows, user 0 has nearly every item, some rows repeat."""
    rng = random.Random(seed)
    rows = [(u, 0) for u in range(users)]
    rows += [(u, rng.randint(1, 40)) for u in range(users) for _ in range(rng.randint(1, 3))]
    rows += [(0, i) for i in range(1, 41)] + [(u, 1) for u in range(0, users, 2)]
    return rows + rng.sample(rows, 20) + [(-5, -7), (-6, -7), (-5, 3)]


def brute_similarity(rows, entity):
    sets = defaultdict(set)
    for row in rows:
        sets[row[entity]].add(row[1 - entity])
    out = {}
    for a, x in sets.items():
        for b, y in sets.items():
            if a != b and x & y:
                out[a, b] = math.sqrt(len(x & y) ** 2 / (len(x) * len(y)))
    return out


def brute_neighbours(sims, n):
    lists = defaultdict(list)
    for (a, b), s in sims.items():
        lists[a].append((-s, b))
    return {a: [b for _, b in sorted(found)[:n]] for a, found in lists.items()}


def brute_top(votes, k):
    return {u: sorted(((i, v) for i, v in c.items()), key=lambda r: (-r[1], r[0]))[:k] for u, c in votes.items() if c}


def lists(df, key, *values):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r[key], r["rank"])):
        out[r[key]].append(tuple(r[v] for v in values) if len(values) > 1 else r[values[0]])
    return dict(out)


@pytest.mark.parametrize("skew", SKEWS, ids=str)
def test_hot_keys_do_not_change_results(spark, skew):
    rows = hot_rows(1)
    data = covote.from_rows(spark, rows)
    user_sims, item_sims = brute_similarity(rows, 0), brute_similarity(rows, 1)
    got = {(r["src"], r["dst"]): r["sim"] for r in covote.similarity(data, "user", "item", skew=skew).collect()}
    assert got == user_sims
    counts = covote.cooccurrence(data, "user", "item", skew=skew).collect()
    assert {(r["src"], r["dst"]) for r in counts} == {p for p in user_sims if p[0] < p[1]}

    by_user = brute_neighbours(user_sims, 4)
    by_item = brute_neighbours(item_sims, 4)
    assert lists(covote.user_neighbours(data, 4, skew=skew), "src", "dst") == by_user
    assert lists(covote.item_neighbours(data, 4, skew=skew), "src", "dst") == by_item
    wanted = spark.createDataFrame([(0,), (7,), (-5,), (12345,)], "id long")
    some = covote.user_neighbours(data, 4, targets=wanted, skew=skew)
    assert lists(some, "src", "dst") == {u: by_user[u] for u in (0, 7, -5)}

    owned = Counter(rows)
    votes = defaultdict(Counter)
    for a, found in by_user.items():
        for (u, i), times in owned.items():
            if u in found:
                votes[a][i] += times
    assert lists(covote.recommend_user(data, 4, 5, skew=skew), "user", "item", "votes") == brute_top(votes, 5)
    votes = defaultdict(Counter)
    for (u, i), times in owned.items():
        for similar in by_item.get(i, []):
            votes[u][similar] += times
    assert lists(covote.recommend_item(data, 4, 5, skew=skew), "user", "item", "votes") == brute_top(votes, 5)


@pytest.mark.parametrize("wide", [1, 5, 20])
def test_bounded_search_finds_the_lists(spark, wide):
    """Every key, those of a few users and just the hot ones left out of the pairing."""
    rows, skew = hot_rows(1 + wide), Skew(block=3, wide=wide)
    data = covote.from_rows(spark, rows)
    by_user = brute_neighbours(brute_similarity(rows, 0), 4)
    assert lists(covote.user_neighbours(data, 4, skew=skew), "src", "dst") == by_user
    some = covote.user_neighbours(data, 4, targets=[0, 7, -5, 12345], skew=skew)
    assert lists(some, "src", "dst") == {u: by_user[u] for u in (0, 7, -5)}
    n = 2 if wide == 5 else 6
    by_item = brute_neighbours(brute_similarity(rows, 1), n)
    assert lists(covote.item_neighbours(data, n, skew=skew), "src", "dst") == by_item


def popular_sets(users, seed=5):
    """30 popular items of which each user has five, and an item of few users."""
    rng = random.Random(seed)
    return [(u, i) for u in range(users) for i in [*rng.sample(range(30), 5), 100 + u // 4]]


def test_pairs_of_popular_keys_grow_with_the_users(spark):
    """With the popular keys paired, twice the users would make four times as many pairs."""
    from covote.operators import neighbours

    met, whole = [], neighbours._ranked
    for users in (400, 800):
        rows = popular_sets(users)

        def counted(light, best, shared, *rest):
            met.append(shared.count() + best.count())
            return whole(light, best, shared, *rest)

        neighbours._ranked = counted
        try:
            got = covote.user_neighbours(covote.from_rows(spark, rows), 3, skew=Skew(wide=8))
        finally:
            neighbours._ranked = whole
        if users == 400:
            assert lists(got, "src", "dst") == brute_neighbours(brute_similarity(rows, 0), 3)
    assert met[1] < 2.2 * met[0]


@pytest.mark.parametrize("limit", [0, 2, 40])
def test_short_and_long_lists_of_targets(spark, monkeypatch, limit):
    """Filters, broadcasts and whole sides give the same lists."""
    from covote.operators import skew

    monkeypatch.setattr(skew, "LISTED", limit)
    monkeypatch.setattr(skew, "LITERAL", limit // 2)
    rows = hot_rows(9)
    data = covote.from_rows(spark, rows)
    by_user = brute_neighbours(brute_similarity(rows, 0), 4)
    wanted = spark.createDataFrame([(0,), (7,), (None,), (7,), (12345,)], "id long")
    assert lists(covote.user_neighbours(data, 4, targets=wanted), "src", "dst") == {u: by_user[u] for u in (0, 7)}
    whole = lists(covote.recommend_user(data, 4, 5), "user", "item", "votes")
    assert lists(covote.recommend_user(data, 4, 5, targets=[0, 7]), "user", "item", "votes") == {u: whole[u] for u in (0, 7)}


def test_long_lists_from_hot_classes(spark):
    """All users meet on one item alone: every list is a tie, broken by id."""
    data = covote.from_rows(spark, [(u, 1) for u in range(50)])
    got = lists(covote.user_neighbours(data, 3, skew=Skew(block=4, wide=4)), "src", "dst")
    assert got == {u: [v for v in range(5) if v != u][:3] for u in range(50)}


@pytest.mark.parametrize("seed", range(3))
def test_random_hot_data(spark, seed):
    rows = hot_rows(100 + seed, users=60)
    data = covote.from_rows(spark, rows)
    n = seed + 1
    expected = brute_neighbours(brute_similarity(rows, 0), n)
    got = lists(covote.user_neighbours(data, n, skew=Skew(block=2, wide=seed + 1)), "src", "dst")
    assert got == expected


def test_equal_cosines_are_equal_doubles(spark):
    """3 / sqrt(18) and 1 / sqrt(2) are one number, so the lower id comes first."""
    rows = [(1, i) for i in range(3)] + [(9, i) for i in range(6)]  # 3 / sqrt(18)
    rows += [(2, 100), (9, 100), (8, 0)]
    sims = covote.similarity(covote.from_rows(spark, rows), "user", "item").where("src = 1").collect()
    assert {r["dst"]: r["sim"] for r in sims} == pytest.approx({9: 3 / math.sqrt(21), 8: 1 / math.sqrt(3)})
    rows = [(1, i) for i in range(3)] + [(9, i) for i in range(6)] + [(1, 50), (1, 51), (1, 52), (4, 50), (4, 51), (4, 52)]
    rows += [(4, 200), (4, 201), (4, 202)]
    sims = covote.similarity(covote.from_rows(spark, rows), "user", "item").where("src = 1").collect()
    assert len({r["sim"] for r in sims}) == 1


def test_similarity_properties(spark):
    sims = {(r["src"], r["dst"]): r["sim"] for r in covote.similarity(covote.from_rows(spark, hot_rows(2)), "item", "user").collect()}
    assert all(a != b and 0 < s <= 1 and sims[b, a] == s for (a, b), s in sims.items())


def test_ties_contain_the_plain_list(spark):
    sims = covote.similarity(covote.from_rows(spark, hot_rows(3)), "user", "item")
    plain = {(r["src"], r["dst"]) for r in covote.neighbours(sims, 3).collect()}
    with_rank = {(r["src"], r["dst"], r["rank"]) for r in covote.neighbours(sims, 3, ties=True).collect()}
    ties = {r[:2] for r in with_rank}
    one_feature = {tuple(r) for r in covote.pareto_neighbours(sims.withColumnRenamed("sim", "f0"), 3).collect()}
    assert plain < ties
    assert ties == {r[:2] for r in one_feature}
    data = covote.from_rows(spark, hot_rows(3))
    for skew in (Skew(), Skew(block=3, wide=4)):
        got = covote.user_neighbours(data, 3, ties=True, skew=skew).collect()
        assert {(r["src"], r["dst"], r["rank"]) for r in got} == with_rank
        assert len(got) == len(with_rank)
        assert {tuple(r) for r in covote.multi_objective_neighbours([data], 3, skew=skew).collect()} == one_feature
    first = {r[:2] for r in one_feature if r[2] == 1}
    got = covote.multi_objective_neighbours([data], 3, preselect=1).collect()
    assert {(r["src"], r["dst"]) for r in got} == first


def test_hybrid_votes_are_one_or_two(spark):
    recs = covote.recommend_hybrid(covote.from_rows(spark, hot_rows(4)), 3, 4).collect()
    assert {r["votes"] for r in recs} == {1, 2}
    assert max(Counter(r["user"] for r in recs).values()) == 4


def test_popular_items(spark):
    rows = hot_rows(5)
    expected = sorted(Counter(i for _, i in rows).items(), key=lambda r: (-r[1], r[0]))[:6]
    assert [tuple(r) for r in covote.popular_items(covote.from_rows(spark, rows), 6).collect()] == expected


def test_neighbours_and_votes_from_different_data(spark):
    old = covote.from_rows(spark, [(1, 1), (2, 1), (3, 2), (2, 2)])
    new = covote.from_rows(spark, [(2, 8), (2, 9), (2, 9), (3, 7)])
    recs = covote.recommend_from_users(covote.user_neighbours(old, 1), new, 2)
    assert lists(recs, "user", "item", "votes") == {1: [(9, 2), (8, 1)], 3: [(9, 2), (8, 1)]}


def test_empty_input_and_bad_sizes(spark):
    empty = covote.from_rows(spark, [])
    for recs in (covote.recommend_user(empty, 2, 3), covote.recommend_hybrid(empty, 2, 3)):
        assert recs.columns == ["user", "item", "votes", "rank"]
        assert recs.count() == 0
    for n, k in ((0, 3), (2, 0), (-1, 1), (1.5, 2)):
        with pytest.raises(ValueError):
            covote.recommend_user(empty, n, k)
    with pytest.raises(ValueError):
        covote.multi_objective_neighbours([empty], 0)
    with pytest.raises(ValueError):
        covote.pareto_neighbours(covote.feature_similarity([empty]), 1, missing="none")


def test_degrees_beyond_a_bigint_product(spark):
    from pyspark.sql import functions as F

    from covote.functions.columns import cosine, degree_product

    big = spark.createDataFrame([(4 * 10**9, 9 * 10**9, 10**9)], "n_lo long, n_hi long, common long")
    sim = big.select(cosine(F.col("common"), degree_product("n_lo", "n_hi"))).first()[0]
    assert sim == pytest.approx(1 / 6)


def test_text_items_are_taken_whole(spark):
    """Words of one first letter are different items."""
    df = spark.createDataFrame([(1, "view"), (2, "vote"), (3, "view")], "user long, item string")
    assert {(r.src, r.dst) for r in covote.similarity(df, "user", "item").collect()} == {(1, 3), (3, 1)}


@pytest.mark.parametrize("broadcast", [1, 3])
def test_more_heavy_keys_than_are_broadcast(spark, monkeypatch, broadcast):
    """Every key beyond a block is split, also those whose slices come from a join."""
    from covote.operators import skew

    monkeypatch.setattr(skew, "MAX_BROADCAST_KEYS", broadcast)
    rows = hot_rows(6, users=50)
    data = covote.from_rows(spark, rows)
    small = Skew(block=2, wide=3)
    pairs = data.distinct()
    heavy = skew.heavy_keys(skew.key_counts(pairs, "item"), "item", small)
    assert heavy.first.count() == broadcast
    members = Counter(i for _, i in set(rows))
    tagged = skew.tag_heavy(pairs, "item", heavy)
    got = tagged.withColumn("slice", skew.own_slice("user")).collect()
    assert sorted((r["user"], r["item"]) for r in got) == sorted(set(rows))
    assert {r["item"]: r["splits"] for r in got} == {i: max(1, math.ceil(n / 2)) for i, n in members.items()}
    assert all(0 <= r["slice"] < r["splits"] for r in got)

    by_user = brute_neighbours(brute_similarity(rows, 0), 4)
    assert lists(covote.user_neighbours(data, 4, skew=small), "src", "dst") == by_user
    got = {(r["src"], r["dst"]): r["sim"] for r in covote.similarity(data, "item", "user", skew=small).collect()}
    assert got == brute_similarity(rows, 1)


@pytest.mark.parametrize("skew", SKEWS, ids=str)
def test_one_neighbour_of_all(spark, skew):
    """A user in the list of everybody is joined in slices of its targets."""
    from covote.operators.votes import top_user_items

    rows = [(0, i) for i in range(12)] + [(1, 3), (1, 3), (1, 20), (2, 20)]
    near = [(t, 0) for t in range(100, 140)] + [(t, 1) for t in range(100, 140, 3)] + [(100, 2)]
    votes = defaultdict(Counter)
    for t, v in near:
        votes[t].update(i for u, i in rows if u == v)
    neighbours = spark.createDataFrame(near, "src long, dst long")
    got = top_user_items(neighbours, covote.from_rows(spark, rows), 3, skew=skew)
    assert lists(got, "user", "item", "votes") == brute_top(votes, 3)
