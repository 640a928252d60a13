"""Nearest neighbours by cosine similarity."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covote.functions.columns import cosine, degree_product
from covote.operators.compact import best, fits, packed, side_by_side
from covote.operators.lineage import stored
from covote.operators.similarity import binary_pairs, both_directions, named, sides
from covote.operators.skew import (
    DEFAULT_SKEW,
    Skew,
    heavy_keys,
    keep_keys,
    key_counts,
    most_rows,
    salted_join,
    tag_heavy,
)


def check_size(name: str, value: int) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise ValueError(f"{name} must be a whole number of at least 1, got {value!r}")


def _place(group: list[str], best_first, id_: str, ties: bool) -> Column:
    """Place within a group; with ties, equals share one, and otherwise the lower id is first."""
    window = Window.partitionBy(*group)
    if ties:
        return F.rank().over(window.orderBy(best_first))
    return F.row_number().over(window.orderBy(best_first, id_))


def neighbours(sim: DataFrame, n: int, *, ties: bool = False, targets=None) -> DataFrame:
    """The ``n`` most similar entities of each ``src``: ``src, dst, sim, rank``.

    Equal similarities are taken in the order of their ids. With ``ties`` all that are
    as similar as the n-th are kept, and ``rank`` is shared among equals.
    """
    check_size("n", n)
    return (
        keep_keys(sim, "src", targets)
        .withColumn("rank", _place(["src"], F.col("sim").desc(), "dst", ties))
        .where(F.col("rank") <= n)
        .select("src", "dst", "sim", "rank")
    )


def top_neighbours(
    df: DataFrame,
    entity: str,
    basis: str,
    n: int,
    *,
    ties: bool = False,
    targets=None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """``neighbours(similarity(df, entity, basis), n)`` without building the whole matrix.

    Two sizes are measured by jobs of their own before the plan is made: how many basis keys the targets
    have, and how many members the most popular key has.

    *Targets.* Few keys restrict the other side of the join to the rows of these keys, and few
    entities met there restrict the rows whose degrees are counted. Each list goes along only while it
    is short (``skew.LISTED``); beyond that the whole side is taken, with the same result.

    *Popular keys.* Pairing all members of a basis key costs the square of its popularity. Keys of at
    most ``skew.wide`` members are paired, which is linear in the rows. The others are an inverted index
    that is probed for each class of entities with the same wide keys (see ``_wide_candidates``).
    """
    check_size("n", n)
    mine, others, counted = sides(df, entity, basis, targets)
    hi = binary_pairs(others, entity, basis)
    lo = hi if mine is others else binary_pairs(mine, entity, basis)
    degree = key_counts(binary_pairs(counted, entity, basis), "entity")
    # repeated rows may make a key look wider than it is, so only wide ones are counted again
    if most_rows(others, basis) > skew.wide and most_rows(hi, "basis") > skew.wide:
        return _bounded(lo, hi, degree, n, ties, targets is not None, skew)

    if others is df and fits(df, entity, basis, skew):
        return side_by_side([packed(lo, hi, degree)]).made(best(n, ties), "src long, dst long, sim double, rank int")

    # Of those an entity meets on one key only, just the n + 1 members of this key with the lowest
    # degree can be in its list; the rest is dropped before ranking.
    first = named(hi.join(degree, "entity"), "hi")
    first = first.withColumn("near_hi", _place(["basis"], "n_hi", "hi", ties) <= n + 1)
    if targets is None:
        second = first.withColumnsRenamed({"hi": "lo", "n_hi": "n_lo", "near_hi": "near_lo"})
    else:
        second = named(lo.join(degree, "entity"), "lo").withColumn("near_lo", F.lit(False))
    found = _meetings(second, first, targets is not None, F.col("near_lo").cast("int") + 2 * F.col("near_hi").cast("int"))
    found = found.groupBy("lo", "hi", "nn").agg(F.count(F.lit(1)).alias("common"), F.max("near").alias("near"))
    # whether lo may be in the list of hi, and hi in that of lo, if one key is all they share
    near = F.when(F.col("common") > 1, F.lit(3)).otherwise(F.col("near"))
    found = found.select("lo", "hi", cosine(F.col("common"), F.col("nn")).alias("sim"), near.alias("near")).where("near > 0")
    if targets is None:
        found = both_directions(found)
        near = F.when(F.col("src") < F.col("dst"), F.col("near") >= 2).otherwise(F.col("near") % 2 == 1)
    else:
        found = found.withColumnsRenamed({"lo": "src", "hi": "dst"})
        near = F.col("near") >= 2
    return neighbours(found.where(near), n, ties=ties)


def _meetings(lo: DataFrame, hi: DataFrame, directed: bool, near: Column) -> DataFrame:
    wanted = F.col("lo") != F.col("hi") if directed else F.col("lo") < F.col("hi")
    return lo.join(hi, "basis").where(wanted).select("lo", "hi", degree_product("n_lo", "n_hi").alias("nn"), near.alias("near"))


# Keys with very many members

CLASS = ["w", "c0", "c1"]  # number of wide keys of an entity, and a 128-bit code of which these are


SMALL = 10  # keys of a class up to which it is listed under sets of them
DEPTH = 4  # keys of such a set
SETS = [(m, at) for m in range(1, DEPTH + 1) for at in combinations(range(SMALL), m)]


def _index(keys: DataFrame) -> DataFrame:
    """The lists each class is in or asks: ``head, n_head, w, m, slot, tail, big, listed``.

    ``slot`` is a code of ``m`` of its keys and ``tail`` the number of keys behind the last of these. Large classes
    have lists of their own (``big``), which all ask with single keys, as large classes do everywhere. A row that
    only asks is not ``listed``.
    """
    small = (
        keys.where(F.col("w") <= SMALL)
        .groupBy("head", "n_head", "w")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("at"), "basis"))).alias("keys"))
    )
    sets = F.array(*[F.struct(F.lit(m).alias("m"), F.array(*map(F.lit, at)).alias("at")) for m, at in SETS])
    small = small.withColumn("set", F.explode(sets)).where(F.element_at("set.at", -1) < F.col("w"))
    members = [F.get("keys", F.get("set.at", F.lit(i))).getField("basis") for i in range(DEPTH)]
    tail = (F.col("w") - F.element_at("set.at", -1) - 1).cast("int")
    code = F.xxhash64(F.col("set.m"), *members)
    small = small.select("head", "n_head", "w", F.col("set.m").alias("m"), code.alias("slot"), tail.alias("tail"))
    large = keys.where(F.col("w") > SMALL).select(
        "head", "n_head", "w", F.lit(1).alias("m"), F.xxhash64(F.lit(1), "basis").alias("slot"), (F.col("left") - 1).cast("int").alias("tail")
    )
    kinds = [(small, False, True), (small.where("m = 1"), True, False), (large, True, True), (large, False, False)]
    return reduce(DataFrame.unionByName, [df.withColumns({"big": F.lit(big), "listed": F.lit(own)}) for df, big, own in kinds])


def _strength(overlap: str, degree: str) -> Column:
    """The square of the similarity times the degree of the one who searches: it orders its list."""
    return (F.col(overlap) * F.col(overlap)).cast("double") / F.col(degree).cast("double")


def _bounded(lo: DataFrame, hi: DataFrame, degree: DataFrame, n: int, ties: bool, directed: bool, skew: Skew) -> DataFrame:
    """The lists where some keys have more than ``skew.wide`` members.

    What is used more than once is kept in the shared folder.
    """
    heavy = heavy_keys(key_counts(hi, "basis"), "basis", Skew(block=skew.wide))
    hi = stored(tag_heavy(hi, "basis", heavy).select("entity", "basis", "splits"), "pairs")
    lo = tag_heavy(lo, "basis", heavy).select("entity", "basis", "splits") if directed else hi
    is_wide = F.col("splits") > 1
    code = lambda seed: F.expr(f"coalesce(bit_xor(if(splits > 1, xxhash64(basis, {seed}), NULL)), 0L)")
    classes = hi.groupBy("entity").agg(F.count_if(is_wide).alias("w"), code(0).alias("c0"), code(1).alias("c1"))
    profile = stored(degree.join(classes, "entity"), "profile")
    if directed:
        # a target's own keys are all on the other side too, so that its class is complete there
        searchers = stored(lo.select("entity").distinct().join(profile, "entity"), "searchers")
    else:
        searchers = profile
    best, overlaps, bound = _wide_candidates(profile, searchers, hi.where(is_wide), n, ties, skew)

    # those who share a key of few members, from both sides
    light = ~is_wide
    first = named(hi.where(light).join(profile, "entity"), "hi")
    second = named(lo.where(light).join(searchers, "entity"), "lo")
    columns = [f"{c}_{role}" for role in ("lo", "hi") for c in ("n", *CLASS)]
    met = (
        second.join(first, "basis")
        .where(F.col("lo") != F.col("hi") if directed else F.col("lo") < F.col("hi"))
        .groupBy("lo", "hi", *columns)
        .agg(F.count(F.lit(1)).alias("cold"))
    )
    if not directed:
        role = {"lo": "hi", "hi": "lo"}
        turned = [F.col(c[:-2] + role[c[-2:]]).alias(c) for c in ("lo", "hi", *columns)]
        met = met.unionByName(met.select(*turned, "cold"))
    return _ranked(met, best, overlaps(met, bound), searchers, n, ties, skew)


def _wide_candidates(profile: DataFrame, searchers: DataFrame, wide: DataFrame, n: int, ties: bool, skew: Skew):
    """Whom each entity may meet on wide keys alone, without pairing the members of a wide key.

    Entities with the same wide keys are a class. They have the same candidates in the same order, and of
    each class only the first n + 1 by degree and id can be in a list (one more than n, because an
    entity may stand in its own). So classes search for classes.

    *Index.* The keys of a class are in order of their popularity, rarest first. A class of at most ``SMALL`` keys is
    listed under every set of up to ``DEPTH`` of its keys, a larger one under each single key.

    *Bound.* The n + 1 classes of lowest degree of each list that a class is in, and its own first members,
    give it n + 1 candidates of known strength; weaker ones need not be found.

    *Probes.* A candidate of degree d is as strong as the bound t only if it shares o >= sqrt(t d) keys. So
    a class visits the lists of those of its sets of m <= o keys behind which it has o - m keys left, for
    each stretch of degrees (by the binary logarithm) from t to w^2 / t: the more keys must be shared, the longer
    the sets and the shorter the lists. Of a list it takes those that can be strong enough with the keys that both have left.
    """
    members = profile.where("w > 0")
    by = F.struct("n", "entity")
    ranked = members.withColumn("place", _place(CLASS, "n", "entity", ties)).where(F.col("place") <= n + 1)
    reps = ranked.select(*CLASS, F.col("entity").alias("dst"), F.col("n").alias("n_dst"))
    heads = members.groupBy(*CLASS).agg(F.min(by).alias("head"))
    heads = stored(heads.select(*CLASS, F.col("head.entity").alias("head"), F.col("head.n").alias("n_head")), "classes")

    order = Window.partitionBy("head").orderBy("splits", "basis")
    keys = wide.join(heads.withColumn("entity", F.col("head")), "entity").select("head", "basis", "splits", "w", "n_head")
    keys = stored(keys.withColumn("left", F.col("w") - F.row_number().over(order) + 1).drop("splits"), "class-keys")
    asking = searchers.where("w > 0").select(*CLASS).distinct().join(heads, CLASS).select("head")

    index = stored(_index(keys), "class-index")
    asked = index.join(asking, "head", "left_semi").withColumnRenamed("head", "src")

    # the bound of each class: its (n + 1)-th best of those known at once
    near = index.where("listed").withColumn("place", _place(["slot", "big"], "n_head", "head", False)).where(F.col("place") <= n + 1)
    near = near.select("slot", "big", F.col("head").alias("cls"), F.col("n_head").alias("n_dst"))
    # one who shares several single keys shares as many, one of a list of sets at least these
    shared = F.greatest(F.sum(F.when(F.col("m") == 1, 1).otherwise(0)), F.max("m").cast("long"))
    known = asked.join(near, ["slot", "big"]).groupBy("src", "cls", "n_dst").agg(shared.alias("c"))
    own = reps.join(heads, CLASS).join(asking, "head", "left_semi")
    own = own.select(F.col("head").alias("src"), F.col("head").alias("cls"), "n_dst", F.col("w").alias("c"), "dst")
    known = known.withColumn("dst", F.col("cls")).where("src != cls").unionByName(own)
    known = stored(known.withColumn("t", _strength("c", "n_dst")), "known")
    nth = Window.partitionBy("src").orderBy(F.col("t").desc(), "dst")
    bound = known.withColumn("place", F.row_number().over(nth)).where(F.col("place") == n + 1)
    bound = stored(bound.select("src", "t", F.col("dst").alias("t_dst")), "bounds")

    bucket = lambda x: F.floor(F.log2(F.greatest(x, F.lit(1.0)))).cast("int")
    most = (F.col("w") * F.col("w")).cast("double")
    bounded = asked.join(bound, "src", "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    # of rounding a little is let through: what is found is compared exactly afterwards
    less = F.col("t") * (1 - 1e-9)
    last = F.when(less > 0, F.least(bucket(most / less), F.lit(63))).otherwise(F.lit(63))
    bounded = bounded.where(most >= less).withColumn("bucket", F.explode(F.sequence(bucket(less), last)))
    must = F.greatest(F.lit(1), F.ceil(F.sqrt(less * F.pow(F.lit(2.0), F.col("bucket")))).cast("int"))
    depth = F.when(F.col("big") | (F.col("w") > SMALL), 1).otherwise(F.least(must, F.lit(DEPTH)))
    slot = F.struct("slot", "big", "bucket").alias("slot")
    stretches = bounded.where((F.col("m") == depth) & (F.col("m") + F.col("tail") >= must)).select("src", "m", "tail", "t", "t_dst", slot)
    lists = index.where("listed").withColumn("bucket", bucket(F.col("n_head").cast("double")))
    lists = lists.select(F.col("head").alias("cls"), F.col("n_head").alias("n_dst"), F.col("tail").alias("tail_dst"), slot)
    probed = salted_join(lists, stretches, "slot", heavy_keys(key_counts(lists, "slot"), "slot", skew))
    r = F.col("m") + F.least("tail", "tail_dst")
    best_case = (r * r).cast("double") / F.col("n_dst").cast("double")
    hit = best_case > F.col("t")
    # as strong as the bound at best: in a list without ties it must also come before it
    hit = hit | ((best_case == F.col("t")) & (F.lit(True) if ties else F.col("cls") <= F.coalesce("t_dst", "cls")))
    pairs = stored(probed.where(hit).select("src", "cls").union(known.select("src", "cls")).distinct(), "class-pairs")

    def overlap_of(classes: DataFrame) -> DataFrame:
        """``src, cls, c``: how many wide keys both classes have."""
        mine = classes.join(keys.select(F.col("head").alias("src"), "basis"), "src")
        both = mine.join(keys.select(F.col("head").alias("cls"), "basis"), ["cls", "basis"])
        return both.groupBy("src", "cls").agg(F.count(F.lit(1)).alias("c"))

    reps_of = reps.join(heads, CLASS).select(F.col("head").alias("cls"), "dst", "n_dst")
    strong = overlap_of(pairs).join(reps_of, "cls").withColumn("t", _strength("c", "n_dst"))
    best = strong.withColumn("place", _place(["src"], F.col("t").desc(), "dst", ties)).where(F.col("place") <= n + 1)
    best = stored(best.join(heads.select(F.col("head").alias("src"), *CLASS), "src").select(*CLASS, "dst", "n_dst", "c"), "candidates")
    bound = bound.join(heads.select(F.col("head").alias("src"), *CLASS), "src").select(*CLASS, "t")

    def overlaps(met: DataFrame, bound: DataFrame) -> DataFrame:
        """``met``, of pairs that may be strong enough, with ``common``: all keys that they share."""
        named = {c: f"{c}_lo" for c in CLASS}
        limit = bound.withColumnsRenamed(named)
        both = F.least("w_lo", "w_hi")
        hopeful = met.join(limit, [f"{c}_lo" for c in CLASS], "left")
        at_most = F.col("cold") + both
        strongest = (at_most * at_most).cast("double") / F.col("n_hi")
        hopeful = stored(hopeful.where((both == 0) | F.col("t").isNull() | (strongest >= F.col("t"))), "met")
        both_wide = hopeful.where(both > 0)
        for role, name in (("lo", "src"), ("hi", "cls")):
            named = [f"{c}_{role}" for c in CLASS]
            both_wide = both_wide.join(heads.select(*[F.col(c).alias(x) for c, x in zip(CLASS, named)], F.col("head").alias(name)), named)
        counted = overlap_of(both_wide.select("src", "cls").distinct())
        shared = both_wide.join(counted, ["src", "cls"], "left")
        columns = ["lo", "hi", "n_lo", "n_hi"]
        return (
            hopeful.where(both == 0)
            .select(*columns, F.col("cold").alias("common"))
            .unionByName(shared.select(*columns, (F.col("cold") + F.coalesce("c", F.lit(0))).alias("common")))
        )

    return best, overlaps, bound


def _ranked(met: DataFrame, best: DataFrame, shared: DataFrame, searchers: DataFrame, n: int, ties: bool, skew: Skew) -> DataFrame:
    """The lists from those met on light keys, with all they share, and the candidates of each class."""
    key = F.struct(*CLASS)
    src = searchers.where("w > 0").select(F.col("entity").alias("lo"), F.col("n").alias("n_lo"), key.alias("class"))
    dst = best.select(key.alias("class"), F.col("dst").alias("hi"), F.col("n_dst").alias("n_hi"), F.col("c").alias("common"))
    found = salted_join(src, dst, "class", heavy_keys(key_counts(src, "class"), "class", skew))
    found = found.where("lo != hi").select("lo", "hi", "n_lo", "n_hi", "common")
    found = shared.unionByName(found).groupBy("lo", "hi", "n_lo", "n_hi").agg(F.max("common").alias("common"))
    sims = found.select(
        F.col("lo").alias("src"), F.col("hi").alias("dst"), cosine(F.col("common"), degree_product("n_lo", "n_hi")).alias("sim")
    )
    return neighbours(sims, n, ties=ties)
