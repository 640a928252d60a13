"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are range-sorted by it,
distributed prefix sums of their word counts give the place of each, and the order is cut where the
source's budget ends; a budget beyond the source's size takes whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covote.llm.common import kept
from covote.llm.prefix import prefix_sums, ranged, totals_before, with_before

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5  # of all words: the words of the mix
REPEATS = 2  # a document is taken so many times at most
SPACE = r"\x20\x09-\x0D"  # what parts words


def sized(docs: DataFrame, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, size, key``: the words of each text and a key that is random but the same in every run.

    The key is a digest of id and text: rows that share an id, or have none, are still in random places.
    ``carry`` names columns of the documents that come along as the struct ``row``.
    """
    text = F.coalesce("text", F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), id_, F.md5(text))).alias("key"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )


def targets(
    sources: DataFrame, weights: Sequence[int] | DataFrame = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    ``weights`` are dealt to the sources by code point, null last, or given as ``source, weight``
    (a source without one weighs 0). The sources share ``share`` times all words by weight, none gets more
    than ``repeats`` times its size, and what it cannot take is shared again by weight.

    That is the level at which min(cap, weight * level) adds up to the budget. With the sources in
    order of cap / weight, and those before one at their caps, what is left per weight rises while
    sources belong below the level and falls afterwards, so that the level is its maximum.
    """
    if isinstance(weights, DataFrame):
        named = weights.select(F.col("source").alias("_source"), F.col("weight").cast("long").alias("weight"))
        weighed = sources.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        weighed = weighed.withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    else:
        dealt = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
        order = [F.col("source").asc_nulls_last()]
        weighed = prefix_sums(sources, [], order, {"place": F.lit(1).cast("long")}, "source-order").withColumn("weight", dealt).drop("place")
    weighed = kept(weighed.withColumn("cap", F.col("source_size") * repeats), "source-weights")
    budget, all_weights = weighed.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(float(share)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    level = 0.0
    if all_weights:
        order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
        filled = prefix_sums(
            weighed.where("weight > 0"), [], order, {"caps_before": F.col("cap"), "weight_before": F.col("weight")}, "source-levels"
        )
        left = (F.lit(budget) - F.col("caps_before").cast("double")) / (F.lit(all_weights) - F.col("weight_before")).cast("double")
        level = filled.agg(F.max(left)).first()[0] or 0.0
    target = F.least(F.col("cap").cast("double"), F.col("weight").cast("double") * F.lit(float(level)))
    return weighed.select("source", "source_size", target.alias("target"))


def planned(
    docs: DataFrame,
    weights: Sequence[int] | DataFrame = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    *,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, source, key, size, source_size, target, taken`` for every document.

    ``taken`` is the number of words the mix takes of a document, repeats counted: its size for each
    whole epoch, and in the last one all, a part or none of it, so that the words of a source add up
    to its target, rounded down. A null text has no words; documents and sources without words have
    none taken; null sources are one source; rows of one doc_id are documents of their own, and of
    equal rows any one may be the one that is cut; an empty table gives none. Other columns are not
    looked at, whatever their names.
    """
    return _placed(kept(sized(docs, seed), "sizes"), weights, share, repeats).drop("epochs", "last")


def mixed(
    docs: DataFrame,
    weights: Sequence[int] | DataFrame = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    *,
    seed: int = 0,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, with ``epoch`` (from 0), ``key`` and ``words``.

    The text at which the budget of a source ends is cut behind its last word taken, white space before
    it kept. What is not taken, and texts without words, are left out. ``orderBy("epoch", "key")`` is the
    mixed order. Columns of these three names are replaced. Otherwise as ``planned``.
    """
    places = _placed(kept(sized(docs, seed, docs.columns), "sized-rows"), weights, share, repeats)
    whole = F.transform(
        F.sequence(F.lit(1).cast("long"), F.greatest("epochs", F.lit(1))),
        lambda e: F.struct((e - 1).alias("epoch"), F.when(F.col("epochs") > 0, F.col("size")).otherwise(0).alias("words")),
    )
    rest = F.array(F.struct(F.col("epochs").cast("long").alias("epoch"), F.col("last").alias("words")))
    each = places.select("row", "key", "size", F.explode(F.concat(whole, rest)).alias("copy")).where("copy.words > 0")
    pieces = F.split(F.col("row.text"), f"(?<=[^{SPACE}])(?=[{SPACE}])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("copy.words").cast("int")), "")
    text = F.when(F.col("copy.words") < F.col("size"), cut).otherwise(F.col("row.text"))
    own = [c for c in docs.columns if c not in ("text", "epoch", "key", "words")]
    return each.select(*[F.col(f"row.`{c}`") for c in own], text.alias("text"), "key", "copy.epoch", "copy.words")


def _placed(sizes: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    by = [F.col("source").asc_nulls_first(), F.col("key"), F.col("size")]
    rows = ranged(sizes, by, "mix-order")
    sums = {"before": F.col("size")}
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sources, weights, share, repeats).withColumnRenamed("source", "_source")
    # the target goes to the partitions of a source, few rows, and with these to the documents
    before = totals_before(rows, ["source"], sums)
    before = before.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = with_before(rows, before, ["source"], by[1:], sums)
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = F.floor("target") - F.col("epochs") * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    placed = placed.withColumn("epochs", epochs.cast("long")).withColumn("last", last.cast("long"))
    return placed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("last")).drop("before")
