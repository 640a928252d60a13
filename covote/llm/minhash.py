"""Near-duplicate documents by order min-hash.

A sketch takes the two shingles of least hash, with equal shingles of a text told apart by their
occurrence, and keeps them in text order, so it is sensitive to edits and to order. Documents that
share a sketch are compared with the least document of that sketch, and again of each run of two
and of four sketches. For what this does not bring into one class all pairs of different classes that
share two sketches meet where these are shared by few. The documents of larger groups are searched
exactly: two that are alike share one of their rarest shingles, so of the pairs of different classes that
share one those meet whose parities of shingles differ in no more bits than the shingles of two alike may, in
rounds in which classes grow. Of a family of m documents that are alike, but not enough, only bits are compared
pair by pair, in the condition of a join. A pair that shares enough sketches or a rare
shingle is verified by a banded alignment of the shingles. Links are closed to classes.

Texts are compared as lower-case words between white space; a shingle is a run of five words.
Equal texts are one representative before anything else, so copies cost nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covote.llm.common import WordCodes, components, kept, mix, occurrences, seeds, shingles

SIZE = 5  # words in a shingle
SIMILARITY = 0.8
SKETCHES = 24  # two documents of similarity 0.8 share about fifteen of them
SHARED = 7  # of which at least so many make a pair worth verifying: missed with chance 0.0005
STARS = 16  # sketches whose least document is met
DEPTHS = (1, 2, 4)  # sketches in a row that documents meet on
ORDERS = 16  # pairs of sketches that documents meet on
BLOCK = 16  # documents of which all pairs meet
LONGS = 16  # of 64 parities of shingles by slot of their hash


def coded(text: str, cache: WordCodes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def labelled(text: str, cache: WordCodes, size: int = SIZE) -> np.ndarray:
    """Shingle codes of which each includes its occurrence, so no two are equal."""
    found = shingles(coded(text, cache), size)
    if len(found) == 0:
        return found
    return mix(found + occurrences(found).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sketch(found: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """One code per salt: the two shingles of least hash, in text order."""
    if len(found) == 1:
        return mix(found + salts)
    step = max(1, 2_000_000 // len(found))  # salts at a time, for very long texts
    out = []
    for k in range(0, len(salts), step):
        some = salts[k : k + step]
        least = np.argpartition(mix(found ^ some[:, None]), 1, axis=1)[:, :2]
        least.sort(axis=1)
        out.append(mix(mix(found[least[:, 0]] + some) + found[least[:, 1]]))
    return np.concatenate(out)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two texts by their labelled shingles: matched in order / all.

    Only matches within a band around the diagonal count, as wide as the insertions that the
    threshold allows; the longest chain of these that rises in both texts is found.
    """
    if len(a) == 0 or len(b) == 0 or min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = np.ceil((1 - similarity) / similarity * max(len(a), len(b))) + 1
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < similarity / (1 + similarity) * (len(a) + len(b)):
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        chain = len(j)
    else:
        ends: list[int] = []
        for x in j.tolist():
            at = bisect_left(ends, x)
            ends[at : at + 1] = [x]
        chain = len(ends)
    return chain / (len(a) + len(b) - chain)


def sketched(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n, sketch, h``: shingles, sketches and the text's hash (null and wordless: no sketch)."""
    salts = seeds(SKETCHES, 8)

    @F.pandas_udf("n int, sketch array<long>")
    def sketching(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = WordCodes()
        for texts in batches:
            n, rows = [], []
            for t in texts:
                found = labelled(t or "", cache, size)
                n.append(len(found))
                rows.append(sketch(found, salts).view(np.int64) if len(found) else None)
            yield pd.DataFrame({"n": n, "sketch": rows})

    found = docs.select("doc_id", F.md5("text").alias("h"), sketching("text").alias("s"))
    return found.select("doc_id", "h", "s.n", "s.sketch")


def candidates(reps: DataFrame, shared: int = SHARED, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``a > b`` worth verifying: each document and the least one of each key it has."""
    s = F.col("sketch")
    keys = [
        F.xxhash64(F.lit(depth), F.lit(i), *[s[(i + k) % STARS] for k in range(depth)])
        for depth in DEPTHS
        for i in range(STARS)
    ]
    keyed = reps.select(F.explode(F.array(keys)).alias("key"), F.col("rep").alias("a"))
    least = keyed.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b < most").select("key", "b")
    pairs = keyed.join(least, "key").where("a > b").select("a", "b").distinct()
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    agree = F.aggregate(
        F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y
    )
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where((F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")) & (agree >= shared))
        .select("a", "b")
    )


def sketch_orders(count: int = ORDERS, sketches: int = SKETCHES) -> list[list[int]]:
    return [np.random.default_rng(k).permutation(sketches).tolist() for k in range(count)]


def blocks(rows: DataFrame, orders: list[list[int]], part: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """``key, rep`` of the blocks of 2 to ``part`` documents, and of those larger ones that no sketch divides.

    ``rows``: ``rep, root, sketch``. All orders start with two sketches; a key with more than ``part``
    members is divided by the next sketch of its order. Keys whose members are of one class are left
    out. A round counts the members with partial sums, so no task gets a key's members.
    """
    s, small, depth = F.col("sketch"), [], 2
    first = [F.struct(F.lit(k).alias("o"), F.xxhash64(F.lit(k), s[o[0]], s[o[1]]).alias("key")) for k, o in enumerate(orders)]
    live = rows.select("rep", "root", F.explode(F.array(first)).alias("at")).select("rep", "root", "at.o", "at.key")
    while True:
        counted = live.groupBy("key").agg(
            F.count(F.lit(1)).alias("m"), F.min("root").alias("x"), F.max("root").alias("y")
        )
        placed = kept(live.join(counted.where("x < y").select("key", "m"), "key"), "divided")
        small.append(placed.where(F.col("m") <= part).select("key", "rep"))
        large = placed.where(F.col("m") > part)
        if large.isEmpty():
            large = None
            break
        if depth == len(orders[0]):
            break
        place = F.array(*[F.lit(o[depth]) for o in orders])[F.col("o")]
        live = large.select("rep", "root", "o", "key").join(rows.select("rep", "sketch"), "rep")
        live = live.select("rep", "root", "o", F.xxhash64("key", s[place]).alias("key"))
        depth += 1
    return reduce(DataFrame.unionByName, small), None if large is None else large.select("key", "rep")


def unlinked(
    rows: DataFrame, shared: int = SHARED, similarity: float = SIMILARITY, part: int = BLOCK
) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``a > b`` worth verifying that are not in one class yet, and the documents that need ``family_links``.

    ``rows``: ``rep, n, sketch, root``. All pairs of a block of up to ``part`` meet; the members of larger ones are left.
    """
    small, large = blocks(rows.drop("n"), [o[:2] for o in sketch_orders()], part)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            found = []
            for members in some["members"]:
                rep, root, n = (np.array([x[c] for x in members]) for c in ("rep", "root", "n"))
                codes = np.stack([np.asarray(x["sketch"]) for x in members])
                agree = (codes[:, None] == codes[None]).sum(axis=2)
                near = np.minimum(n[:, None], n) >= similarity * np.maximum(n[:, None], n)
                i, j = np.nonzero((rep[:, None] > rep) & (root[:, None] != root) & (agree >= shared) & near)
                found.append(np.c_[rep[i], rep[j]])
            if found:
                yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    member = F.struct("rep", "root", "n", "sketch")  # at most ``part`` in a list
    lists = small.join(rows, "rep").groupBy("key").agg(F.collect_list(member).alias("members"))
    pairs = lists.select("members").mapInPandas(meet, "a long, b long")
    return pairs.distinct(), None if large is None else large.select("rep").distinct()


def prefixes(n: int, similarity: float) -> tuple[int, int]:
    """How many of the rarest of ``n`` shingles two alike share one of: against texts as long or longer, and against others."""
    least = 2 * similarity / (1 + similarity) * n  # in common with one as long
    return n - int(np.ceil(least - 1e-9)) + 1, n - int(np.ceil(similarity * n - 1e-9)) + 1


def rare_shingles(texts: DataFrame, similarity: float = SIMILARITY, size: int = SIZE) -> DataFrame:
    """``k, rep, n, short``: the rarest shingles of ``rep, text``, as many as a partner must share one of.

    ``short`` tells those that suffice against partners as long or longer. Rarest is meant among these texts; shingles
    are counted by slots of their hash, and any order gives all partners. What one text alone has is left out.
    """
    slots, chunk = 1 << 22, 1 << 16

    def counting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, total = WordCodes(), np.zeros(slots, np.int32)
        for some in batches:
            for text in some["text"]:
                np.add.at(total, labelled(text, cache, size) & np.uint64(slots - 1), 1)
        chunks = np.minimum(total, 65535).astype(np.uint16).reshape(-1, chunk)
        full = np.flatnonzero(chunks.any(1))
        yield pd.DataFrame({"chunk": full, "n": [chunks[k].tobytes() for k in full]})

    def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = np.minimum(np.sum([np.frombuffer(x, np.uint16) for x in rows["n"]], axis=0, dtype=np.int64), 65535)
        return pd.DataFrame({"chunk": [key[0]], "n": [n.astype(np.uint16).tobytes()]})

    schema, table = "chunk int, n binary", np.zeros(slots, np.uint16)  # of a fixed size, whatever the input's
    for k, n in texts.mapInPandas(counting, schema).groupBy("chunk").applyInPandas(summed, schema).collect():
        table[k * chunk : (k + 1) * chunk] = np.frombuffer(n, np.uint16)
    known = texts.sparkSession.sparkContext.broadcast(table)

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCodes()
        for some in batches:
            out = []
            for rep, text in zip(some["rep"], some["text"], strict=True):
                found = labelled(text, cache, size)
                short, long = prefixes(len(found), similarity)
                times = known.value[found & np.uint64(slots - 1)]
                order = np.lexsort((found, times))[:long]
                at = np.flatnonzero(times[order] > 1)
                out.append((found[order[at]].view(np.int64), np.full(len(at), rep), np.full(len(at), len(found)), at < short))
            if out:
                k, rep, n, short = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"k": k, "rep": rep, "n": n.astype(np.int32), "short": short})

    return texts.select("rep", "text").mapInPandas(rarest, "k long, rep long, n int, short boolean")


def parities(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """``rep, p0, p1, ...``: for each slot of a hash whether ``rep, text`` has an odd number of shingles there.

    Two texts differ in at least as many shingles as in bits of these.
    """
    slots = 64 * LONGS

    def odd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCodes()
        for some in batches:
            out = np.zeros((len(some), LONGS), np.int64)
            for k, text in enumerate(some["text"]):
                at = (labelled(text, cache, size) >> np.uint64(40)).astype(np.int64) % slots
                out[k] = np.packbits((np.bincount(at, minlength=slots) & 1).astype(np.uint8)).view(np.int64)
            yield pd.DataFrame({"rep": some["rep"], **{f"p{k}": out[:, k] for k in range(LONGS)}})

    return texts.select("rep", "text").mapInPandas(odd, ", ".join(["rep long", *(f"p{k} long" for k in range(LONGS))]))


def family_links(
    texts: DataFrame, roots: DataFrame, links: DataFrame, similarity: float = SIMILARITY, size: int = SIZE, part: int = BLOCK
) -> list[DataFrame]:
    """Links ``a, b`` between the different classes of ``texts`` (``rep, text``), so that no two alike stay apart.

    ``roots``: ``rep, root``, and ``links`` what is known beyond these. Of the documents that share a rare shingle each meets
    those of other classes that are not longer, the first ``part``, then four times as many, until the key is one class
    or all have met. Pairs whose ``parities`` differ too much to be alike are no rows.
    """
    odd = kept(parities(texts, size), "family-parities")
    keys = kept(rare_shingles(texts, similarity, size), "family-keys")
    counts = keys.groupBy("k").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("short"), 1)).alias("m"))
    keys = kept(keys.join(counts.where("all > 1 AND m > 0").drop("all"), "k"), "family-shared")
    order = Window.partitionBy("k").orderBy("n", "rep")
    firsts = keys.where("short").select("k", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.row_number().over(order).alias("place"))
    firsts = kept(firsts, "family-firsts")
    out, new, past, upto = [], links, 0, part
    while True:
        if not new.isEmpty():  # classes grow by the links between them
            end = lambda x: roots.select(F.col("rep").alias(x), F.col("root").alias(f"root_{x}"))
            joined = components(new.join(end("a"), "a").join(end("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "family-classes")
            joined = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
            roots = kept(roots.join(joined, "root", "left").select("rep", F.coalesce("to", "root").alias("root")), "family-roots")
        rooted = keys.where(F.col("m") > past).join(roots, "rep")
        several = rooted.groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("k")
        live = kept(rooted.join(several, "k").drop("m").join(odd, "rep"), "family-live")
        if live.isEmpty():
            return out
        ahead = firsts.where((F.col("place") > past) & (F.col("place") <= upto)).drop("place")
        ahead = ahead.join(roots.select(F.col("rep").alias("b"), F.col("root").alias("root_b")), "b")
        ahead = ahead.join(odd.select(F.col("rep").alias("b"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(LONGS)]), "b")
        differ = reduce(Column.__add__, [F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(LONGS)])
        near = differ <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("n_b")) + 1e-9
        alike = (F.col("n_b") >= similarity * F.col("n")) & ((F.col("n_b") < F.col("n")) | ((F.col("n_b") == F.col("n")) & (F.col("b") < F.col("rep"))))
        met = live.join(ahead, "k").where((F.col("root") != F.col("root_b")) & alike & near)
        met = kept(met.select(F.col("rep").alias("a"), "b").distinct(), "family-pairs")
        new = kept(verified(met, texts, similarity, size).select("a", "b"), "family-links")
        out.append(new)
        past, upto = upto, upto * 4


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, size: int = SIZE) -> DataFrame:
    """``a, b, similarity`` of the pairs that the alignment confirms. ``docs``: ``rep, text``, equal texts for equal reps."""
    # the ids grow with the corpus, so they are never broadcast, however small a table may be
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().hint("merge")
    texts = kept(docs.join(ids, "rep", "left_semi").dropDuplicates(["rep"]), "near-texts")
    rows = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("t_a")), "a").join(
        texts.select(F.col("rep").alias("b"), F.col("text").alias("t_b")), "b"
    )

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, last = WordCodes(), (None, None)
        for rows in batches:
            scores = []
            for b, t_a, t_b in zip(rows["b"], rows["t_a"], rows["t_b"], strict=True):
                if last[0] != b:  # the join brings the pairs of a representative together
                    last = (b, labelled(t_b, cache, size))
                scores.append(aligned(labelled(t_a, cache, size), last[1], similarity))
            out = rows[["a", "b"]].assign(similarity=scores)
            yield out[out["similarity"] >= similarity]

    return rows.select("a", "b", "t_a", "t_b").mapInPandas(align, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SIZE) -> DataFrame:
    """``doc_id, class_id, copies`` for each row: the least doc_id of its class, and how many rows of
    its very text there are.

    Rows whose text is null or has no word are in no class with others: ``class_id`` is their own
    doc_id. Rows without a doc_id have neither a class nor an influence on others, unless a copy of
    their text has an id. Rows that share a doc_id are one document for the classes; each of their texts
    is compared. An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = kept(sketched(docs, size=size), "sketches")
    # a distinct text is known by a code of its hash, not by an id, which several texts may share
    known = rows.where("n > 0").groupBy("h").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    known = kept(known.withColumn("rep", F.xxhash64("h")), "representatives")
    reps = known.where("id IS NOT NULL").select("rep", "n", "sketch")
    pairs = kept(candidates(reps, similarity=similarity), "candidates")
    by_id = docs.where("doc_id IS NOT NULL").select(F.xxhash64(F.md5("text")).alias("rep"), "text")
    links = kept(verified(pairs, by_id, similarity, size).select("a", "b"), "links")
    roots = components(links, "first-classes").withColumnRenamed("node", "rep")
    open_rows = kept(reps.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "rooted")
    more, large = unlinked(open_rows, similarity=similarity)
    more = kept(verified(kept(more, "unlinked"), by_id, similarity, size).select("a", "b"), "more-links")
    links = links.unionByName(more)
    if large is not None:
        large = kept(open_rows.join(large, "rep", "left_semi").select("rep", "root"), "families")
        texts = kept(by_id.join(large, "rep", "left_semi").dropDuplicates(["rep"]), "family-texts")
        links = reduce(DataFrame.unionByName, [links, *family_links(texts, large, more, similarity, size)])
    # a doc_id that stands for several texts ties them together
    several = rows.where("n > 0").groupBy("doc_id").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x != y")
    tied = rows.where("n > 0").join(several, "doc_id").select(F.xxhash64("h").alias("a"), F.xxhash64("x").alias("b"))
    roots = components(links.unionByName(tied), "classes")
    texts = known.join(roots, F.col("rep") == F.col("node"), "left").select(
        "h", "id", "copies", F.coalesce("root", "rep").alias("root")
    )
    texts = kept(texts, "texts")
    classes = texts.groupBy("root").agg(F.min("id").alias("least"))
    return (
        rows.select("doc_id", "h", "n")
        .join(texts.join(classes, "root").select("h", "least", "copies"), "h", "left")
        .select(
            "doc_id",
            F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("class_id"),
            F.coalesce("copies", F.lit(1)).alias("copies"),
        )
    )
