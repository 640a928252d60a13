"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Rows are dealt to shards of bounded size. A shard holds a forest: for each tree a sorted array of long
hash strings, the signs of random projections. A query descends by binary search to the longest
prefixes that it shares with a row of each tree and then ascends all trees together, a bit at a time,
until enough rows match; these are compared exactly, and the best of all shards are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES = 16
BITS = 24  # of a hash string
SHARD = 4096  # rows of a shard, about
BLOCK = 4096  # queries that meet a shard in one task, about
MATCHES = 1.0  # matches over all trees, as a share of a shard's rows, at which the ascent ends


def valid(vector: Column) -> Column:
    """Not null or empty, all parts finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted hash strings of the rows of ``x`` for inner products: shorter rows are lifted to one length."""

    def __init__(self, x: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS):
        self.planes = np.random.default_rng(10).standard_normal((trees, bits, x.shape[1] + 1))
        lift = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
        codes = self.hashes(np.c_[x, lift])
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)
        self.bits, self.rows = bits, len(x)

    def hashes(self, x: np.ndarray) -> np.ndarray:
        signs = np.einsum("tbd,nd->tnb", self.planes, x, optimize=True) > 0
        return signs @ (1 << np.arange(signs.shape[2] - 1, -1, -1))

    def candidates(self, q: np.ndarray, matches: float):
        """For each query the rows that share the longest prefixes, in enough number."""
        codes = self.hashes(np.c_[q, np.zeros(len(q))])
        low = np.empty((self.bits + 1, len(codes), len(q)), np.int64)
        high = np.empty_like(low)
        for level in range(self.bits + 1):  # bits that are ignored
            start = codes >> level << level
            for t in range(len(codes)):
                low[level, t] = np.searchsorted(self.sorted[t], start[t])
                high[level, t] = np.searchsorted(self.sorted[t], start[t] + (1 << level))
        enough = (high - low).sum(1) >= min(matches, len(codes)) * self.rows
        for k, level in enumerate(enough.argmax(0)):
            mask = np.zeros(self.rows, bool)
            for t in range(len(codes)):
                mask[self.order[t, low[level, t, k] : high[level, t, k]]] = True
            yield np.flatnonzero(mask)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, trees: int = TREES, matches: float = MATCHES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``queries`` holds its ``k`` nearest others found.

    Ties go to the smaller vec_id; with ``k`` other rows or fewer all are returned. Vectors that are
    null, zero or not finite and rows without a vec_id take no part; only vectors of equal length are
    compared. Of equal vectors the k + 1 of least vec_id are indexed, as no list holds another.
    Rows of one vec_id count as one if they are equal; an empty table gives an empty result. Other
    columns are not read.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    asked = rows.where(queries).dropDuplicates(["vec_id", "v"])
    copies = Window.partitionBy("v").orderBy("vec_id")
    index = (
        rows.withColumn("_copy", F.dense_rank().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy")
        .dropDuplicates(["vec_id", "v"])
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    totals = rows.groupBy(F.size("v").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"), F.count_if(queries).alias("asked")
    )
    shards = totals.select(
        "size", "longest", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"),
        F.greatest(F.ceil(F.col("asked") / BLOCK).cast("int"), F.lit(1)).alias("blocks"),
    )
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = index.withColumn("size", F.size("v")).join(shards, "size")
    dealt = dealt.select("size", "longest", place("shards").alias("shard"), each("blocks").alias("block"), "vec_id", "v")
    sent = asked.withColumn("size", F.size("v")).join(shards, "size")
    sent = sent.select(
        F.col("size").alias("q_size"), each("shards").alias("q_shard"), place("blocks").alias("q_block"),
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"),
    )

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            x, ids = np.stack(mine["v"].to_numpy()), mine["vec_id"].to_numpy()
            q, q_ids = np.stack(theirs["q"].to_numpy()), theirs["query_id"].to_numpy()
            forest = Forest(x, float(mine["longest"].iloc[0]), trees)
            for j, found in enumerate(forest.candidates(q, matches)):
                found = found[ids[found] != q_ids[j]]
                score = (x[found] * q[j]).sum(1)
                if len(found) > k:
                    near = score >= np.partition(score, -k)[-k]
                    found, score = found[near], score[near]
                best = np.lexsort((ids[found], -score))[:k]
                out.append((np.full(len(best), q_ids[j]), ids[found[best]], score[best]))
        names = ("query_id", "vec_id", "score")
        return pd.DataFrame({n: np.concatenate([r[c] for r in out]) if out else [] for c, n in enumerate(names)})

    ours, others = dealt.groupBy("size", "shard", "block"), sent.groupBy("q_size", "q_shard", "q_block")
    met = ours.cogroup(others).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
