"""What several operators share: tables kept in the shared folder, word and shingle codes, classes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covote.operators.lineage import scratch_path

WORD_CACHE = 250_000  # words whose codes a worker remembers before it starts anew
_MASK = 0xFFFFFFFFFFFFFFFF
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors.

    What was shuffled for it is deleted as soon as it is written. ``rows`` is how many at most reach
    Python at a time, for rows of long texts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    wanted = {_CLEANUP: "true"} | ({} if rows is None else {_BATCH: str(rows)})
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the pieces of byte-level vocabularies.

    Visible Latin-1 characters stand for themselves, the rest for letters from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class WordCodes(dict):
    """A 64-bit code for each word, the same in every process."""

    def __missing__(self, word):
        if len(self) >= WORD_CACHE:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit codes; wraps around on purpose."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of the runs of ``size`` words; a shorter text is one shingle, one without words none."""
    if len(codes) == 0:
        return codes
    size = min(size, len(codes))
    out = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out + codes[k : len(out) + k])
    return out


def occurrences(codes: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of a code, 1 for its second, and so on."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    if first.all():
        return np.zeros(len(codes), np.int64)
    at = np.arange(len(codes))
    out = np.empty(len(codes), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def seeds(count: int, salt: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{salt}:{k}") & _MASK for k in range(count)], np.uint64)


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: root is the least node it is connected to.

    Alternates large and small stars until nothing changes, which takes about the logarithm of the
    longest path in rounds. Each round is two aggregations with partial sums and joins that Spark may
    split at a hub; the links are kept in the shared folder between rounds. Null ends and links of a
    node with itself are left out, repeated links count once; no links give an empty result.
    """
    links = kept(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name,
    )
    seen = None
    while True:
        # large star: larger neighbours of a node go to the least of its neighbourhood
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        ).distinct()
        # small star: a node and its smaller neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = kept(
            small.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), name
        )
        state = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen:
            break
        seen = state
    roots = links.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
