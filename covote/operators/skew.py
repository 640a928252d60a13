"""Equi-joins that stay balanced when one key holds a large share of either side."""

from __future__ import annotations

from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The most frequent keys, so many at most, are broadcast to tag their rows. Every other key has
# less than one row in so many, so that the rest of the keys to split can be joined by the key.
MAX_BROADCAST_KEYS = 10_000


@dataclass(frozen=True)
class Skew:
    """How hot keys are handled. Results never depend on these values, only balance does.

    block: rows of one key that one join cell may hold on either side.
    wide: members up to which the neighbour search pairs all of a basis key; those with more
        are searched by classes and bounds (see ``neighbours.top_neighbours``).
    """

    block: int = 8192
    wide: int = 512

    def __post_init__(self):
        if self.block < 1 or self.wide < 1:
            raise ValueError("block and wide must be at least 1")


DEFAULT_SKEW = Skew()


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class HeavyKeys:
    """All keys with more than a block of rows, and how many slices each needs.

    first: key, place (from 0, by frequency) and splits of MAX_BROADCAST_KEYS of them at most.
    every: key and splits of all of them, however many there are.
    """

    first: DataFrame
    every: DataFrame


def heavy_keys(counts: DataFrame, key: str, skew: Skew = DEFAULT_SKEW) -> HeavyKeys:
    """The keys of ``(key, n)`` that are to be split."""
    over = counts.where(F.col("n") > skew.block)
    splits = lambda n: F.ceil(n / F.lit(float(skew.block))).cast("long")
    top = (
        over.orderBy(F.col("n").desc(), key)
        .limit(MAX_BROADCAST_KEYS)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), key))).alias("top"))
    )
    first = top.select(F.posexplode("top").alias("place", "top")).select(
        F.col(f"top.{key}").alias(key), "place", splits(-F.col("top.order")).alias("splits")
    )
    return HeavyKeys(first, over.select(key, splits(F.col("n")).alias("splits")))


def tag_heavy(df: DataFrame, key: str, heavy: HeavyKeys) -> DataFrame:
    """Add ``place`` (NULL but for the first heavy keys) and ``splits`` (1 for keys that are not heavy).

    Rows of the first keys have their slices by the broadcast and are dealt evenly in the join
    that looks up the others, in which no key is frequent.
    """
    tagged = df.join(F.broadcast(heavy.first), key, "left")
    dealt = F.when(F.col("splits").isNull(), 0).otherwise(F.xxhash64(*df.columns))
    # zero, in words that keep it a join key: Spark would take a literal out of the condition
    other = heavy.every.select(key, F.col("splits").alias("_splits"), F.pmod(F.xxhash64(key), F.lit(1)).alias("_deal"))
    tagged = tagged.withColumn("_deal", dealt).join(other, [key, "_deal"], "left")
    splits = F.coalesce("splits", "_splits", F.lit(1).cast("long"))
    return tagged.select(*df.columns, "place", splits.alias("splits"))


def own_slice(*by: str) -> Column:
    """The slice of its key a tagged row belongs to.

    It is a hash of the row, so a task that is run again places its rows the same way.
    """
    return F.pmod(F.xxhash64(*by), F.col("splits"))


def all_slices() -> Column:
    """Repeats a tagged row for every slice of its key."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1))


def salted_join(sliced: DataFrame, copied: DataFrame, key: str, heavy: HeavyKeys) -> DataFrame:
    """Inner join on ``key`` in which a heavy key of ``sliced`` is spread over many tasks.

    Every pair of matching rows meets in one slice, so the result is that of the plain join.
    A key that is frequent in ``copied`` only is left to the skew join of adaptive execution.
    """
    by = [c for c in sliced.columns if c != key]
    left = tag_heavy(sliced, key, heavy).select(key, *by, own_slice(*by).alias("_cell"))
    rest = [c for c in copied.columns if c != key]
    right = tag_heavy(copied, key, heavy).select(key, *rest, all_slices().alias("_cell"))
    return left.join(right, [key, "_cell"]).drop("_cell")


_measured: WeakKeyDictionary = WeakKeyDictionary()


def most_rows(df: DataFrame, key: str) -> int:
    """The rows of the most frequent key, by a job of its own; repeated rows count.

    All columns of ``df`` are measured at once, and the figures are remembered for this DataFrame
    object, whose data must stay as it is. Values are counted by a hash, which can only overstate them.
    """
    if df not in _measured:
        columns = df.columns
        values = F.array(
            *[F.struct(F.lit(i).alias("column"), F.xxhash64(c).alias("value"), F.col(c).isNull().alias("absent")) for i, c in enumerate(columns)]
        )
        counts = df.select(F.inline(values)).where("NOT absent").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        most = {r[0]: r[1] for r in counts.groupBy("column").agg(F.max("n")).collect()}
        _measured[df] = {c: most.get(i, 0) for i, c in enumerate(columns)}
    return _measured[df][key]


LISTED = 10_000  # ids that may go along with a plan
LITERAL = 1_000  # of these, how many are written into a filter


def listed(spark: SparkSession, keys):
    """The distinct ids of ``keys`` if there are at most ``LISTED``, otherwise ``keys``; a list stays one.

    A job of its own; no more than that many rows come to the driver.
    """
    if not isinstance(keys, DataFrame):
        return sorted({int(k) for k in keys})
    found = _few(keys.select(F.col(keys.columns[0]).cast("long").alias("key")))
    return keys if found is None else found


def _few(keys: DataFrame) -> list | None:
    rows = keys.where("key IS NOT NULL").distinct().limit(LISTED + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= LISTED else None


def narrowed(df: DataFrame, column: str, other: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` has a value that it has in ``other`` too, if these values are few.

    Otherwise ``df`` as it is: the rest of the rows must not matter to the result.
    """
    kind = dict(df.dtypes)[column]
    as_is = F.col(column) if kind == "string" else F.col(column).cast("long")
    found = _few(other.select(as_is.alias("key")))
    return df if found is None else _among(df, column, found)


def _among(df: DataFrame, key: str, ids: list) -> DataFrame:
    if len(ids) <= LITERAL:
        return df.where(F.col(key).isin(ids))
    kind = "string" if isinstance(ids[0], str) else "long"
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"_key {kind}")
    return df.join(F.broadcast(wanted), F.col(key).cast(kind) == F.col("_key"), "left_semi")


def keep_keys(df: DataFrame, key: str, keys) -> DataFrame:
    """Rows whose ``key`` is wanted: all (None), a list of ids, or a one-column DataFrame.

    A few ids become a filter that reaches the scan, up to ``LISTED`` a broadcast; a longer list or a DataFrame becomes a
    semi-join, broadcast or split at run time by its measured size.
    """
    if keys is None:
        return df
    if not isinstance(keys, DataFrame):
        ids = sorted({int(k) for k in keys})
        if len(ids) <= LISTED:
            return _among(df, key, ids)
        keys = df.sparkSession.createDataFrame([(i,) for i in ids], "key long")
    wanted = keys.select(F.col(keys.columns[0]).cast("long").alias("_key"))
    return df.join(wanted, F.col(key).cast("long") == F.col("_key"), "left_semi")
