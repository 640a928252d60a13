"""Reading and writing interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR_SCHEMA = "user long, item long"
ID = r"^[+-]?[0-9]+$"  # what counts as an id: no blanks, no empty text


def from_rows(spark: SparkSession, rows) -> DataFrame:
    """Interactions from ``(user, item)`` tuples."""
    return spark.createDataFrame([(int(u), int(i)) for u, i in rows], PAIR_SCHEMA)


def parse_wide(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Turn lines ``userId,item1,item2,…`` of column ``value`` into ``user, item``.

    A line without items gives nothing, and empty text after the last item is ignored. Any
    other text that is no whole number fails the query, or with "DROPMALFORMED" is skipped
    (the whole line, if it is the user).
    """
    if mode not in ("FAILFAST", "DROPMALFORMED"):
        raise ValueError(f'mode must be "FAILFAST" or "DROPMALFORMED", got {mode!r}')
    fields = F.split(F.regexp_replace("value", ",+$", ""), ",")
    tokens = lines.select(F.element_at(fields, 1).alias("user"), F.explode(F.slice(fields, 2, 2147483647)).alias("item"))

    def number(name):
        value = F.when(F.col(name).rlike(ID), F.col(name).try_cast("long"))
        if mode == "DROPMALFORMED":
            return value
        return F.coalesce(value, F.raise_error(F.format_string("not an id: '%s'", name)).cast("long"))

    pairs = tokens.select(number("user").alias("user"), number("item").alias("item"))
    if mode == "DROPMALFORMED":
        return pairs.where(F.col("user").isNotNull() & F.col("item").isNotNull())
    return pairs


def checked_wide(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines of the wide form in one pass, good pairs and bad tokens apart: ``user, item, token, reason`` and the columns ``keep``.

    A good pair has no reason. A line whose user is bad is one row, with the text of the user as token; otherwise
    each bad item is one. The reasons: ``user`` or ``item`` for text that is no whole number, ``user range``
    or ``item range`` for one beyond a BIGINT. Lines without items give nothing, but for a bad user.
    """
    fields = F.split(F.regexp_replace("value", ",+$", ""), ",")
    split = lines.select(*keep, F.element_at(fields, 1).alias("u"), F.slice(fields, 2, 2147483647).alias("items"))
    number = lambda c: F.when(F.col(c).rlike(ID), F.col(c).try_cast("long"))
    wrong = lambda c, what: F.when(~F.col(c).rlike(ID), F.lit(what)).otherwise(F.lit(f"{what} range"))
    split = split.withColumn("user", number("u"))
    # a bad user stands for its whole line
    tokens = F.when(F.col("user").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("items"))
    rows = split.withColumn("t", F.explode(tokens)).withColumn("item", number("t"))
    bad_user, bad_item = F.col("user").isNull(), F.col("item").isNull()
    return rows.select(
        F.when(~bad_item, F.col("user")).alias("user"),
        "item",
        F.when(bad_user, F.col("u")).when(bad_item, F.col("t")).alias("token"),
        F.when(bad_user, wrong("u", "user")).when(bad_item, wrong("t", "item")).alias("reason"),
        *keep,
    )


def read_wide_checked(spark: SparkSession, path: str) -> DataFrame:
    """``checked_wide`` of text files, with the ``file`` each row is from."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return checked_wide(lines, "file")


def read_wide(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Interactions from text files in the wide form."""
    return parse_wide(spark.read.text(path), mode)


def wide_lines(chunked: DataFrame) -> DataFrame:
    """Lines ``userId,item1,…`` from chunked interactions, one line per user and chunk.

    A user may have several lines, so no line grows with the data.
    """
    items = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x.cast("string")), ",")
    return (
        chunked.groupBy("user", "chunk")
        .agg(items.alias("items"))
        .select(F.concat_ws(",", F.col("user").cast("string"), "items").alias("value"))
    )


def write_pairs(df: DataFrame, path: str, *, format: str = "parquet", mode: str = "append", partition_by=()) -> None:
    """Write any result; Spark commits the files of all tasks together."""
    writer = df.write.mode(mode).format(format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
