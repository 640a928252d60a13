"""Quality rules: counts of a text, and robust outliers among them, with DataFrame functions only.

The counts of a document are transformed to a vector. For each language and source the centre and the
spread of the vectors are estimated by the minimum covariance determinant: from a robust start, the
share of documents nearest to the centre gives the next centre and covariance, some steps in a row.
Documents whose Mahalanobis distance is beyond a quantile of the chi-square law are rejected.

A step is one aggregation to (group, bin of distance) with partial sums, so no group meets in one
task; the threshold of a group is found on its bins, of which there is a fixed number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covote.llm.common import kept

WORD_BREAK = "[ \\t\\n\\x0B\\f\\r]+"
MIN_WORDS = 50
REPEATED = 50  # per cent of the words, in windows that occur again
SHARE = 0.75  # of a group's documents that the estimate is made from
STEPS = 4
CUT = 33.377  # fixed value: the 0.999999 quantile of the chi-square law of four degrees
SHRINK = 1.459  # fixed value: consistency of the covariance of the nearest 75 % in four dimensions
FLOOR = (0.05, 0.015, 0.08, 0.08)  # least standard deviations, so that constant statistics reject only real ones
FEW = 20  # documents a group needs for an estimate of its own
BINS_PER_DOUBLING = 32
DIMENSIONS = ("word_length", "symbols", "lines", "repeats")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a column that is computed once a row however often it is read, also inside a lambda.

    A generator of one row stands between it and its readers, which the optimizer does not merge.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of each text; null texts have none of anything.

    Words in windows of three that occur twice or more: windows are told by 64-bit hashes, and where a
    text has equal ones, sorting them with their places brings these together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t\\x0B\\f\\r]"))
    keys = ["doc_id", "lang", "source"]
    found = _once(docs.select(*keys, text.alias("text")), "w", words(F.col("text")))
    found = _once(found, "lines", lines).select(
        *keys, "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    windows = F.transform(
        F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
    )
    found = _once(found, "hashes", windows).drop("w")
    sort = F.array_sort(F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    found = _once(
        found, "placed", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), sort)
    ).drop("hashes")
    equal = lambda x, k: F.coalesce(x["h"] == F.get("placed", k)["h"], F.lit(False))
    again = F.filter(
        F.transform("placed", lambda x, k: F.when(equal(x, k - 1) | equal(x, k + 1), x["i"])), lambda i: i.isNotNull()
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))
    return found.withColumn(
        "n_repeat_words", F.when(F.col("placed").isNull(), 0).otherwise(covered).cast("long")
    ).drop("placed")


def vector(found: DataFrame) -> DataFrame:
    """Adds the transformed statistics, in thousandths, so that sums of them are exact."""
    n = F.greatest("n_words", F.lit(1))
    parts = (
        F.log1p(F.col("word_chars") / n),
        F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
    )
    return found.withColumns({f"x{k}": F.round(p * 1000) / 1000 for k, p in enumerate(parts)})


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _cholesky(cov: dict[tuple[int, int], Column], d: int) -> list[tuple[str, Column]]:
    """Columns, each from those before it, that end in the lower triangle l_ij of the root of ``cov``."""
    out = []
    for i in range(d):
        for j in range(i + 1):
            rest = cov[i, j] - reduce(
                lambda a, b: a + b, (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)
            )
            if i == j:
                out.append((f"l{i}{i}", F.sqrt(F.greatest(rest, F.lit((FLOOR[i] / 4) ** 2)))))
            else:
                out.append((f"l{i}{j}", rest / F.col(f"l{j}{j}")))
    return out


def _distance(d: int) -> list[tuple[str, Column]]:
    """Columns that end in ``d2``, by forward substitution in the joined l_ij and m_i."""
    out = []
    for i in range(d):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - reduce(
            lambda a, b: a + b, (F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0)
        )
        out.append((f"z{i}", rest / F.col(f"l{i}{i}")))
    out.append(("d2", reduce(lambda a, b: a + b, (F.col(f"z{i}") * F.col(f"z{i}") for i in range(d)))))
    return out


def _with(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    for name, column in columns:
        df = df.withColumn(name, column)
    return df


def _start(rows: DataFrame, groups: list[str], d: int) -> DataFrame:
    """Medians, and deviations from them that three quarters of a group stay below."""
    quantiles = [F.percentile_approx(f"x{i}", F.array(F.lit(0.125), F.lit(0.5), F.lit(0.875)), 1000).alias(f"q{i}") for i in range(d)]
    start = rows.groupBy(*groups).agg(*quantiles)
    return start.select(
        *groups,
        *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(d)],
        *[
            (F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 2.3, F.lit(FLOOR[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}")
            for i, j in _pairs(d)
        ],
    )


def _joined(rows: DataFrame, estimate: DataFrame, groups: list[str]) -> DataFrame:
    """``rows`` with the estimate of their group, nulls among the keys included.

    The keys of ``rows`` are salted, since a group may hold a third of them; an estimate is one row a
    group, so its copies are few.
    """
    salts = 64
    many = estimate.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    many = many.select(*[F.col(g).alias(f"_{g}") for g in groups], "_salt", *[c for c in estimate.columns if c not in groups])
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups])
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("doc_id", *[c for c in rows.columns if c.startswith("x")]), F.lit(salts)).cast("int"))
    return salted.join(many, on & (F.col("_s") == F.col("_salt"))).drop("_s", "_salt", *[f"_{g}" for g in groups])


def _step(rows: DataFrame, estimate: DataFrame, groups: list[str], d: int) -> DataFrame:
    far = _with(_joined(rows, estimate, groups), _distance(d))
    bins = F.floor(F.log2(F.greatest("d2", F.lit(2.0**-20))) * BINS_PER_DOUBLING).cast("int")
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _pairs(d)]
    # at most 32 bins a doubling, and distances are bounded by the floors: a few thousand rows a group
    by_bin = far.groupBy(*groups, bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    run = Window.partitionBy(*groups).orderBy("bin")
    whole = Window.partitionBy(*groups)
    inside = (
        by_bin.withColumn("before", F.sum("n").over(run) - F.col("n"))
        .withColumn("all", F.sum("n").over(whole))
        .where(F.col("before") < F.ceil(F.col("all") * SHARE))
    )
    total = inside.groupBy(*groups).agg(
        F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)],
        *[F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i, j in _pairs(d)],
    )
    centred = _with(total, [(f"m{i}", F.col(f"s{i}") / F.col("n")) for i in range(d)])
    cov = {
        (i, j): (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * SHRINK
        + F.lit(FLOOR[i] ** 2 if i == j else 0.0)
        for i, j in _pairs(d)
    }
    return _with(centred, _cholesky(cov, d)).select(
        *groups, *[f"m{i}" for i in range(d)], *[f"l{i}{j}" for i, j in _pairs(d)]
    )


def outliers(rows: DataFrame, groups: list[str], d: int, steps: int = STEPS) -> DataFrame:
    """``rows`` with ``d2``, the squared robust distance of x0 ... x(d-1) in their group.

    Groups of fewer than ``FEW`` rows share one estimate. Rows with a null or NaN among the x take no
    part and have none. Any number of rows, also all of them, may be alike: the floors keep the
    covariance regular.
    """
    whole = reduce(lambda a, b: a & b, [F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}") for i in range(d)])
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    sized = _joined(rows.where(whole), sizes, groups)
    keyed = [f"g{k}" for k in range(len(groups))]
    fit = kept(
        _with(sized, [(k, F.when(F.col("_n") >= FEW, F.col(g).cast("string"))) for k, g in zip(keyed, groups, strict=True)])
        .withColumn("g_own", F.col("_n") >= FEW)
        .drop("_n"),
        "statistics",
    )
    keyed = [*keyed, "g_own"]
    estimate = _start(fit, keyed, d)
    for _ in range(steps):
        estimate = kept(_step(fit, estimate, keyed, d), "estimate")
    done = _with(_joined(fit, estimate, keyed), _distance(d)).select(*rows.columns, "d2")
    return done.unionByName(rows.where(~whole).withColumn("d2", F.lit(None).cast("double")))


def judged(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``d2`` and ``kept`` for each row of ``docs``.

    A null text has no words and fails; texts are counted whole. Documents that fail the plain rules
    are not part of the estimate. Null languages and sources are groups like others; repeated rows
    count each time; an empty table gives an empty result. Other columns are not read.
    """
    counted = statistics(docs.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"))]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    rows = kept(vector(counted).withColumn("base_failed", failed), "counts")
    passed = outliers(rows.where("NOT base_failed"), ["lang", "source"], len(DIMENSIONS))
    out = passed.unionByName(rows.where("base_failed").withColumn("d2", F.lit(None).cast("double")))
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2",
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cut)).alias("kept"),
    )
