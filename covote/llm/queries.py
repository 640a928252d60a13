"""The operators of this package over their whole tables, with the columns that are agreed for each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covote.llm import ann, bpe, html, lmscore, manifest, minhash, mixing, packing, passages, pii, rules, sql, toxicity, whitening
from covote.llm.common import table


def fold(n: int):
    """The remainder by which rows are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf, "documents").select("doc_id", "text"))


def toxicity_model(spark: SparkSession, sf: str) -> toxicity.Model:
    return toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels").where(fold(3) != 1))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    found = toxicity.predict(table(spark, sf, "documents"), toxicity_model(spark, sf))
    return found.withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(False)))


def op8_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op4_lmscore(spark: SparkSession, sf: str) -> DataFrame:
    found = lmscore.scored(table(spark, sf, "documents"), fold(7) != 2)
    return found.withColumn("held_out", F.coalesce(fold(7) == 2, F.lit(False)))


def op5_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judged(table(spark, sf, "documents"))


def op6_html(spark: SparkSession, sf: str) -> DataFrame:
    return html.extracted(table(spark, sf, "pages"))


def op7_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated(table(spark, sf, "documents"))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_ann(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_mixing(spark: SparkSession, sf: str) -> DataFrame:
    found = mixing.planned(table(spark, sf, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op12_manifest(spark: SparkSession, sf: str) -> DataFrame:
    # where the checksum of the id says so, the letters A-Z of the text have been tampered with
    text = F.when(fold(3) == 0, manifest.lower_ascii("text")).otherwise(F.col("text"))
    return manifest.verified(table(spark, sf, "documents"), {"text": text})


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_toxicity, op3_bpe, op4_lmscore, op5_rules, op6_html, op7_passages, op8_minhash, op9_packing,
        op10_ann, op11_mixing, op12_manifest, op13_whitening,
    )
}
ORACLE_SQL: dict[str, str] = {"op11_mixing": sql.mixing(), "op12_manifest": sql.manifest()}
