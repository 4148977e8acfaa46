"""The operators as queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontaminate, hardneg, images, langid, mixing, neighbours, pii, secrets, simhash, substrings, urlfilter

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so the pages' visible texts are drawn."""
    pages = _table(spark, sf_dir, "pages").select("page_id", images.shown(F.col("html")).alias("text"))
    return images.image_copies(pages, "page_id", "text", draw=True)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are moved on by one first."""
    rows = hardneg.from_table(_table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", label), positives=5, negatives=5, every=100, share=(80, 100))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(_table(spark, sf_dir, "embeddings"))


OPERATORS = {
    f.__name__: f
    for f in (op1_mix_sources, op2_url_filter, op3_pii, op4_image_copies, op5_neighbours, op6_simhash, op7_secrets, op8_bpe, op9_repeats, op10_language, op11_hard_negatives, op12_decontaminate, op13_vector_codes)
}

SQL = {"op2_url_filter": urlfilter.oracle_sql(), "op11_hard_negatives": hardneg.ORACLE_SQL, "op12_decontaminate": decontaminate.oracle_sql(), "op13_vector_codes": codes.oracle_sql()}
