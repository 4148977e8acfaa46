"""A corpus from raw documents: five operators, one after the other.

``run`` applies STAGES to the table ``documents``; every stage's result is written as Parquet and
read again as the next one's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm import bpe, langid, mixing, secrets, simhash
from tesselark.llm.common import stored

RANKS = "byte_bpe_multi_50k.tiktoken"

#: No stage's rows can be told in SQL as a whole; tests compare them with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters or unlike any learned language; ``lang`` becomes the predicted one."""
    judged = langid.identify(docs, langid.train(docs))
    return judged.where("NOT rejected").withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group; rows without an id stay."""
    groups = simhash.near_duplicates(docs).where("doc_id IS NOT NULL").select("doc_id", "component_id")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; no document goes."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the sources' target weights: some several times, some not at all."""
    return mixing.take(docs, F.array("source")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the digests of them and of the text decoded from them."""
    return bpe.digest(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
