"""A corpus pipeline: every stage works on what the one before it kept.

Quality rules drop documents, line dedup drops shared lines from the texts, near-dedup keeps one
document of each group, PII pseudonymizes the texts, and packing gives each kept document's pieces
their places in training sequences. n_chars follows the text wherever a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.llm import line_dedup, minhash, packing, pii, quality
from procweave.session import Staging

#: The key of the pseudonyms; a deployment gives its own.
PII_KEY = "corpus-release-1"


def _counted(docs: DataFrame) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.without_shared_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.without_pii(docs, PII_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", shared_lines), ("minhash_near_dedup", near_dedup), ("pii", pseudonyms), ("best_fit_packing", pack)]

#: The tokens of the last stage are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages' result. Their tables are in a folder, a new one where none is named; the last stage's input
    stays there, whose texts, cut by packing.pieces(), are what the sequences hold."""
    docs, staging = spark.read.parquet(f"{sf_dir}/documents.parquet"), Staging(spark, "pipeline", folder)
    for k, (name, stage) in enumerate(STAGES):
        docs = staging.write(stage(spark, docs, sf_dir), f"{k}_{name}")
        if 0 < k < len(STAGES) - 1:
            staging.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
