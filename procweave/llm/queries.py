"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.llm import langid, line_dedup, media, minhash, packing, pii, quality, sentences, token_counts, toxicity
from procweave.llm.text import held_out
from procweave.session import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.described(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n_best=4)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    return langid.identified(docs, model, more={"held_out": held_out(F.col("doc_id"))}).select("doc_id", "held_out", "lang_pred", "score", "spans")


#: The key of the registered query; a deployment gives its own.
PII_KEY = "corpus-release-1"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    found = F.coalesce("__pw_found", F.array().cast("array<struct<value:string,kind:string,pseudonym:string>>"))
    count = lambda name: F.size(F.filter(found, lambda f: f["kind"] == name)).cast("long")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "text", digest.alias("text_sha256"), *[count(k.name).alias(f"n_{k.name}") for k in pii.KINDS])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = token_counts.section_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumns({"section": F.col("section").cast("int"), "n_tokens": F.col("n_tokens").cast("long")})


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic is not null and doc_id is not null").where(~fold)
    sample = toxicity.sampled(labels, "doc_id", toxicity.SAMPLE_DOCS)  # few enough to broadcast, whatever the table's size
    model = toxicity.train(docs.join(F.broadcast(sample), "doc_id"))
    return toxicity.scored(docs, model, more={"held_out": fold})


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": minhash.SQL, "op5_quality_rules": quality.SQL, "op6_line_dedup": line_dedup.SQL}
