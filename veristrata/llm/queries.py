"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, lm, mixing, ngram_join, packing, quality_model, quality_rules, toxicity, vector_dedup
from .common import bucket_of, table

#: The rank file of the tokenizer.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    n = (F.length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is kept from learning; false for a null doc_id, which is never learnt from either."""
    return F.coalesce(bucket_of("doc_id", modulus) == remainder, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs)).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.grade(docs, quality_model.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.rate(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op8_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "link_.class_id", "link_.n_links", "link_.kept")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_bpe_codec": op2_bpe_codec,
        "op3_quality_rules": op3_quality_rules,
        "op4_lm_score": op4_lm_score,
        "op5_language_id": op5_language_id,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_toxicity": op7_toxicity,
        "op8_pack_tokens": op8_pack_tokens,
        "op9_embedding_neardup": op9_embedding_neardup,
        "op10_ngram_jaccard": op10_ngram_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.MIX_SQL,
        "op3_quality_rules": quality_rules.RULES_SQL,
        "op9_embedding_neardup": vector_dedup.LINK_SQL,
        "op10_ngram_jaccard": ngram_join.JOIN_SQL,
    }
