"""A training corpus from `documents`: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns they were given. Empty
tables pass through; null texts, which have no words, go at the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import bpe, mixing, ngram_join, quality_rules, toxicity
from veristrata.llm.common import stage, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries that a worker of the last stage keeps and bytes of text that it takes at once: executors have filled their heaps by then.
KEPT, AT_ONCE = 40_000, 1 << 18
#: Toxicity and a binary encoding are no SQL: the pipeline is tested stage by stage.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels table, does not reject."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.kept(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; those it does not take go."""
    others = [c for c in docs.columns if c != "doc_id"]
    mixed = mixing.mix(docs, keep=others, names=[f"kept_{i}" for i in range(len(others))]).filter("copies > 0")
    repeated = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"kept_{others.index(c)}").alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (32 bits each) and whether they decode to the text."""
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=("doc_id", "source", "text"), decoded=True, kept=KEPT, at_once=AT_ONCE)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_rules),
    ("ngram_jaccard", drop_copies),
    ("mix_sources", mix_sources),
    ("bpe_codec", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
