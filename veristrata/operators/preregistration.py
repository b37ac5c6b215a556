"""Frozen specifications: canonical JSON and its hash, what has drifted, and whether an analysis is confirmatory.

Canonical JSON sorts keys at every depth, which no built-in does: it is an Arrow function over the
few specifications, never over records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .synthesis import failures


def canonical_json(payload: Column) -> Column:
    """The JSON with sorted keys, no blanks and only ASCII characters; null for text that is no JSON."""

    @pandas_udf(StringType())
    def rewritten(texts):
        import json

        def one(text):
            try:
                return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return rewritten(payload)


def canonical_hash(payload: Column) -> Column:
    return F.sha2(canonical_json(payload), 256)


def flattened(payload: Column) -> Column:
    """(path, value as JSON) of every leaf; lists stay whole."""

    @pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())])))
    def taken_apart(texts):
        import json

        def walk(value, path):
            if not isinstance(value, dict):
                return [{"path": path, "value": json.dumps(value, sort_keys=True, separators=(",", ":"))}]
            return [leaf for k in sorted(value) for leaf in walk(value[k], f"{path}.{k}" if path else k)]

        return texts.map(lambda t: None if t is None else walk(json.loads(t), ""))

    return taken_apart(payload)


def freeze(specifications: DataFrame, at: Column) -> DataFrame:
    """(specification_id, payload) with its canonical payload, hash and the time it was frozen."""
    whole = canonical_json(F.col("payload"))
    return specifications.select("specification_id", whole.alias("frozen_payload"), F.sha2(whole, 256).alias("specification_hash"), at.alias("frozen_at"))


def drift(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """(specification_id, payload) against frozen ones: each path whose value changed, with both values (null: not there).

    Only specifications that were frozen and are there now are compared.
    """
    now = current.join(frozen.select("specification_id"), "specification_id").select("specification_id", F.explode(flattened(F.col("payload"))).alias("n")).select("specification_id", "n.path", F.col("n.value").alias("current_value"))
    then = frozen.join(current.select("specification_id"), "specification_id").select("specification_id", F.explode(flattened(F.col("frozen_payload"))).alias("f")).select("specification_id", "f.path", F.col("f.value").alias("frozen_value"))
    return then.join(now, ["specification_id", "path"], "full").filter(~F.col("frozen_value").eqNullSafe(F.col("current_value"))).select("specification_id", "path", "frozen_value", "current_value")


def confirmatory(current: DataFrame, frozen: DataFrame, retrievals: DataFrame, journal_whole: bool = True) -> DataFrame:
    """(specification_id, permitted, reasons): whether each specification was frozen, is unchanged and older than its data (specification_id, retrieved_at)."""
    earliest = retrievals.groupBy("specification_id").agg(F.min("retrieved_at").alias("earliest"))
    both = current.select("specification_id", canonical_hash(F.col("payload")).alias("now")).join(frozen, "specification_id", "left").join(earliest, "specification_id", "left")
    there = F.col("specification_hash").isNotNull()
    reasons = failures(
        ("NO_PREREGISTRATION_FREEZE", ~there),
        ("SPECIFICATION_DRIFT_AFTER_FREEZE", there & ~F.col("now").eqNullSafe(F.col("specification_hash"))),
        ("FREEZE_POSTDATES_DATA_RETRIEVAL", there & F.coalesce(F.col("frozen_at") > F.col("earliest"), F.lit(False))),
        ("JOURNAL_CHAIN_BROKEN", there & F.lit(not journal_whole)),
    )
    return both.select("specification_id", (F.size(reasons) == 0).alias("permitted"), F.array_join(reasons, "|").alias("reasons"))


def freeze_entries(entries: DataFrame, specification_id: str | None = None) -> DataFrame:
    """A journal's entries about frozen specifications, of one or all."""
    found = entries.filter(F.col("event_type") == "PREREGISTERED_SPECIFICATION")
    return found if specification_id is None else found.filter(F.get_json_object("payload", "$.specification_id") == specification_id)


def sentence_context(text: Column, phrase: str) -> Column:
    """The lines, with their numbers, where a phrase starts a word."""
    import re

    numbered = F.transform(F.split(text, "\r\n|\n|\r"), lambda line, i: F.when(F.regexp_like(line, F.lit(r"(?i)\b" + re.escape(phrase))), F.concat(F.lit("line "), (i + 1).cast("string"), F.lit(": "), F.trim(line))))
    return F.array_compact(numbered)


def digest(files: DataFrame) -> DataFrame:
    """(name, content) to each file's hash."""
    return files.select("name", F.sha2("content", 256).alias("sha256"))
