"""Contradictions, dependency-collapsed indices, claim tiers, gates and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failures(*rules: tuple[str, Column]) -> Column:
    """The codes of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))


SCOPE = ["construct", "population", "period", "jurisdiction", "estimand"]
MISMATCH = {"construct": "CONSTRUCT_MISMATCH", "population": "SCOPE_MISMATCH", "period": "PERIOD_MISMATCH", "jurisdiction": "JURISDICTION_MISMATCH", "estimand": "ESTIMAND_MISMATCH"}
MODEL_FAMILIES = ["INTRINSIC_RECOGNITION", "MULTIFACTORIAL_DEVELOPMENTAL_INSTITUTIONAL", "ASCERTAINMENT_SERVICE", "MIXTURE_HETEROGENEITY", "NULL_OR_ALTERNATIVE"]


def folded(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))


def opposed(left: Column, right: Column) -> Column:
    against = ["WEAKENS", "FALSIFIES"]
    return ((left == "SUPPORTS") & right.isin(against)) | (left.isin(against) & (right == "SUPPORTS"))


def pair_class(a: Column, b: Column) -> Column:
    """What two results (structs) are to each other: the first part of their scopes that differs, or whether they oppose."""
    out = F.when(a["proposition_id"] != b["proposition_id"], "NOT_COMPARABLE")
    for field in SCOPE:
        out = out.when(folded(a[field]) != folded(b[field]), MISMATCH[field])
    return out.when(opposed(a["direction"], b["direction"]), "SUBSTANTIVE_CONTRADICTION").otherwise("CONSISTENT")


def contradictions(results: DataFrame) -> DataFrame:
    """Pairs of results of one proposition and scope with opposing directions, by an equi-join on both."""
    keyed = results.select("result_id", "direction", F.concat_ws("␟", "proposition_id", *[folded(F.col(c)) for c in SCOPE]).alias("key"))
    b = keyed.select(F.col("result_id").alias("other_id"), F.col("direction").alias("other"), "key")
    return keyed.join(b, "key").filter((F.col("result_id") < F.col("other_id")) & opposed(F.col("direction"), F.col("other"))).select("result_id", "other_id")


def indices(results: DataFrame) -> DataFrame:
    """(run_id, result_id, ordinal, weight, families, impacts) to (run_id, model, families, index, leading).

    A result's weight is shared among its research families; each family counts once a model, by its
    greatest contribution, the earliest on ties. Every model has a row, without contributions at 0.
    """
    alone = F.array(F.concat(F.lit("result:"), F.col("result_id").cast("string")))
    told = results.select("run_id", "ordinal", "weight", F.when(F.size("families") > 0, F.col("families")).otherwise(alone).alias("families"), F.explode("impacts").alias("model", "impact"))
    parts = told.select("run_id", "ordinal", "model", "impact", (F.col("weight") / F.size("families")).alias("share"), F.explode("families").alias("family"))
    size = F.col("impact") * F.col("share")
    best = F.max_by(F.struct(size.alias("size"), F.abs("share").alias("share")), F.struct(F.abs(size), -F.col("ordinal")))
    once = parts.groupBy("run_id", "model", "family").agg(best.alias("b"))
    got = once.groupBy("run_id", "model").agg(F.sum("b.size").alias("s"), F.sum("b.share").alias("w"), F.count("*").alias("families"))
    every = results.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(m) for m in MODEL_FAMILIES])).alias("model"))
    value = every.join(got, ["run_id", "model"], "left").select("run_id", "model", F.coalesce("families", F.lit(0)).alias("families"), F.round(F.coalesce(F.try_divide("s", "w"), F.lit(0.0)), 6).alias("index"))
    return value.withColumn("leading", F.col("index") >= F.max("index").over(Window.partitionBy("run_id")) - 0.05)  # five rows a run


def synthesis_warnings(indices_of: DataFrame, contradicted: DataFrame) -> DataFrame:
    """(run_id, leading, warnings) of the indices and (run_id, contradictions)."""
    got = indices_of.groupBy("run_id").agg(F.array_sort(F.collect_list(F.when(F.col("leading"), F.col("model")))).alias("leading"), F.max(F.abs("index")).alias("most"))
    both = got.join(contradicted, "run_id", "left")
    told = F.array(F.lit("COMPARATIVE_SUPPORT_INDEX_IS_NOT_A_TRUTH_PROBABILITY"), F.lit("MODEL_AGREEMENT_HAS_ZERO_EVIDENTIAL_WEIGHT"))
    more = failures(("UNRESOLVED_SUBSTANTIVE_CONTRADICTION", F.coalesce("contradictions", F.lit(0)) > 0), ("EVIDENCE_DOES_NOT_DISCRIMINATE_BETWEEN_MODELS", F.col("most") < 0.05))
    return both.select("run_id", "leading", F.concat(told, more).alias("warnings"))


def least_certainty(results: DataFrame, dimensions: list[str]) -> DataFrame:
    """Each run's certainty: the least of its results in every dimension."""
    return results.groupBy("run_id").agg(*[F.min(d).alias(d) for d in dimensions])


def dependency_summary(evidence: DataFrame, family: str) -> DataFrame:
    sizes = evidence.groupBy(family).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("records"), F.count("*").alias("families"), F.sum((F.col("n") > 1).cast("long")).alias("shared_families"), F.max("n").alias("largest"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("inflation"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The last row of each key over both, by an aggregate that starts map-side."""
    return _one(old.unionByName(new), key, F.max_by, ordinal)


def first_wins(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    return _one(rows, key, F.min_by, ordinal)


def _one(rows: DataFrame, key: list[str], pick, ordinal: str) -> DataFrame:
    got = rows.groupBy(*key).agg(pick(F.struct(*[c for c in rows.columns if c not in key]), F.col(ordinal)).alias("row_"))
    return got.select(*key, "row_.*").select(*rows.columns)


GENESIS = "0" * 64


def canonical_entry(sequence: Column, timestamp: Column, event: Column, payload: Column, previous: Column) -> Column:
    """The canonical JSON that an entry's hash covers: keys sorted, no blanks. `payload` is canonical JSON itself."""
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.concat(F.lit('{"event_type":'), text(event), F.lit(',"payload":'), payload, F.lit(',"previous_hash":'), text(previous), F.lit(',"sequence":'), sequence.cast("string"), F.lit(',"timestamp":'), text(timestamp), F.lit("}"))


def append(entries: DataFrame, journal: str) -> DataFrame:
    """(journal, ordinal, timestamp, event_type, payload) to entries with sequence, previous_hash and entry_hash.

    Each entry's hash covers the one before it, so a journal is folded in its order; journals are
    independent of each other.
    """
    held = entries.groupBy(journal).agg(F.sort_array(F.collect_list(F.struct("ordinal", "timestamp", "event_type", "payload"))).alias("e"))
    kind = "array<struct<sequence:int,timestamp:string,event_type:string,payload:string,previous_hash:string,entry_hash:string>>"

    def add(done: Column, e: Column) -> Column:
        previous = F.coalesce(F.try_element_at(done, F.lit(-1))["entry_hash"], F.lit(GENESIS))
        sequence = F.size(done) + 1
        own = F.sha2(canonical_entry(sequence, e["timestamp"], e["event_type"], e["payload"], previous), 256)
        return F.concat(done, F.array(F.struct(sequence.alias("sequence"), e["timestamp"].alias("timestamp"), e["event_type"].alias("event_type"), e["payload"].alias("payload"), previous.alias("previous_hash"), own.alias("entry_hash"))))

    return held.select(journal, F.explode(F.aggregate("e", F.array().cast(kind), add)).alias("x")).select(journal, "x.*")


def verify(entries: DataFrame, journal: str) -> DataFrame:
    """(journal, entries, verified, first_bad): every entry's place, link and hash are recomputed from what is stored."""
    w = Window.partitionBy(journal).orderBy("sequence")
    linked = F.col("previous_hash") == F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS))
    own = F.sha2(canonical_entry(F.col("sequence"), F.col("timestamp"), F.col("event_type"), F.col("payload"), F.col("previous_hash")), 256)
    bad = ~((F.col("sequence") == F.row_number().over(w)) & linked & (own == F.col("entry_hash")))
    checked = entries.select(journal, "sequence", F.coalesce(bad, F.lit(True)).alias("bad"))
    return checked.groupBy(journal).agg(F.count("*").alias("entries"), (~F.bool_or("bad")).alias("verified"), F.min(F.when(F.col("bad"), F.col("sequence"))).alias("first_bad"))


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, value) twice: what was added, removed or changed."""
    both = a.select("path", F.col("value").alias("old")).join(b.select("path", F.col("value").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "CHANGED")
    return both.select("path", "old", "new", change.alias("change")).filter("change is not null")
