"""Which propositions open data can test: access of their workstreams, design and predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Access tokens, designs about individuals, and predictor concepts: id, terms in a prediction, terms in a workstream's data.
OPEN_TOKENS = ["OPEN", "OPEN_AGGREGATE", "OPEN_API", "OPEN_ARCHIVE", "OPEN_CORPUS", "PUBLIC_WEB"]
PRIMARY_TOKENS = ["PRIMARY_RESEARCH"]
INDIVIDUAL = ["pre-exposure baseline and longitudinal follow-up", "longitudinal; exposure must precede outcome"]
PREDICTORS = [
    ("DISCLOSURE_OR_HELP_SEEKING", ["disclosure", "help-seeking", "help seeking"], ["disclosure", "help-seeking", "narrative", "interview"]),
    ("AWARENESS_OR_MEDIA_ATTENTION", ["awareness", "media attention", "search/media"], ["search behaviour", "media-use", "news corpora", "gdelt", "framing", "platform use", "web archives"]),
    ("ACCESS_GRADIENT", ["variation in access", "access predicts", "distance", "travel"], ["distance", "travel time", "need proxy", "access gradient"]),
    ("FOLLOW_UP_OF_INDIVIDUALS", ["attrition", "ipw", "mnar", "missingness", "follow-up"], ["repeated measures", "longitudinal", "cohort", "follow-up"]),
    ("ADOPTION_OUTCOME_PER_NODE", ["adoption"], ["adoption", "uptake", "implementation outcome"]),
    ("CROSS_JURISDICTION_PANEL", ["cross-jurisdiction", "cross jurisdiction", "macro longitudinal"], ["cross-jurisdiction", "international", "country-level", "comparative"]),
]


def tokens(value: Column) -> Column:
    """Items of a list written with semicolons or commas."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def _named(text: Column, at: int) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(sum((F.contains(low, F.lit(x)).cast("int") for x in p[at]), F.lit(0)) > 0, F.lit(p[0])) for p in PREDICTORS]))


def named_predictors(prediction: Column) -> Column:
    """The predictor concepts that a prediction names."""
    return _named(prediction, 1)


def carried_predictors(data: Column) -> Column:
    """The predictor concepts that a workstream's data carry."""
    return _named(data, 2)


def census(propositions: DataFrame, workstreams: DataFrame) -> DataFrame:
    """(proposition_id, model_family, required, prediction, temporal) and (workstream_id, access, data) to how each can be reached.

    A workstream that is not registered has no open route. Workstreams are joined by id, so a
    proposition only meets those it asks for.
    """
    listed = propositions.select("*", tokens(F.col("required")).alias("ids"))
    asked = listed.select("proposition_id", F.explode_outer("ids").alias("workstream_id"))
    access = tokens(F.col("access"))
    is_open, primary = F.arrays_overlap(access, F.array(*[F.lit(x) for x in OPEN_TOKENS])), F.arrays_overlap(access, F.array(*[F.lit(x) for x in PRIMARY_TOKENS]))
    told = workstreams.select("workstream_id", is_open.alias("is_open"), primary.alias("primary"), carried_predictors(F.col("data")).alias("carried"))
    met = asked.join(told, "workstream_id", "left")
    shut = ~F.coalesce("is_open", F.lit(False)) & F.col("workstream_id").isNotNull()
    collect = lambda rule: F.array_sort(F.collect_list(F.when(rule, F.col("workstream_id"))))
    is_primary = shut & F.coalesce("primary", F.lit(False))
    got = met.groupBy("proposition_id").agg(collect(is_primary).alias("by_hand"), collect(shut & ~is_primary).alias("blocked"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("carried", F.array().cast("array<string>"))))).alias("carried"))
    both = listed.join(got, "proposition_id")
    missing = F.array_except(named_predictors(F.col("prediction")), F.col("carried"))
    individual = F.lit(False)
    for marker in INDIVIDUAL:
        individual = individual | F.contains(F.coalesce("temporal", F.lit("")), F.lit(marker))
    reach = F.when(F.size("by_hand") > 0, "NEEDS_PRIMARY_COLLECTION").when(F.size("blocked") > 0, "NEEDS_RESTRICTED_ACCESS").when(individual, "NEEDS_INDIVIDUAL_LEVEL").when(F.size(missing) > 0, "NEEDS_PREDICTOR_SOURCE").otherwise("OPEN_TESTABLE")
    blocking = F.when(F.size("blocked") > 0, F.col("blocked")).otherwise(F.col("by_hand"))
    return both.select("proposition_id", "model_family", reach.alias("reachability"), F.array_join(blocking, ";").alias("blocking"), F.array_join(missing, ";").alias("missing_predictors"))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("reachability").agg(F.count("*").alias("n"))


def asymmetry(found: DataFrame) -> DataFrame:
    """(model_family, testable, propositions, dominates): families that open data cannot test at all have 0."""
    by = found.groupBy("model_family").agg(F.count_if(F.col("reachability") == "OPEN_TESTABLE").alias("testable"), F.count("*").alias("propositions"))
    total = by.agg(F.sum("testable").alias("total"))  # one row
    return by.join(F.broadcast(total)).select("model_family", "testable", "propositions", F.coalesce(F.col("testable") > 0.5 * F.col("total"), F.lit(False)).alias("dominates"))


def source_coverage(workstreams: DataFrame, connectors: DataFrame, stored: DataFrame) -> DataFrame:
    """(workstream_id, source_ids) against registered connectors and sources with records (source_id)."""
    told = workstreams.select("workstream_id", F.explode(F.array_distinct(tokens(F.col("source_ids")))).alias("source_id"))
    known = connectors.filter(~F.col("source_id").startswith("UNREGISTERED:")).select("source_id", F.lit(True).alias("known")).distinct()
    kept = stored.select("source_id", F.lit(True).alias("kept")).distinct()
    both = told.join(known, "source_id", "left").join(kept, "source_id", "left")
    listed = lambda rule: F.array_join(F.array_sort(F.collect_list(F.when(rule, F.col("source_id")))), ";")
    return both.groupBy("workstream_id").agg(listed(F.lit(True)).alias("declared"), listed(F.col("known")).alias("with_connector"), listed(F.col("kept")).alias("with_records"), listed(F.col("known").isNull()).alias("unknown"))


# What a study of each kind needs.
DESIGNS = {
    "NEEDS_PRIMARY_COLLECTION": "prospective cohort with recruited participants",
    "NEEDS_INDIVIDUAL_LEVEL": "record-linkage cohort from existing individual-level administrative data",
    "NEEDS_RESTRICTED_ACCESS": "analysis within a secure environment or under licence",
    "NEEDS_PREDICTOR_SOURCE": "open-data analysis, once a workstream carrying the named predictor is required and harvested",
}


def design_for(reachability: Column) -> Column:
    out = F.lit("open-data analysis")
    for name, design in DESIGNS.items():
        out = F.when(reachability == name, design).otherwise(out)
    return out
