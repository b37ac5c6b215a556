"""Look-ups: bodies in a register by name, abstracts by a record's keys, searches of counterevidence by lane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as T
from .synthesis import failures

# Registers with the statuses that count, the namespace of their numbers, and what their answers are called.
REGISTERS = {
    "companies": (["active", "open"], "companies_house", "EXACT_UNIQUE_ACTIVE_MATCH", "ONLY_DISSOLVED_NAME_MATCH", "ACTIVE_MATCHES"),
    "charities": (["r"], "charity_number", "EXACT_UNIQUE_REGISTERED_MATCH", "ONLY_REMOVED_NAME_MATCH", "REGISTERED_MATCHES"),
    "research": (["active"], "ror", "EXACT_UNIQUE_ACTIVE_MATCH", "NO_EXACT_ACTIVE_MATCH", "ACTIVE_MATCHES"),
}
MANDATORY = ["CONTRADICT", "RIVAL", "NULL"]


def resolve_names(entities: DataFrame, register: DataFrame, kind: str) -> DataFrame:
    """(node, name, identifiers) against (number, title, status): the number of the one entry of the same name that counts.

    Names are compared by equality after folding, so bodies and entries are joined, never searched.
    A body that has a strong identifier is not looked up; several entries are ambiguous, and an entry
    whose status does not count is told apart from none.
    """
    accepted, _, found, other, several = REGISTERS[kind]
    none = "NO_EXACT_ACTIVE_MATCH" if kind == "research" else "NO_EXACT_NAME_MATCH"
    counts = F.lower(F.coalesce("status", F.lit(""))).isin(accepted)
    by_name = register.groupBy(T.normalise_name(F.col("title")).alias("key")).agg(F.countDistinct(F.when(counts, F.col("number"))).alias("n"), F.min(F.when(counts, F.upper("number") if kind != "research" else F.regexp_extract("number", r"([^/]*)$", 1))).alias("number"))
    name = F.trim(F.col("name"))
    asked = entities.select("*", T.normalise_name(F.col("name")).alias("key"))
    met = asked.join(by_name, "key", "left")
    reason = (
        F.when(F.size(I.strong_identifiers(F.col("identifiers"))) > 0, "ALREADY_HAS_STRONG_IDENTIFIER")
        .when(name == "", "EMPTY_NAME")
        .when(F.col("n") == 1, found)
        .when(F.col("n") > 1, F.concat(F.lit("AMBIGUOUS_"), F.col("n").cast("string"), F.lit(f"_{several}")))
        .when(F.col("n") == 0, other)
        .otherwise(none)
    )
    return met.select("node", "name", "identifiers", reason.alias("reason"), F.when(reason == found, F.col("number")).alias("resolved"))


def identified(attempts: DataFrame, kind: str) -> DataFrame:
    """The entities with the numbers that were found among their identifiers."""
    more = F.map_concat(F.map_filter("identifiers", lambda k, v: k != REGISTERS[kind][1]), F.create_map(F.lit(REGISTERS[kind][1]), F.col("resolved")))
    return attempts.select("node", "name", F.when(F.col("resolved").isNotNull(), more).otherwise(F.col("identifiers")).alias("identifiers"))


def resolution_reasons(attempts: DataFrame) -> DataFrame:
    return attempts.filter("resolved is null").groupBy("reason").agg(F.count("*").alias("n"))


def enrich(evidence: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(evidence_id, title, content, dependency_family, identifiers) with the first abstract that (source, ordinal, kind, value, abstract)
    has for any of a record's keys: keys in their order, sources in theirs. `content` is null where it has the abstract already."""
    keys = evidence.select("evidence_id", F.posexplode(I.lookup_keys(F.col("identifiers"), F.col("dependency_family"), F.col("title"))).alias("place", "k"))
    clean = abstracts.select("source", "ordinal", F.col("kind").alias("a_kind"), F.col("value").alias("a_value"), I.clean_abstract(F.col("abstract")).alias("abstract")).filter("abstract is not null")
    met = keys.join(clean, (F.col("k.kind") == F.col("a_kind")) & (F.col("k.value") == F.col("a_value")))
    best = met.groupBy("evidence_id").agg(F.min(F.struct("place", "ordinal", "source", "abstract", "a_kind", "a_value")).alias("b"))
    joined = evidence.join(best, "evidence_id")
    return joined.select("evidence_id", F.col("b.source").alias("source"), F.col("b.a_kind").alias("lookup_kind"), F.col("b.a_value").alias("lookup_value"), I.merged_content(F.col("title"), F.col("content"), F.col("b.abstract")).alias("content"))


def lane_searches(queries: DataFrame) -> DataFrame:
    """(proposition, lane, query, completed, errors, returned, confirmed) to each lane's status; a whole search without a record is a genuine zero."""
    got = queries.groupBy("proposition", "lane").agg(F.count("*").alias("queries"), F.count_if("completed").alias("completed"), F.sum("errors").alias("errors"), F.sum("returned").alias("returned"), F.sum("confirmed").alias("confirmed"))
    status = F.when(F.col("completed") == 0, "UNSEARCHED_ERROR").when((F.col("errors") > 0) | (F.col("completed") < F.col("queries")), "SEARCHED_PARTIAL").otherwise("SEARCHED_COMPLETE")
    return got.select("proposition", "lane", "queries", "returned", "confirmed", status.alias("status"), ((status == "SEARCHED_COMPLETE") & (F.col("returned") == 0)).alias("genuine_zero"))


def mandatory_lanes(searches: DataFrame) -> DataFrame:
    """(proposition, lane, status) of the lanes that must be searched; one that has no search was not attempted."""
    every = searches.select("proposition").distinct().select("proposition", F.explode(F.array(*[F.lit(x) for x in MANDATORY])).alias("lane"))
    return every.join(searches.select("proposition", "lane", "status"), ["proposition", "lane"], "left").select("proposition", "lane", F.coalesce("status", F.lit("NOT_ATTEMPTED")).alias("status"))


def missing_lanes(searches: DataFrame) -> DataFrame:
    """(proposition, missing): mandatory lanes that were not searched, in order; null if all were."""
    lanes = mandatory_lanes(searches)
    bad = F.col("status").isin("NOT_ATTEMPTED", "UNSEARCHED_ERROR")
    got = lanes.groupBy("proposition").agg(*[F.bool_or(bad & (F.col("lane") == x)).alias(x) for x in MANDATORY])
    told = F.array_join(failures(*[(x, F.col(x)) for x in MANDATORY]), ",")
    return got.select("proposition", F.nullif(told, F.lit("")).alias("missing"))


def lane_totals(searches: DataFrame) -> DataFrame:
    """Per lane: records returned and confirmed, and how many searches were whole, in part, failed or genuine zeros."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return searches.groupBy("lane").agg(F.sum("returned").alias("returned"), F.sum("confirmed").alias("lane_confirmed"), is_("SEARCHED_COMPLETE").alias("searched_complete"), is_("SEARCHED_PARTIAL").alias("searched_partial"), is_("UNSEARCHED_ERROR").alias("unsearched"), F.count_if("genuine_zero").alias("genuine_zero"))
