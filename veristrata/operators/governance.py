"""Admission gates, authority, claim tiers, reviews and releases: rules over columns, failures as arrays of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from .synthesis import failures

# Object types that only people may change, levels of authority, tiers of claims and their ranks.
PROTECTED_TYPES = ["SCIENTIFIC_CONSTITUTION", "CONSENT_DECISION", "ETHICS_DECISION", "LEGAL_BASIS_DECISION", "PREREGISTERED_SPECIFICATION", "RELEASE_DECISION"]
HUMAN_LEVEL = 4
LANE_AUTHORITY = {"HUMAN_CODER": 4, "SOURCE_DECLARED": 3, "AUTOMATED_CLASSIFIER": 1}
MODEL_FAMILIES = ["INTRINSIC_RECOGNITION", "MULTIFACTORIAL_DEVELOPMENTAL_INSTITUTIONAL", "ASCERTAINMENT_SERVICE", "MIXTURE_HETEROGENEITY", "NULL_OR_ALTERNATIVE"]
DESCRIPTIVE, ASSOCIATION, LIMITED, MODERATE, HIGH, THEORY, SIMULATION = (
    "DESCRIPTIVE_EVIDENCE_ONLY",
    "ASSOCIATION_ONLY",
    "LIMITED_CAUSAL_EVIDENCE",
    "MODERATE_TRIANGULATED_CAUSAL_EVIDENCE",
    "HIGH_TRIANGULATED_CAUSAL_EVIDENCE",
    "THEORY_DEPENDENT_INTERPRETATION",
    "SIMULATION_ONLY",
)
TIER_RANK = {DESCRIPTIVE: 0, THEORY: 0, SIMULATION: 0, ASSOCIATION: 1, LIMITED: 2, MODERATE: 3, HIGH: 4}
REQUIRED_LANES = ["CONTRADICT", "RIVAL", "NULL"]

# Phrases that a tier does not license.
PROHIBITED = {
    DESCRIPTIVE: ["causes", "caused by", "leads to", "drives", "because of", "explains", "predicts", "associated with", "linked to", "effect of", "impact of", "proves", "demonstrates that"],
    ASSOCIATION: ["causes", "caused by", "leads to", "drives", "because of", "the effect of", "responsible for", "proves", "demonstrates that", "explains why"],
    LIMITED: ["proves", "demonstrates that", "establishes that", "definitively", "conclusively", "shows that X causes"],
    MODERATE: ["proves", "definitively", "conclusively", "beyond doubt"],
    HIGH: ["proves", "beyond doubt", "certain", "irrefutable"],
    THEORY: ["proves", "demonstrates that", "shows objectively", "the data show"],
    SIMULATION: ["we found", "the evidence shows", "in reality", "observed", "proves", "demonstrates that", "causes"],
}


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


# ---------------------------------------------------------------- admission


def _provenance(status: Column, uri: Column, checksum: Column, access: Column, approval: Column) -> list[tuple[str, Column]]:
    return [
        ("SOURCE_STATUS_UNVERIFIED", status == "UNVERIFIED"),
        ("SOURCE_URI_MISSING", blank(uri)),
        ("CHECKSUM_MISSING", blank(checksum)),
        ("LICENCE_OR_APPROVAL_MISSING", access.isin("LICENSED", "PARTICIPANT_SECURE") & blank(approval)),
    ]


def evidence_failures(e: Column) -> Column:
    """Codes of a record (a struct) that keep it from being admitted, in order."""
    secure = e["access_class"] == "TRE_SDE"
    return failures(
        *_provenance(e["source_status"], e["source_uri"], e["checksum_sha256"], e["access_class"], e["licence_or_approval"]),
        ("TRE_APPROVAL_MISSING", secure & blank(e["licence_or_approval"])),
        ("TRE_RAW_PERSON_LEVEL_PAYLOAD_PROHIBITED", secure & e["raw_person_level"]),
        ("DEPENDENCY_FAMILY_MISSING", blank(e["dependency_family"])),
        ("SOURCE_WORK_RETRACTED", F.coalesce(e["retracted"], F.lit(False))),
        ("CONTENT_HASH_MISMATCH", ~blank(e["content"]) & ~blank(e["content_sha256"]) & (F.sha2(e["content"], 256) != e["content_sha256"])),
    )


def entity_failures(e: Column) -> Column:
    return failures(*_graph(e))


def relation_failures(e: Column) -> Column:
    """As for a body; a relation also needs a start."""
    return failures(*_graph(e), ("RELATION_UNDATED", e["valid_from"].isNull()))


def _graph(e: Column) -> list[tuple[str, Column]]:
    return [
        *_provenance(e["source_status"], e["source_uri"], e["checksum_sha256"], e["access_class"], e["licence_or_approval"]),
        ("TRE_SDE_SOURCE_PROHIBITED_FOR_ONTOLOGY", e["access_class"] == "TRE_SDE"),
        ("DEPENDENCY_FAMILY_MISSING", blank(e["dependency_family"])),
    ]


def precedes(start: Column, outcome: Column) -> Column:
    return F.coalesce(start < outcome, F.lit(False))


def crosses_boundary(access: Column, raw_person_level: Column) -> Column:
    """Whether a record would carry rows about persons out of a secure environment: it must not exist at all."""
    return (access == "TRE_SDE") & raw_person_level


def impact_problem(impacts: Column) -> Column:
    """Why a result's impacts by model family cannot stand; null if they can."""
    unknown = F.exists(F.map_keys(impacts), lambda k: ~k.isin(MODEL_FAMILIES))
    return F.when(unknown, "UNKNOWN_MODEL_FAMILY").when(F.exists(F.map_values(impacts), lambda v: F.abs(v) > 1), "IMPACT_OUT_OF_RANGE")


# ---------------------------------------------------------------- authority and tiers


def lane_authority(method: Column) -> Column:
    """The level that a lane's coding carries: a classifier proposes, only a person decides."""
    out = F.lit(LANE_AUTHORITY["AUTOMATED_CLASSIFIER"])
    for name, level in LANE_AUTHORITY.items():
        out = F.when(method == name, level).otherwise(out)
    return out


def is_protected(object_type: Column) -> Column:
    return object_type.isin(PROTECTED_TYPES)


def patch_problem(held_type: Column, held: Column, object_type: Column, proposed: Column, human: Column) -> Column:
    """Why a change of an object (held: null if there is none) is refused; null if it is not."""
    return (
        F.when(held.isNotNull() & (held_type != object_type), "OBJECT_TYPE_MISMATCH")
        .when(held.isNotNull() & (proposed < held), "LOWER_AUTHORITY_OVERWRITE")
        .when(is_protected(object_type) & (proposed < HUMAN_LEVEL) & ~human, "PROTECTED_TYPE_REQUIRES_HUMAN_AUTHORISATION")
    )


def apply_patches(state: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, type, level, value) and (id, type, level, value, human): the state after at most one patch an object, and why one was refused."""
    p = patches.select("id", F.col("type").alias("new_type"), F.col("level").alias("proposed"), F.col("value").alias("new_value"), "human")
    both = state.join(p, "id", "full")
    problem = F.when(F.col("proposed").isNotNull(), patch_problem(F.col("type"), F.col("level"), F.col("new_type"), F.col("proposed"), F.col("human")))
    taken = F.col("proposed").isNotNull() & problem.isNull()
    return both.select("id", F.coalesce("type", F.when(taken, F.col("new_type"))).alias("type"), F.when(taken, F.col("proposed")).otherwise(F.col("level")).alias("level"), F.when(taken, F.col("new_value")).otherwise(F.col("value")).alias("value"), problem.alias("refused"))


def claim_tier(c: Column, status: Column, theory_dependent: Column | None = None, simulation_only: Column | None = None) -> Column:
    """The highest tier that a certainty (a struct of its dimensions) carries: the weakest dimension limits it."""
    theory, simulated = (F.lit(False) if x is None else x for x in (theory_dependent, simulation_only))
    least = N.weakest(c)["value"]
    return (
        F.when(simulated | (status == "SIMULATION"), SIMULATION)
        .when(theory & (status == "INTERPRETATION"), THEORY)
        .when(status == "ASSOCIATION", ASSOCIATION)
        .when(~status.isin("CAUSAL_INFERENCE", "RECOMMENDATION"), DESCRIPTIVE)
        .when((c["causal_identification"] < 0.70) | (c["temporal_ordering"] < 0.70), ASSOCIATION)
        .when((least >= 0.80) & (c["replication"] >= 0.75) & (c["source_independence"] >= 0.75), HIGH)
        .when((least >= 0.60) & (c["replication"] >= 0.50), MODERATE)
        .when(least >= 0.40, LIMITED)
        .otherwise(ASSOCIATION)
    )


def tier_rank(tier: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in TIER_RANK.items():
        out = F.when(tier == name, rank).otherwise(out)
    return out


# ---------------------------------------------------------------- reviews and releases


def prohibited_hits(text: Column, tier: Column, phrases: dict[str, list[str]]) -> Column:
    """The phrases in a text, at a word's start, that its tier does not license."""
    from ..functions.text import phrases_in

    out = F.array().cast("array<string>")
    for name, some in phrases.items():
        out = F.when(tier == name, phrases_in(text, some)).otherwise(out)
    return out


def kernel_review(population: Column, status: Column, tier: Column, falsifier: Column, provenance_completeness: Column) -> Column:
    """Why a result needs a person's review; empty if it does not."""
    return failures(
        ("SENSITIVE_OR_CHILD_POPULATION", F.lower(population).rlike("child|children|adolescent|vulnerable")),
        ("CAUSAL_CLAIM_WITH_LIMITED_CERTAINTY", (status == "CAUSAL_INFERENCE") & tier.isin(ASSOCIATION, LIMITED)),
        ("FALSIFIER_TRIGGERED", falsifier.isin("PARTIALLY_TRIGGERED", "TRIGGERED")),
        ("LOW_PROVENANCE_COMPLETENESS", provenance_completeness < 0.8),
    )


def synthesis_review(warnings: Column, contradictions: Column, tier: Column) -> Column:
    """Sorted reasons for a review: the warnings, contradictions (their number) and a strong tier."""
    more = failures(("UNRESOLVED_SUBSTANTIVE_CONTRADICTION", contradictions > 0), ("HIGH_IMPACT_CAUSAL_RELEASE", tier.isin(MODERATE, HIGH)))
    return F.array_sort(F.array_distinct(F.concat(warnings, more)))


def can_release(kind: Column, decision: Column) -> Column:
    """Whether a review lets a claim out: only a person's, and only an approval."""
    return (kind == "HUMAN") & decision.isin("APPROVED", "APPROVED_WITH_CONDITIONS")


def review_failure(kind: Column, decision: Column) -> Column:
    """kind: HUMAN, AI, TEXT (a mere reference) or null."""
    return (
        F.when(kind == "AI", "AI_REVIEW_CANNOT_SATISFY_HUMAN_REVIEW_GATE")
        .when((kind == "HUMAN") & ~can_release(kind, decision), F.concat(F.lit("HUMAN_REVIEW_DECISION_"), decision))
        .when(kind == "TEXT", "HUMAN_REVIEW_REFERENCE_NOT_A_REVIEW_RECORD")
        .when(kind.isNull(), "HUMAN_REVIEW_RECORD_MISSING")
    )


def release_failures(r: Column, phrases: dict[str, list[str]] = PROHIBITED) -> Column:
    """Why a result (a struct) cannot be released as worded. evidence: (evidence_id, admitted) of the records at hand."""
    known = F.transform(r["evidence"], lambda e: e["evidence_id"])
    dangling = F.size(F.filter(r["evidence_ids"], lambda i: ~F.array_contains(known, i)))
    unadmitted = F.size(F.filter(r["evidence"], lambda e: ~e["admitted"]))
    missing = F.filter(F.array(*[F.lit(x) for x in REQUIRED_LANES]), lambda x: ~F.array_contains(r["lanes_searched"], x))
    hits = prohibited_hits(r["wording"], r["claim_tier"], phrases)
    some = lambda rule, text: F.when(rule, text)
    return F.array_compact(
        F.array(
            some(blank(r["proposition_id"]), F.lit("PROPOSITION_ID_MISSING")),
            some(F.size(r["evidence_ids"]) == 0, F.lit("EVIDENCE_IDS_MISSING")),
            some(F.size(r["dependency_families"]) == 0, F.lit("DEPENDENCY_FAMILIES_MISSING")),
            some(dangling > 0, F.concat(F.lit("EVIDENCE_IDS_NOT_RESOLVABLE:"), dangling.cast("string"))),
            some(unadmitted > 0, F.concat(F.lit("UNADMITTED_EVIDENCE_PRESENT:"), unadmitted.cast("string"))),
            some(F.size(missing) > 0, F.concat(F.lit("COUNTEREVIDENCE_LANES_NOT_SEARCHED:"), F.array_join(missing, ","))),
            some(F.size(hits) > 0, F.concat(F.lit("WORDING_EXCEEDS_CLAIM_TIER:"), F.array_join(hits, ","))),
            review_failure(r["review_kind"], r["review_decision"]),
        )
    )


def documented_failures(declared: Column, r: Column, has_result: Column, phrases: dict[str, list[str]] = PROHIBITED) -> Column:
    """Why a claim in a document cannot be released: `declared` is its tier, r the result it rests on."""
    hits = prohibited_hits(r["wording"], declared, phrases)
    worded = F.when(F.size(hits) > 0, F.concat(F.lit("WORDING_EXCEEDS_CLAIM_TIER:"), F.array_join(hits, ",")))
    apart = F.when(r["claim_tier"] != declared, F.concat(F.lit("DECLARED_TIER_DISAGREES_WITH_RESULT:"), declared, F.lit("!="), r["claim_tier"]))
    return (
        F.when(declared.isNull(), F.array(F.lit("CLAIM_TIER_NOT_DECLARED")))
        .when(~has_result, F.array_compact(F.array(worded, F.lit("NO_PERSISTED_RESULT_FOR_CLAIM"))))
        .otherwise(F.array_distinct(F.concat(F.array_compact(F.array(worded, apart)), release_failures(r, phrases))))
    )


def lane_assignment(lane: Column, method: Column, assigned: Column) -> Column:
    """(lane, method): a person's or a source's code stays, a declared lane gets a source's code, all else the classifier's."""
    kept = method.isNotNull() & (method != "AUTOMATED_CLASSIFIER")
    declared = method.isNull() & (lane != "UNCLASSIFIED")
    return F.struct(F.when(kept | declared, lane).otherwise(assigned).alias("lane"), F.when(kept, method).when(declared, "SOURCE_DECLARED").otherwise("AUTOMATED_CLASSIFIER").alias("method"))


def handoff_failures(state: Column, handoff: Column) -> Column:
    """What a handoff of work loses against the state that it continues."""
    dropped = lambda field: F.size(F.array_except(state[field], handoff[field])) > 0
    coded = failures(
        ("STALE_STATE_VERSION", ~handoff["from_state_version"].eqNullSafe(state["state_version"])),
        ("RESUME_TASK_AMBIGUOUS", blank(handoff["active_task_id"])),
        ("OPEN_ISSUE_DROPPED", dropped("unresolved_issue_ids")),
        ("CONTRADICTION_DROPPED", dropped("contradiction_ids")),
        ("REJECTED_PATH_DROPPED", dropped("rejected_path_ids")),
        ("MUST_READ_REFERENCE_DROPPED", dropped("must_read_refs")),
    )
    drifted = F.filter(F.map_entries(state["artifact_hashes"]), lambda e: ~handoff["artifact_hashes"][e["key"]].eqNullSafe(e["value"]))
    return F.concat(coded, F.array_sort(F.transform(drifted, lambda e: F.concat(F.lit("ARTIFACT_HASH_DRIFT:"), e["key"]))))
