"""What a study of a size can show: envelopes, populations, sensitivity bounds and severity of a calibration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.synthesis import failures
from .numbers import severity_band


def source_population(events: Column, rate: Column) -> Column:
    """How many must be followed for a number of events; null for impossible rates."""
    return F.when((events > 0) & (rate > 0) & (rate <= 1), F.ceil(events / rate).cast("long"))


def envelope(n: Column, parameters: Column, events: Column, design_effect: Column, attrition: Column) -> Column:
    """(effective_n, events_per_parameter, tier, warnings): a planning ceiling for what n participants can carry."""
    effective, each = n * (1 - attrition) / design_effect, events / parameters
    code = F.when(effective < 200, "VERY_LIMITED_EFFECTIVE_SAMPLE").when(events < 50, "RARE_EVENT_INFORMATION_LIMIT").when(effective < 1000, "SUBGROUP_AND_INTERACTION_LIMIT").when(each < 10, "MODEL_PARAMETER_INFORMATION_LIMIT")
    tier = F.when(code.isNull(), "LIMITED_CAUSAL_EVIDENCE").when(code == "VERY_LIMITED_EFFECTIVE_SAMPLE", "DESCRIPTIVE_EVIDENCE_ONLY").otherwise("ASSOCIATION_ONLY")
    return F.struct(effective.alias("effective_n"), each.alias("events_per_parameter"), tier.alias("tier"), F.array_compact(F.array(code, F.lit("CLAIM_TIER_IS_PLANNING_CEILING_NOT_CAUSAL_VALIDATION"))).alias("warnings"))


def sensitivity(ratio: Column, limit: Column) -> Column:
    """(e_value, limit, reading): how strong a hidden cause must be; a limit on the other side of 1 needs none."""

    def bound(x: Column) -> Column:
        up = F.when(x < 1, 1 / x).otherwise(x)
        return F.when(F.abs(up - 1) <= 1e-9 * up, 1.0).otherwise(up + F.sqrt(up * (up - 1)))

    value = bound(ratio)
    crosses = ((ratio > 1) & (limit <= 1)) | ((ratio < 1) & (limit >= 1))
    reading = F.when(value < 1.5, "FRAGILE").when(value < 3, "MODERATE").otherwise("ROBUST")
    return F.struct(value.alias("e_value"), F.when(limit.isNotNull(), F.when(crosses, 1.0).otherwise(bound(limit))).alias("limit"), reading.alias("reading"))


def severity(grid: Column, accepted: Column, tolerance: Column, values: Column) -> Column:
    """(rejection, tightness, constraint, index, band): how hard a calibration on a series (an array) was to survive."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.array_max(values) - F.array_min(values)
    spread = F.when(spread > 0, spread).when(mean != 0, F.abs(mean)).otherwise(1.0)
    deviation = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n) / spread
    rejection = F.when(grid > 0, (grid - accepted) / grid).otherwise(0.0)
    tightness = F.when(deviation <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(tolerance, deviation)))
    constraint = F.greatest(F.lit(0.0), (n - 2) / n)
    index = F.pow(rejection * tightness * constraint, F.lit(1.0 / 3.0))
    return F.struct(rejection.alias("rejection"), tightness.alias("tightness"), constraint.alias("constraint"), index.alias("index"), severity_band(index).alias("band"))


def corroboration(accepted: Column, band: Column) -> Column:
    """(direction, corroboration): no accepted point weakens a mechanism, survival only counts by how severe the test was."""
    direction = F.when(accepted == 0, "WEAKENS").otherwise("INCONCLUSIVE")
    kind = F.when(accepted == 0, "NOT_APPLICABLE_REFUTED").when(band == "HIGH", "CORROBORATED_AT_HIGH_SEVERITY").when(band == "NEGLIGIBLE", "NO_CORROBORATION_TEST_NOT_SEVERE").otherwise("COMPATIBLE_ONLY")
    return F.struct(direction.alias("direction"), kind.alias("corroboration"))


def coverage_mechanism(level: Column, wobble: Column, i: Column) -> Column:
    """A series that only wobbles with coverage."""
    return level * (1 + wobble * F.sin(i / 2))


def growth_mechanism(level: Column, rate: Column, i: Column) -> Column:
    return level * F.pow(1 + rate, i)


def power_warnings(effective_n: Column, power: Column, design_effect: Column) -> Column:
    return failures(("VERY_LIMITED_EFFECTIVE_SAMPLE", effective_n < 200), ("UNDERPOWERED_A_NULL_HERE_IS_NOT_EVIDENCE_OF_ABSENCE", power < 0.80), ("SUBSTANTIAL_CLUSTERING_EFFECTIVE_SAMPLE_MUCH_SMALLER_THAN_RECORD_COUNT", design_effect > 2))
