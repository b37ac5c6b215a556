"""Published cells, period labels and small arithmetic. Missing stays missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What publishers write for a missing cell: in education data, in indicators, in health statistics.
EDUCATION_MARKERS = ["z", "c", "x", "k", "u", "low", "~", ":", "-", ""]
INDICATOR_MARKERS = ["", "-", "*", "n/a", "NA"]
CUBE_MARKERS = ["", "-", "*", ":", "n/a", "NA"]
HEALTH_MARKERS = ["*", "**", ".", "..", "...", "-", "--", ":", "c", "z", "w", "x", "u", "n/a", "na", "n/k", "nk", "null", "none", "suppressed", "not available", "not applicable", "no data"]

# How financial quarters, financial years, months and calendar years are written.
QUARTER, FINANCIAL_YEAR, MONTH, CALENDAR_YEAR = r"(?i)^\s*Q([1-4])\s+(\d{4})\s*[/-]\s*(\d{2}|\d{4})\s*$", r"^\s*(\d{4})\s*[/-]\s*(\d{2}|\d{4})\s*$", r"^\s*([A-Za-z]{3,9})\s+(\d{4})\s*$", r"^\s*(\d{4})\s*$"


def number(raw: Column) -> Column:
    return F.replace(F.trim(raw), F.lit(","), F.lit("")).try_cast("double")


def marked_cell(raw: Column, markers: list[str] = EDUCATION_MARKERS) -> Column:
    """(value, marker): a marker or text that is no number is kept as it is written; nothing at all is a colon."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    missing = F.lower(text).isin(markers)
    value = F.when(~missing, number(text))
    return F.struct(value.alias("value"), F.when(missing, F.when(text == "", ":").otherwise(text)).when(value.isNull(), text).alias("marker"))


def published_cell(raw: Column) -> Column:
    """A number of a health table; markers and text are missing, a percentage is an error of the query."""
    text = F.trim(raw)
    bare = F.regexp_replace(text, "[, ]", "")
    percent = bare.endswith("%") & ~F.lower(text).isin(HEALTH_MARKERS)
    return F.when(percent, F.raise_error(F.concat(F.lit("a percentage is no count: "), text))).when(~F.lower(text).isin(HEALTH_MARKERS), bare.try_cast("double"))


def is_suppressed(raw: Column) -> Column:
    return F.lower(F.trim(raw)).isin(HEALTH_MARKERS)


def indicator_cell(raw: Column, sentinel: float = -1.0) -> Column:
    """A number without separators; markers and the sentinel are missing."""
    return F.when(~F.trim(raw).isin(INDICATOR_MARKERS), F.nullif(F.trim(raw).try_cast("double"), F.lit(sentinel)))


def cube_cell(raw: Column) -> Column:
    """A number of a statistical cube, markers missing; there is no sentinel."""
    return F.when(~F.trim(raw).isin(CUBE_MARKERS), F.trim(raw).try_cast("double"))


def pounds(amount: Column, currency: Column) -> Column:
    """An amount in pounds, if it is in no other currency and not negative."""
    value = F.trim(F.regexp_replace(amount, "[,£]", "")).try_cast("double")
    return F.when(F.upper(F.trim(F.coalesce(currency, F.lit("")))).isin("", "GBP") & (value >= 0), value)


def span_years(label: Column) -> Column:
    """How many years a label like "2001 - 03" or "2016/17 - 20/21" pools; one year for any other."""
    shape = r"^\s*(\d{4})(?:/\d{2})?\s*-\s*(\d{2,4})"
    start, tail = F.regexp_extract(label, shape, 1).try_cast("int"), F.regexp_extract(label, shape, 2)
    end = F.when(F.length(tail) == 4, tail.try_cast("int")).otherwise(F.floor(start / 100) * 100 + tail.try_cast("int"))
    end = F.when(end < start, end + 100).otherwise(end)  # "1998 - 00" ends in the next century
    return F.greatest(F.lit(1), F.coalesce(end - start + 1, F.lit(1))).cast("int")


def period_basis(label: Column) -> Column:
    """What a period's label counts in; a blank label is an error of the query."""
    return (
        F.when(F.trim(F.coalesce(label, F.lit(""))) == "", F.raise_error(F.lit("an empty period label")))
        .when(label.rlike(QUARTER), "financial_quarter")
        .when(label.rlike(FINANCIAL_YEAR), "financial_year")
        .when(label.rlike(MONTH), "reporting_month")
        .when(label.rlike(CALENDAR_YEAR), "calendar_year")
        .otherwise("unknown")
    )


def start_year(label: Column) -> Column:
    """The year that a label begins in; null for one that names none."""
    told = [F.regexp_extract(label, p, g) for p, g in ((QUARTER, 2), (FINANCIAL_YEAR, 1), (CALENDAR_YEAR, 1), (MONTH, 2))]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in told]).cast("int")


def calendar_year(label: Column) -> Column:
    """The one calendar year of a label; null for financial periods, which have two, and for labels without a year."""
    return F.when(~period_basis(label).startswith("financial"), start_year(label))


def financial_year(month: Column) -> Column:
    """YYYY/YY of a date, the year starting in April."""
    start = F.year(month) - (F.month(month) < 4).cast("int")
    return F.concat(start.cast("string"), F.lit("/"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def month_ordinal(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month) - 1


def per_million(count: Column, whole: Column) -> Column:
    return F.when(whole > 0, count / whole * 1e6).otherwise(0.0)


def sample_for_proportion(p: Column, margin: Column, z: float = 1.96) -> Column:
    return F.ceil(F.lit(z) * F.lit(z) * p * (1 - p) / (margin * margin)).cast("long")


def sample_per_arm(effect: Column, z_alpha: float = 1.96, z_beta: float = 0.84) -> Column:
    return F.ceil(F.lit(2 * (z_alpha + z_beta) ** 2) / (effect * effect)).cast("long")


def design_effect(cluster: Column, icc: Column) -> Column:
    return 1 + (cluster - 1) * icc


def detectable_correlation(n: Column, z_alpha: float = 1.959964, z_beta: float = 0.841621) -> Column:
    """The smallest correlation that n pairs can show; none below ten pairs."""
    return F.when(n >= 10, F.tanh(F.lit(z_alpha + z_beta) / F.sqrt(n - 3)))


def e_value(ratio: Column) -> Column:
    up = F.when(ratio >= 1, ratio).otherwise(1 / ratio)
    return up + F.sqrt(up * (up - 1))


# The dimensions of a result's certainty, in their order, and bands of a severity index.
CERTAINTY = ["statistical_precision", "measurement_validity", "temporal_ordering", "causal_identification", "confounding_control", "selection_bias_control", "missing_data_robustness", "specification_stability", "source_independence", "cross_method_convergence", "replication", "transportability", "publication_selection_control", "provenance_completeness", "theory_independence", "explanatory_contribution"]
SEVERITY_BANDS = [(0.60, "HIGH"), (0.35, "MODERATE"), (0.15, "LOW")]


def weakest(certainty: Column) -> Column:
    """(value, at, name) of a certainty's least dimension, the first of equal ones."""
    parts = [F.struct(certainty[n].alias("value"), F.lit(i).alias("at"), F.lit(n).alias("name")) for i, n in enumerate(CERTAINTY)]
    return F.array_min(F.array(*parts))


def mean_certainty(certainty: Column) -> Column:
    return sum((certainty[n] for n in CERTAINTY), F.lit(0.0)) / len(CERTAINTY)


def result_weight(least: Column, families: Column, evidence: Column) -> Column:
    """A result's weight: its weakest certainty, halved as far as its evidence is not independent."""
    count = F.size(F.array_distinct(families))
    share = F.when(count > 0, F.least(F.lit(1.0), count / F.greatest(F.lit(1), evidence))).otherwise(0.25)
    return least * (0.5 + 0.5 * share)


def severity_band(index: Column) -> Column:
    out = F.lit("NEGLIGIBLE")
    for least, band in reversed(SEVERITY_BANDS):
        out = F.when(index >= least, band).otherwise(out)
    return out
