"""Provider panels: cohorts, coverage, decomposition, shares. (provider, period date, value; null = suppressed)"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import financial_year, month_ordinal


def window_of(panel: DataFrame, first: str, last: str) -> DataFrame:
    return panel.filter(F.col("period").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def n_months(first: str, last: str) -> int:
    """Months of a window, both ends included; a reversed one is refused."""
    (a, b), (c, d) = ((int(x[:4]), int(x[5:7])) for x in (first, last))
    n = (c - a) * 12 + d - b + 1
    if n < 1:
        raise ValueError("REVERSED_WINDOW")
    return n


def continuous(panel: DataFrame, first: str, last: str) -> DataFrame:
    """Providers with a value in every month of the window."""
    return window_of(panel, first, last).groupBy("provider").agg(F.count("value").alias("n")).filter(F.col("n") == n_months(first, last)).select("provider")


def joiners(panel: DataFrame, first: str, last: str) -> DataFrame:
    """Providers with a value at the window's end that are not continuous."""
    at_end = panel.filter((F.col("period") == F.to_date(F.lit(last))) & F.col("value").isNotNull()).select("provider").distinct()
    return at_end.join(continuous(panel, first, last), "provider", "left_anti")


def first_period(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("value").isNotNull()).groupBy("provider").agg(F.min("period").alias("first_period"))


def coverage(panel: DataFrame) -> DataFrame:
    """Per month: providers present, with a value, and the share suppressed."""
    return panel.groupBy("period").agg(F.count("*").alias("present"), F.count("value").alias("valued")).withColumn("suppressed_share", F.round(1 - F.col("valued") / F.col("present"), 6))


def decompose(panel: DataFrame, first: str, last: str) -> DataFrame:
    """Growth of the fixed cohort against the whole panel by complete financial years, and its share of the log growth.

    One aggregation by provider finds the cohort, one by month gives both sums; the yearly
    rows that follow are few.
    """
    inside = window_of(panel, first, last)
    marked = inside.join(continuous(panel, first, last).withColumn("fixed", F.lit(True)), "provider", "left")
    months = marked.groupBy("period").agg(F.sum(F.when(F.col("fixed"), F.col("value"))).alias("cohort"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("whole"))
    years = months.groupBy(financial_year(F.col("period")).alias("fy")).agg(F.avg("cohort").alias("cohort"), F.avg("whole").alias("whole"), F.count("*").alias("n")).filter("n = 12")
    every = Window.orderBy("fy").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = years.withColumns({f"{c}_ratio": F.last(c).over(every) / F.first(c).over(every) for c in ("cohort", "whole")})
    log_share = F.when((F.col("cohort_ratio") > 0) & (F.col("whole_ratio") > 0) & (F.abs(F.ln("whole_ratio")) > 1e-12), F.try_divide(F.ln("cohort_ratio"), F.ln("whole_ratio")))
    return ends.select("fy", F.round("cohort", 2).alias("cohort_mean"), F.round("whole", 2).alias("whole_mean"), F.round("cohort_ratio", 6).alias("cohort_ratio"), F.round("whole_ratio", 6).alias("whole_ratio"), F.round(log_share, 4).alias("log_share"))


def guard(series: DataFrame) -> DataFrame:
    """(name, period, value): complete if no month is missing or null; else the reason."""
    out = series.groupBy("name").agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.min(month_ordinal(F.col("period"))).alias("a"), F.max(month_ordinal(F.col("period"))).alias("b"))
    reason = F.when(F.col("n") < 3, "TOO_FEW_POINTS").when(F.col("n") != F.col("b") - F.col("a") + 1, "MISSING_MONTHS").when(F.col("valued") < F.col("n"), "SUPPRESSED_CELLS")
    return out.select("name", F.col("n").alias("n_points"), reason.isNull().alias("ok"), reason.alias("reason"))


def trend(series: DataFrame) -> DataFrame:
    """First, last, least, greatest, last/first ratio and compound yearly growth of (name, period, value)."""
    out = series.filter("value is not null").groupBy("name").agg(F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"), F.min("value").alias("least"), F.max("value").alias("greatest"), (F.max(month_ordinal(F.col("period"))) - F.min(month_ordinal(F.col("period")))).alias("months"))
    ratio = F.try_divide(F.col("last"), F.col("first"))
    return out.select("name", "first", "last", "least", "greatest", F.round(ratio, 6).alias("ratio"), F.round(F.when((F.col("months") > 0) & (ratio > 0), F.pow(ratio, F.lit(12.0) / F.col("months")) - 1), 6).alias("growth_per_year"))


def share_median(panel: DataFrame, parent: DataFrame, min_months: int) -> DataFrame:
    """Median over providers of a child measure's mean share of its parent; providers with few usable months go."""
    both = panel.withColumnRenamed("value", "child").join(parent.withColumnRenamed("value", "parent"), ["provider", "period"]).filter("child is not null and parent > 0")
    shares = both.groupBy("provider").agg(F.avg(F.col("child") / F.col("parent")).alias("share"), F.count("*").alias("n")).filter(F.col("n") >= min_months)
    return shares.agg(F.count("*").alias("providers"), F.round(F.median("share"), 6).alias("median_share"))


def tertiles(sizes: DataFrame) -> DataFrame:
    """(key, size): thirds by size and key, the first two of n // 3, the rest in the last."""
    from .stats import ranked

    placed = ranked(sizes.withColumn("both_", F.struct("size", "key")), "both_", "place_").drop("both_")
    third = sizes.agg(F.floor(F.count("*") / 3).alias("third_"))  # one row
    i = F.col("place_") - 1
    return placed.join(F.broadcast(third)).select("key", "size", F.least(F.lit(2), F.when(F.col("third_") > 0, F.floor(i / F.col("third_"))).otherwise(2)).cast("int").alias("tertile"))


def slope_breaks(series: DataFrame, k: int) -> DataFrame:
    """(i, value): how far the slope of the k points from i on is from that of the k points before it."""
    w = Window.orderBy("i")
    after, before = w.rowsBetween(0, k - 1), w.rowsBetween(-k, -1)
    slope = lambda f: F.regr_slope(F.col("value"), F.col("i").cast("double")).over(f)
    full = (F.count("value").over(after) == k) & (F.count("value").over(before) == k)
    return series.select("i", F.when(full, F.round(F.abs(slope(after) - slope(before)), 4)).alias("slope_break")).filter("slope_break is not null")


def standardised(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum over bands of weight share times count per head. counts: (group, band, n, population); weights: (band, w)."""
    share = weights.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy()))
    return counts.join(share, "band").groupBy("grp").agg(F.round(F.sum(F.col("w") * F.col("n") / F.col("population")), 6).alias("rate"))


def index_reasons(points: DataFrame) -> DataFrame:
    """(name, value, count, denominator) to (name, n, reason): why a series is an index and no trend; null if it is one."""
    got = points.groupBy("name").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.count_if((F.col("count") == F.col("denominator"))).alias("equal")
    )
    every = F.concat(F.lit(" in all "), F.col("n").cast("string"), F.lit(" periods - index, not trend"))
    reason = (
        F.when(F.col("missing") > 0, "missing value present")
        .when(F.col("least") == F.col("greatest"), F.concat(F.lit("constant value "), F.col("least").cast("string"), every))
        .when(F.col("equal") == F.col("n"), "count == denominator in every period - index, not trend")
    )
    return got.select("name", "n", reason.alias("reason"))


def usable(complete, pooled, n_points):
    """Whether a recovered series can be used: whole, not pooled and of three points or more."""
    return F.coalesce(complete & ~pooled & (n_points >= 3), F.lit(False))
