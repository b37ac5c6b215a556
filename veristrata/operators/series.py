"""Several series side by side: ratios, log changes, label steps, supports, power."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import pearson


def intensity(child: DataFrame, parent: DataFrame, min_months: int = 12) -> DataFrame:
    """Ratio of sums by provider over the months where both (provider, period, value) have a value, the parent one above 0."""
    both = child.select("provider", "period", F.col("value").alias("child")).join(parent.select("provider", "period", F.col("value").alias("parent")), ["provider", "period"])
    got = both.filter("child is not null and parent > 0").groupBy("provider").agg(F.count("*").alias("months"), F.sum("child").alias("child"), F.sum("parent").alias("parent"))
    return got.filter((F.col("months") >= min_months) & (F.col("parent") > 0)).select("provider", "months", F.round(F.col("child") / F.col("parent"), 6).alias("intensity"))


def strata_ratio(a: DataFrame, b: DataFrame, least: int = 3) -> DataFrame:
    """(period, value) twice: a over b where both are there; no rows at all for too few shared periods."""
    both = a.select("period", F.col("value").alias("x")).join(b.select("period", F.col("value").alias("y")), "period").filter("x is not null and y <> 0")
    return both.withColumn("n", F.count("*").over(Window.partitionBy())).filter(F.col("n") >= least).select("period", F.round(F.col("x") / F.col("y"), 6).alias("ratio"))


def log_change_correlations(series: DataFrame, n_series: int) -> DataFrame:
    """(name, period, value): correlation of log changes of each pair of series over periods that all of them have.

    The pairs are those of the few series, joined on the period, never of rows.
    """
    full = series.filter("value > 0").withColumn("n", F.count("*").over(Window.partitionBy("period"))).filter(F.col("n") == n_series)
    w = Window.partitionBy("name").orderBy("period")
    change = full.select("name", "period", (F.ln("value") - F.ln(F.lag("value").over(w))).alias("d")).filter("d is not null")
    b = change.select(F.col("name").alias("name_b"), "period", F.col("d").alias("e"))
    pairs = change.join(b, "period").filter("name < name_b")
    return pairs.groupBy(F.col("name").alias("a"), F.col("name_b").alias("b")).agg(F.count("*").alias("n"), F.round(pearson("d", "e"), 6).alias("r"))


def label_steps(series: DataFrame, k: int, *by: str) -> DataFrame:
    """(i, labels, value), one series for each of `by`: where the labels change, the mean of the next k values over that of the k before."""
    w = Window.partitionBy(*by).orderBy("i")
    after, before = w.rowsBetween(0, k - 1), w.rowsBetween(-k, -1)
    marked = series.select(*by, "i", "labels", F.lag("labels").over(w).alias("was"), F.avg("value").over(after).alias("after"), F.avg("value").over(before).alias("before"))
    return marked.filter("labels <> was").select(*by, "i", "was", "labels", F.round(F.try_divide("after", "before"), 6).alias("step"))


def common_support(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the range of values that both groups (1 and the others) reach, and how many of each lie in it."""
    one = F.col(group) == 1
    ends = rows.agg(*[f(F.when(w, F.col(value))).alias(n) for n, f, w in (("a0", F.min, one), ("a1", F.max, one), ("b0", F.min, ~one), ("b1", F.max, ~one))])
    ends = ends.select(F.greatest("a0", "b0").alias("low"), F.least("a1", "b1").alias("high"))
    inside = F.col(value).between(F.col("low"), F.col("high"))
    # One row of two numbers: its size does not depend on the data.
    return rows.join(F.broadcast(ends)).groupBy("low", "high").agg(F.count_if(one & inside).alias("first_inside"), F.count_if(~one & inside).alias("others_inside"), F.count("*").alias("n"))


def ends_and_direction(series: DataFrame) -> DataFrame:
    """(name, period, value): last over first, growth a step and whether no value falls."""
    w = Window.partitionBy("name").orderBy("period")
    steps = series.filter("value is not null").withColumn("fell", F.coalesce(F.col("value") < F.lag("value").over(w), F.lit(False)))
    got = steps.groupBy("name").agg(F.count("*").alias("n"), F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"), (~F.bool_or("fell")).alias("rising"))
    ratio = F.try_divide("last", "first")
    growth = F.when((F.col("n") > 1) & (ratio > 0), F.pow(ratio, F.try_divide(F.lit(1.0), F.col("n") - 1)) - 1)
    return got.select("name", "n", F.round(ratio, 6).alias("ratio"), F.round(growth, 6).alias("growth"), "rising")


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The middle value of each group, the upper one of two: a rank, so that no group is gathered."""
    w = Window.partitionBy(group)
    ranked = rows.filter(F.col(value).isNotNull()).select(group, value, F.row_number().over(w.orderBy(value)).alias("k"), F.count("*").over(w).alias("n"))
    return ranked.filter("k = n div 2 + 1").select(group, F.col(value).alias("middle"), "n")


def rates(rows: DataFrame, group: str, done: str, least: int = 5) -> DataFrame:
    """Share of each group's rows that are done; groups under `least` rows have no rate."""
    got = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(done)).alias("done"))
    return got.withColumn("rate", F.when(F.col("n") >= least, F.round(F.col("done") / F.col("n"), 6)))


def corpus_metrics(evidence: DataFrame, least: int = 5) -> DataFrame:
    """One row over admitted records (admitted, family, lane, kind, linked, retracted, updates): what a corpus holds."""
    a = evidence.filter("admitted")
    registered = F.lower(F.coalesce("kind", F.lit("publication"))) == "registration"
    amended = (F.col("lane") == "CORRECTION_RETRACTION") | F.coalesce("retracted", F.lit(False)) | (F.coalesce("updates", F.lit("")) != "")
    raw = evidence.agg(F.count("*").alias("raw_records"))  # one row
    got = a.agg(F.count("*").alias("admitted_records"), F.countDistinct("family").alias("independent_families"), F.count_if(registered).alias("registrations"), F.count_if(~registered).alias("publications"), F.count_if(~registered & (F.coalesce("linked", F.lit("")) != "")).alias("linked_publications"), F.count_if(amended).alias("corrections"))
    return raw.join(got)


def publication_rates(evidence: DataFrame, least: int = 5) -> DataFrame:
    """(orientation, registrations, published, rate) of admitted registrations; under `least` of them there is no rate."""
    a = evidence.filter("admitted and lower(coalesce(kind, 'publication')) = 'registration'")
    return rates(a.withColumn("orientation", F.coalesce("orientation", F.lit("NOT_ASSESSABLE"))), "orientation", "published", least)


def selection_power(designs: DataFrame, replicates: int = 600, seed: int = 20260815) -> DataFrame:
    """Power of a two-proportion z test for (design, n, baseline, odds_ratio, exposed), by simulation.

    Each design has a stream of its own, from the seed and its number: results do not depend on
    how designs are dealt to tasks.
    """

    def run(batches):
        for pdf in batches:
            power = []
            for d in pdf.itertuples():
                rng = np.random.default_rng([seed, int(d.design)])
                n1 = max(1, round(d.n * d.exposed))
                n0 = max(1, int(d.n) - n1)
                odds = d.baseline / (1 - d.baseline) * d.odds_ratio
                x1, x0 = rng.binomial(n1, odds / (1 + odds), replicates), rng.binomial(n0, d.baseline, replicates)
                pooled = (x1 + x0) / (n1 + n0)
                spread = np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
                z = np.divide(x1 / n1 - x0 / n0, spread, out=np.zeros(replicates), where=spread > 0)
                power.append(float((np.abs(z) >= 1.959964).mean()))
            yield pd.DataFrame({"design": pdf["design"], "power": power})

    return designs.select("design", "n", "baseline", "odds_ratio", "exposed").mapInPandas(run, "design long, power double")
