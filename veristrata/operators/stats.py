"""Rank statistics, agreement, calibration. Refusals are nulls, never exceptions inside a job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged


def ranked(rows: DataFrame, value: str, into: str, ties: str | None = None) -> DataFrame:
    """rows with the rank of a value, ties sharing their mean, and with `ties` how many have it; null has none.

    The distinct values are dealt to tasks by range; a rank is its place there after all that the
    tasks before hold, so no task sees all rows. Only a row for each task is summed in one place.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value_")).agg(F.count("*").alias("n_"))
    dealt = staged(counts.repartitionByRange("value_").withColumn("part_", F.spark_partition_id()))
    whole = dealt.groupBy("part_").agg(F.sum("n_").alias("all_"))
    before = whole.select("part_", (F.sum("all_").over(Window.orderBy("part_")) - F.col("all_")).alias("before_"))
    upto = F.sum("n_").over(Window.partitionBy("part_").orderBy("value_"))
    placed = dealt.withColumn("upto_", upto).join(F.broadcast(before), "part_")  # a row for each task
    found = placed.select("value_", (F.col("before_") + F.col("upto_") - (F.col("n_") - 1) / 2).alias(into), *([F.col("n_").alias(ties)] if ties else []))
    return rows.join(found, F.col(value) == F.col("value_"), "left").drop("value_")


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null for under three pairs or a constant column."""
    n = F.count(F.col(x) * F.col(y))
    sx, sy, sxy, sxx, syy = (F.sum(e) for e in (F.col(x), F.col(y), F.col(x) * F.col(y), F.col(x) * F.col(x), F.col(y) * F.col(y)))
    return F.when(n >= 3, F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest((n * sxx - sx * sx) * (n * syy - sy * sy), F.lit(0.0)))))


def rank_correlations(rows: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Spearman of x and y, and the partial one given z."""
    r = rows.select(x, y, z)
    for c in (x, y, z):
        r = ranked(r, c, "rank_").drop(c).withColumnRenamed("rank_", c)
    got = r.agg(F.count("*").alias("n"), pearson(x, y).alias("xy"), pearson(x, z).alias("xz"), pearson(y, z).alias("yz"))
    below = F.sqrt(F.greatest((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2), F.lit(0.0)))
    return got.select("n", F.round("xy", 6).alias("spearman"), F.round(F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), below), 6).alias("partial"))


def mann_whitney(rows: DataFrame, group: str, value: str) -> DataFrame:
    """U of the first group (group = 1) and z with tie correction, without continuity correction."""
    s = ranked(rows.select(F.col(group).alias("g"), F.col(value).alias("v")), "v", "r", "t").agg(F.sum(F.when(F.col("g") == 1, F.col("r"))).alias("r1"), F.sum((F.col("g") == 1).cast("double")).alias("n1"), F.sum((F.col("g") != 1).cast("double")).alias("n2"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    variance = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    return s.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), F.round(u, 4).alias("u"), F.when(variance > 0, F.round((u - F.col("n1") * F.col("n2") / 2) / F.sqrt(variance), 6)).alias("z"))


def lagged(series: DataFrame, most: int) -> DataFrame:
    """(i, x, y): correlation of x with y moved by each lag."""
    lags = series.sparkSession.range(-most, most + 1).select(F.col("id").cast("int").alias("lag"))
    moved = series.select(F.col("i").alias("j"), "y").join(F.broadcast(lags)).withColumn("i", F.col("j") - F.col("lag"))
    return series.select("i", "x").join(moved, "i").groupBy("lag").agg(F.count("*").alias("n"), F.round(pearson("x", "y"), 6).alias("r"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, v) twice: first differences of both within runs without a gap."""
    both = a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), "i")
    w = Window.orderBy("i")
    return both.select("i", (F.col("i") - F.lag("i").over(w)).alias("step"), (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy")).filter("step = 1").drop("step")


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two coders and Cohen's kappa."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    sums = cells.select("a", "b", "n", total.alias("t"), F.sum("n").over(Window.partitionBy("a")).alias("ra"))
    right = cells.groupBy("b").agg(F.sum("n").alias("cb")).withColumnRenamed("b", "k")
    left = sums.groupBy("a", "ra", "t").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    got = left.join(right, F.col("a") == F.col("k"), "left").agg(F.first("t").alias("n"), (F.sum("same") / F.first("t")).alias("po"), (F.sum(F.col("ra") * F.coalesce("cb", F.lit(0))) / (F.first("t") * F.first("t"))).alias("pe"))
    return got.select("n", F.round("po", 6).alias("observed"), F.round("pe", 6).alias("expected"), F.round(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), 6).alias("kappa"))


def calibrate(series: DataFrame, grid: DataFrame, tolerance: float) -> DataFrame:
    """Linear mechanisms (g, a, b) against (i, value): distance = RMSE over range; the best of the grid first."""
    got = grid.join(series).groupBy("g", "a", "b").agg(F.sqrt(F.avg(F.pow(F.col("value") - (F.col("a") + F.col("b") * F.col("i")), F.lit(2.0)))).alias("rmse"), (F.max("value") - F.min("value")).alias("spread"), F.abs(F.avg("value")).alias("level"))
    scale = F.when(F.col("spread") > 0, F.col("spread")).when(F.col("level") > 0, F.col("level")).otherwise(1.0)
    return got.select("g", F.round(F.col("rmse") / scale, 6).alias("distance"), (F.col("rmse") / scale <= tolerance).alias("accepted"))


def permutation_p(rows: DataFrame, x: str, y: str, draws: int, seed: int, at_once: int = 500) -> DataFrame:
    """(hits + 1) / (draws + 1) of Spearman's |r| under shuffled pairing; null pairs are left out.

    The draws are spread over tasks, `at_once` of them from one seed each, so p does not depend
    on the tasks. Each task gets both rank columns.
    """
    spark = rows.sparkSession
    both = ranked(ranked(rows.select(F.col(x).alias("a"), F.col(y).alias("b")).dropna(), "a", "x"), "b", "y")
    got = both.select("x", "y").orderBy("x", "y").toArrow()
    a, b = (got[c].to_numpy().astype(float) for c in ("x", "y"))
    n = len(a)
    a, b = a - (n + 1) / 2, b - (n + 1) / 2
    norm = np.sqrt((a @ a) * (b @ b))
    if n < 3 or norm == 0:
        return spark.createDataFrame([(n, float("nan"), float("nan"))], "n long, r double, p double").limit(min(n, 1))
    seen = abs(a @ b) - 1e-12 * norm
    shared = spark.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = shared.value
        for pdf in batches:
            hits = 0
            for k in pdf["id"].tolist():
                rng = np.random.default_rng([seed, k])
                hits += sum(abs(left @ rng.permutation(right)) >= seen for _ in range(min(at_once, draws - k * at_once)))
            yield pd.DataFrame({"hits": [int(hits)]})

    parts = -(-draws // at_once)
    hits = spark.range(0, parts, 1, parts).mapInPandas(run, "hits long").agg(F.sum("hits").alias("hits"))
    return hits.select(F.lit(n).cast("long").alias("n"), F.lit(float(a @ b / norm)).alias("r"), ((F.col("hits") + 1) / F.lit(draws + 1)).alias("p"))
