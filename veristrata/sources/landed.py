"""Landed files as typed rows: works, registrations, notices, awards, indicator tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_doi

NOTICE = "DOI string, title array<string>, `update-to` array<struct<DOI: string, type: string>>"
AWARD = "ocid string, date string, buyer struct<name: string, id: string>, awards array<struct<id: string, date: string, value: struct<amount: double, currency: string>, contractPeriod: struct<startDate: string, endDate: string>, suppliers: array<struct<name: string, id: string>>>>"
INDICATOR_KEY = ["Indicator ID", "Parent Code", "Area Code", "Sex", "Age", "Category", "Time period", "Value"]
INVALIDATING = ["retraction", "withdrawal", "removal"]


def notices(spark: SparkSession, path: str) -> DataFrame:
    """One row per work that a notice updates; a notice of itself is left out."""
    rows = spark.read.schema(NOTICE).json(path).withColumn("u", F.explode("update-to"))
    return rows.select(normalise_doi(F.col("u.DOI")).alias("doi"), normalise_doi(F.col("DOI")).alias("notice_doi"), F.lower("u.type").alias("type"), F.lower("u.type").isin(INVALIDATING).alias("invalidates")).filter("doi <> notice_doi")


def awards(spark: SparkSession, path: str) -> DataFrame:
    """Buyer, award and supplier edges; the start is the contract's, else the award's; an end before the start is missing; undated rows carry a reason."""
    rows = spark.read.schema(AWARD).json(path).withColumn("a", F.explode("awards")).withColumn("s", F.explode("a.suppliers"))
    day = lambda c: F.to_date(F.substring(c, 1, 10))
    start, end = F.coalesce(day("a.contractPeriod.startDate"), day("a.date")), day("a.contractPeriod.endDate")
    return rows.select("ocid", F.col("buyer.id").alias("buyer"), F.col("s.id").alias("supplier"), F.col("a.value.amount").alias("amount"), start.alias("valid_from"), F.when(end >= start, end).alias("valid_to"), F.when(start.isNull(), "UNDATED").alias("skipped"))


def indicators(spark: SparkSession, path: str) -> DataFrame:
    """A published indicator table without its repeated rows."""
    return spark.read.option("header", True).csv(path).dropDuplicates(INDICATOR_KEY)
