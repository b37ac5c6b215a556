"""Links between registers: registrations and publications, notices and works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_doi, trial_ids


def link_registrations(registrations: DataFrame, publications: DataFrame, cutoff: str) -> DataFrame:
    """(reg_id, registered_on) to publications (pub_id, published_on, text) that name it.

    Ids are read out of the texts and joined by equality, so no text meets every registration.
    A registration after the cutoff has not been followed up for long enough: its status says
    so and it is in no rate. Publications before the registration do not count.
    """
    named = publications.select("pub_id", "published_on", F.explode(trial_ids(F.col("text"))).alias("reg_id"))
    met = registrations.join(named, "reg_id", "left").withColumn("counts", F.col("published_on") >= F.col("registered_on"))
    got = met.groupBy("reg_id", "registered_on").agg(F.countDistinct(F.when(F.col("counts"), F.col("pub_id"))).alias("publications"), F.min(F.when(F.col("counts"), F.col("published_on"))).alias("first_published"))
    early = F.col("registered_on") <= F.to_date(F.lit(cutoff))
    status = F.when(~early, "TOO_RECENT").when(F.col("publications") > 0, "PUBLISHED").otherwise("UNPUBLISHED")
    return got.select("reg_id", "publications", "first_published", F.date_diff("first_published", "registered_on").alias("days"), status.alias("status"))


def linkage_summary(links: DataFrame) -> DataFrame:
    """One row: registrations that could have been published, the share that was, and the median delay."""
    due = F.col("status") != "TOO_RECENT"
    published = F.col("status") == "PUBLISHED"
    got = links.agg(F.count_if(due).alias("denominator"), F.count_if(published).alias("published"), F.count_if(~due).alias("too_recent"), F.median(F.when(published, F.col("days"))).alias("median_days"))
    return got.withColumn("rate", F.round(F.try_divide("published", "denominator"), 6))


def screen_retractions(works: DataFrame, notices: DataFrame) -> DataFrame:
    """works (work_id, doi) with the status that the last notice (doi, type, ordinal) of their DOI gives them.

    Both sides are joined on the normalised DOI; a work without a notice stays, as CURRENT.
    """
    last = notices.groupBy(normalise_doi(F.col("doi")).alias("key")).agg(F.max_by(F.lower("type"), "ordinal").alias("type"))
    status = F.when(F.col("type").isNull(), "CURRENT").when(F.col("type").isin("retraction", "withdrawal", "removal"), "INVALIDATED").otherwise("AMENDED")
    return works.withColumn("key", normalise_doi(F.col("doi"))).join(last, "key", "left").select("work_id", F.col("type").alias("notice"), status.alias("status"))


def registry_summary(rows: DataFrame, key: str, family: str, expected: int) -> DataFrame:
    """One row: rows against those expected, repeated keys, blank families and distinct families."""
    per_key = rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim(F.col(family)), F.lit("")) == "").alias("blank"))
    counts = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_families"))
    return counts.withColumn("complete", (F.col("n_rows") == expected) & (F.col("repeated_keys") == 0) & (F.col("blank_families") == 0))
