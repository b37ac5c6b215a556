"""More registered queries: links between registers and several series side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkage, series
from .registry import DAILY, PANEL, SUPPLIERS, daily_events, provider_panel, query, supplier_stats, t

MONTH = "CAST(date_trunc('month', {}) AS DATE)"


@query(f"""WITH c AS (SELECT l_suppkey AS provider, {MONTH.format('l_shipdate')} AS period, sum(CAST(round(l_quantity) AS BIGINT)) AS whole, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(round(l_quantity) AS BIGINT) END) AS urgent FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT provider, count(*) AS months, round(sum(urgent)::DOUBLE / sum(whole), 6) AS intensity FROM c WHERE urgent IS NOT NULL AND whole > 0 GROUP BY 1 HAVING count(*) >= 12""")
def intensity_index(spark, sf_dir):
    units = F.round("l_quantity").cast("long")
    both = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = both.groupBy(F.col("l_suppkey").alias("provider"), F.trunc("l_shipdate", "month").alias("period")).agg(F.sum(units).alias("whole"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", units)).alias("urgent"))
    return series.intensity(sums.withColumnRenamed("urgent", "value"), sums.withColumnRenamed("whole", "value"))


@query(f"""WITH m AS (SELECT {MONTH.format('o_orderdate')} AS period, count(*) FILTER (o_orderstatus = 'F') AS x, count(*) FILTER (o_orderstatus = 'O') AS y FROM orders GROUP BY 1),
s AS (SELECT period, round(x::DOUBLE / y, 6) AS ratio, count(*) OVER () AS n FROM m WHERE x > 0 AND y > 0) SELECT period, ratio FROM s WHERE n >= 3""")
def sex_ratio_analogue(spark, sf_dir):
    one = lambda s: t(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).groupBy(F.trunc("o_orderdate", "month").alias("period")).agg(F.count("*").alias("value"))
    return series.strata_ratio(one("F"), one("O"))


@query(f"""WITH m AS (SELECT o_orderpriority AS name, {MONTH.format('o_orderdate')} AS period, count(*) AS value FROM orders GROUP BY 1, 2),
f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY period) AS n FROM m) WHERE n = 5),
d AS (SELECT * FROM (SELECT name, period, ln(value) - ln(lag(value) OVER (PARTITION BY name ORDER BY period)) AS d FROM f) WHERE d IS NOT NULL)
SELECT x.name AS a, y.name AS b, count(*) AS n, round(corr(x.d, y.d), 6) AS r FROM d x JOIN d y ON x.period = y.period AND x.name < y.name GROUP BY 1, 2""")
def pairwise_log_change_correlation(spark, sf_dir):
    m = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.trunc("o_orderdate", "month").alias("period")).agg(F.count("*").alias("value"))
    return series.log_change_correlations(m, 5)


@query(f"""WITH m AS (SELECT {MONTH.format('l_shipdate')} AS p, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS labels, count(*) AS value FROM lineitem WHERE l_quantity >= 45 AND l_suppkey <= 5 GROUP BY 1),
n AS (SELECT (row_number() OVER (ORDER BY p) - 1)::BIGINT AS i, labels, value FROM m),
s AS (SELECT i, lag(labels) OVER (ORDER BY i) AS was, labels, round(avg(value) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) / avg(value) OVER (ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) AS step FROM n)
SELECT i, was, labels, step FROM s WHERE labels <> was""")
def label_change_step(spark, sf_dir):
    from pyspark.sql import Window

    rows = t(spark, sf_dir, "lineitem").filter("l_quantity >= 45 AND l_suppkey <= 5")
    m = rows.groupBy(F.trunc("l_shipdate", "month").alias("p")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("labels"), F.count("*").alias("value"))
    return series.label_steps(m.select((F.row_number().over(Window.orderBy("p")) - 1).cast("long").alias("i"), "labels", "value"), 6)


@query(f"""WITH m AS (SELECT l_suppkey AS provider, {MONTH.format('l_shipdate')} AS p, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS labels, count(*) AS value FROM lineitem GROUP BY 1, 2),
n AS (SELECT provider, (row_number() OVER (PARTITION BY provider ORDER BY p) - 1)::BIGINT AS i, labels, value FROM m),
s AS (SELECT provider, i, lag(labels) OVER w AS was, labels, round(avg(value) OVER (PARTITION BY provider ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) / avg(value) OVER (PARTITION BY provider ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) AS step FROM n WINDOW w AS (PARTITION BY provider ORDER BY i))
SELECT provider, i, was, labels, step FROM s WHERE labels <> was""")
def label_change_step_by_provider(spark, sf_dir):
    """The same over the whole table, a series for each supplier."""
    from pyspark.sql import Window

    m = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("provider"), F.trunc("l_shipdate", "month").alias("p")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("labels"), F.count("*").alias("value"))
    place = F.row_number().over(Window.partitionBy("provider").orderBy("p")) - 1
    return series.label_steps(m.select("provider", place.cast("long").alias("i"), "labels", "value"), 6, "provider")


@query(f"""WITH {SUPPLIERS}, e AS (SELECT greatest(min(size) FILTER (key % 2 = 1), min(size) FILTER (key % 2 <> 1)) AS low, least(max(size) FILTER (key % 2 = 1), max(size) FILTER (key % 2 <> 1)) AS high FROM s)
SELECT low, high, count(*) FILTER (key % 2 = 1 AND size BETWEEN low AND high) AS first_inside, count(*) FILTER (key % 2 <> 1 AND size BETWEEN low AND high) AS others_inside, count(*) AS n FROM s, e GROUP BY 1, 2""")
def common_support(spark, sf_dir):
    return series.common_support(supplier_stats(spark, sf_dir).withColumn("g", F.col("key") % 2), "g", "size")


@query(f"""WITH {PANEL}, p AS (SELECT provider AS name, period, value, coalesce(value < lag(value) OVER (PARTITION BY provider ORDER BY period), false) AS fell FROM panel WHERE value IS NOT NULL),
g AS (SELECT name, count(*) AS n, arg_max(value, period) / arg_min(value, period) AS ratio, NOT bool_or(fell) AS rising FROM p GROUP BY 1)
SELECT name, n, round(ratio, 6) AS ratio, round(CASE WHEN n > 1 THEN pow(ratio, 1.0::DOUBLE / (n - 1)) - 1 END, 6) AS growth, rising FROM g""")
def referral_ends(spark, sf_dir):
    return series.ends_and_direction(provider_panel(spark, sf_dir).withColumnRenamed("provider", "name"))


@query("""WITH c AS (SELECT o_orderpriority AS lane, o_custkey, count(*) AS found FROM orders GROUP BY 1, 2), r AS (SELECT lane, found, row_number() OVER (PARTITION BY lane ORDER BY found) AS k, count(*) OVER (PARTITION BY lane) AS n FROM c)
SELECT lane, found AS middle, n FROM r WHERE k = n // 2 + 1""")
def harvest_upper_median(spark, sf_dir):
    found = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("lane"), "o_custkey").agg(F.count("*").alias("found"))
    return series.upper_median(found, "lane", "found")


LINKS = """pubs AS (SELECT doc_id AS pub_id, DATE '2015-01-01' + (doc_id % 1500)::INT AS published_on, 'NCT' || lpad((doc_id % 400)::VARCHAR, 8, '0') AS reg_id FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL),
regs AS (SELECT 'NCT' || lpad(c_custkey::VARCHAR, 8, '0') AS reg_id, DATE '2014-01-01' + (c_custkey * 7 % 2000)::INT AS registered_on FROM customer),
links AS (SELECT r.reg_id, count(DISTINCT pub_id) AS publications, min(published_on) AS first_published, date_diff('day', any_value(registered_on), min(published_on))::INT AS days,
  CASE WHEN any_value(registered_on) > DATE '2018-06-30' THEN 'TOO_RECENT' WHEN count(DISTINCT pub_id) > 0 THEN 'PUBLISHED' ELSE 'UNPUBLISHED' END AS status FROM regs r LEFT JOIN pubs p ON p.reg_id = r.reg_id AND published_on >= registered_on GROUP BY 1)"""


@query(f"WITH {LINKS} SELECT * FROM links")
def registration_linkage(spark, sf_dir):
    """Registrations are customers; every third document is given the id of one in its text."""
    doc, cust = F.col("doc_id"), F.col("c_custkey")
    number = lambda k: F.concat(F.lit("NCT"), F.lpad(k.cast("string"), 8, "0"))
    text = F.when(doc % 3 == 0, F.concat_ws(" ", F.lit("See nct00000000x and"), number(doc % 400), "text")).otherwise(F.col("text"))
    pubs = t(spark, sf_dir, "documents").filter("text is not null").select(doc.alias("pub_id"), F.date_add(F.lit("2015-01-01").cast("date"), (doc % 1500).cast("int")).alias("published_on"), text.alias("text"))
    regs = t(spark, sf_dir, "customer").select(number(cust).alias("reg_id"), F.date_add(F.lit("2014-01-01").cast("date"), (cust * 7 % 2000).cast("int")).alias("registered_on"))
    return linkage.link_registrations(regs, pubs, "2018-06-30")


@query(f"""WITH {LINKS} SELECT count(*) FILTER (status <> 'TOO_RECENT') AS denominator, count(*) FILTER (status = 'PUBLISHED') AS published, count(*) FILTER (status = 'TOO_RECENT') AS too_recent, median(days) FILTER (status = 'PUBLISHED') AS median_days,
round(count(*) FILTER (status = 'PUBLISHED')::DOUBLE / count(*) FILTER (status <> 'TOO_RECENT'), 6) AS rate FROM links""")
def registration_linkage_summary(spark, sf_dir):
    return linkage.linkage_summary(registration_linkage(spark, sf_dir))


@query("""WITH n AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'retraction' ELSE 'erratum' END AS type FROM labels WHERE quality = 0 OR toxic = 1)
SELECT d.doc_id AS work_id, n.type AS notice, CASE WHEN n.type IS NULL THEN 'CURRENT' WHEN n.type = 'retraction' THEN 'INVALIDATED' ELSE 'AMENDED' END AS status FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""")
def retraction_screen(spark, sf_dir):
    """Labels are notices: an erratum for the first half of a pair, then the one that counts."""
    doc = F.col("doc_id").cast("string")
    works = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"), F.concat(F.lit("https://doi.org/10.1000/D"), doc).alias("doi"))
    told = t(spark, sf_dir, "labels").filter("quality = 0 or toxic = 1")
    kinds = F.array(F.struct(F.lit("Erratum").alias("type"), F.lit(1).alias("ordinal")), F.struct(F.when(F.col("toxic") == 1, "Retraction").otherwise("Erratum").alias("type"), F.lit(2).alias("ordinal")))
    return linkage.screen_retractions(works, told.select(F.concat(F.lit("10.1000/d"), doc).alias("doi"), F.explode(kinds).alias("n")).select("doi", "n.*"))


@query("""WITH k AS (SELECT c_custkey % 140 AS k, count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS blank FROM customer GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, count(*) FILTER (n > 1) AS repeated_keys, sum(blank)::BIGINT AS blank_families, sum(n) = 150 AND count(*) FILTER (n > 1) = 0 AND sum(blank) = 0 AS complete FROM k""")
def registry_summary(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select((F.col("c_custkey") % 140).alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("family"))
    return linkage.registry_summary(rows, "id", "family", 150)


@query(f"WITH {DAILY} SELECT i, round(x / y, 6) AS share FROM d WHERE y > 0")
def daily_click_share(spark, sf_dir):
    return daily_events(spark, sf_dir).filter("y > 0").select("i", F.round(F.col("x") / F.col("y"), 6).alias("share"))


@query(None)
def selection_power(spark, sf_dir):
    k = F.col("p_partkey")
    designs = t(spark, sf_dir, "part").select(k.cast("long").alias("design"), (20 + F.col("p_size") * 10).alias("n"), (0.2 + (k % 5) * 0.1).alias("baseline"), (1.0 + (k % 4)).alias("odds_ratio"), F.lit(0.5).alias("exposed"))
    return series.selection_power(designs)
