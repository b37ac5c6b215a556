"""Registered queries over the driver's tables, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import graph, panel, stats, synthesis

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FIRST, LAST = "1995-04-01", "2001-03-01"


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def provider_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by ship month in whole units, so that sums are exact; cells of under three rows are suppressed but stay rows."""
    units = F.sum(F.round("l_extendedprice").cast("long")).cast("double")
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("provider"), F.trunc("l_shipdate", "month").alias("period")).agg(F.when(F.count("*") >= 3, units).alias("value"))


PANEL = """panel AS (SELECT l_suppkey AS provider, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
  CASE WHEN count(*) >= 3 THEN sum(CAST(round(l_extendedprice) AS BIGINT))::DOUBLE END AS value FROM lineitem GROUP BY 1, 2)"""
WINDOW = f"inside AS (SELECT * FROM panel WHERE period BETWEEN DATE '{FIRST}' AND DATE '{LAST}'), fixed AS (SELECT provider FROM inside GROUP BY 1 HAVING count(value) = 72)"
FY = "(year(period) - CASE WHEN month(period) < 4 THEN 1 ELSE 0 END)"
FY_LABEL = f"{FY}::VARCHAR || '/' || lpad((({FY} + 1) % 100)::VARCHAR, 2, '0')"


@query(f"""WITH {PANEL}, {WINDOW},
months AS (SELECT period, sum(value) FILTER (provider IN (SELECT provider FROM fixed)) AS cohort, coalesce(sum(value), 0) AS whole FROM inside GROUP BY 1),
years AS (SELECT {FY_LABEL} AS fy, avg(cohort) AS cohort, avg(whole) AS whole FROM months GROUP BY 1 HAVING count(*) = 12),
ends AS (SELECT *, arg_max(cohort, fy) OVER () / arg_min(cohort, fy) OVER () AS cr, arg_max(whole, fy) OVER () / arg_min(whole, fy) OVER () AS wr FROM years)
SELECT fy, round(cohort, 2) AS cohort_mean, round(whole, 2) AS whole_mean, round(cr, 6) AS cohort_ratio, round(wr, 6) AS whole_ratio, round(ln(cr) / ln(wr), 4) AS log_share FROM ends""")
def fixed_cohort_decomposition(spark, sf_dir):
    return panel.decompose(provider_panel(spark, sf_dir), FIRST, LAST)


@query(f"""WITH {PANEL}, {WINDOW} SELECT DISTINCT p.provider, f.first_period FROM panel p
JOIN (SELECT provider, min(period) AS first_period FROM panel WHERE value IS NOT NULL GROUP BY 1) f USING (provider)
WHERE p.period = DATE '{LAST}' AND p.value IS NOT NULL AND p.provider NOT IN (SELECT provider FROM fixed)""")
def cohort_joiners(spark, sf_dir):
    p = provider_panel(spark, sf_dir)
    return panel.joiners(p, FIRST, LAST).join(panel.first_period(p), "provider")


@query(f"""WITH {PANEL}, f AS (SELECT provider, min(period) AS period FROM panel WHERE value IS NOT NULL GROUP BY 1)
SELECT {FY_LABEL} AS fy, count(*) AS providers FROM f GROUP BY 1""")
def provider_first_period_by_fy(spark, sf_dir):
    return panel.first_period(provider_panel(spark, sf_dir)).groupBy(N.financial_year(F.col("first_period")).alias("fy")).agg(F.count("*").alias("providers"))


@query(f"WITH {PANEL} SELECT period, count(*) AS present, count(value) AS valued, round(1 - count(value)::DOUBLE / count(*), 6) AS suppressed_share FROM panel GROUP BY 1")
def panel_coverage_by_month(spark, sf_dir):
    return panel.coverage(provider_panel(spark, sf_dir))


@query("""WITH a AS (SELECT l_suppkey AS provider, date_trunc('month', l_shipdate) AS period, sum(CAST(round(l_quantity) AS BIGINT)) AS parent, sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_quantity) AS BIGINT) END) AS child FROM lineitem GROUP BY 1, 2),
s AS (SELECT provider, avg(child::DOUBLE / parent) AS share FROM a WHERE child IS NOT NULL AND parent > 0 GROUP BY 1 HAVING count(*) >= 6)
SELECT count(*) AS providers, round(median(share), 6) AS median_share FROM s""")
def family_share_median(spark, sf_dir):
    units = F.round("l_quantity").cast("long")
    base = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("provider"), F.trunc("l_shipdate", "month").alias("period")).agg(F.sum(units).alias("parent"), F.sum(F.when(F.col("l_returnflag") == "R", units)).alias("child"))
    return panel.share_median(base.select("provider", "period", F.col("child").alias("value")), base.select("provider", "period", F.col("parent").alias("value")), 6)


@query("""WITH c AS (SELECT c_nationkey AS band, count(*) AS population FROM customer GROUP BY 1),
o AS (SELECT c_mktsegment AS grp, c_nationkey AS band, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
w AS (SELECT band, population / sum(population) OVER () AS w FROM c)
SELECT grp, round(sum(w * n / population), 6) AS rate FROM o JOIN w USING (band) JOIN c USING (band) GROUP BY 1""")
def standardised_rate(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    people = c.groupBy(F.col("c_nationkey").alias("band")).agg(F.count("*").alias("population"))
    counts = t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("band")).agg(F.count("*").alias("n"))
    return panel.standardised(counts.join(people, "band"), people.select("band", F.col("population").alias("w")))


@query(f"""WITH {PANEL}, s AS (SELECT provider AS name, count(*) AS n, count(value) AS v, min(year(period) * 12 + month(period)) AS a, max(year(period) * 12 + month(period)) AS b FROM panel GROUP BY 1)
SELECT name, n AS n_points, (n >= 3 AND n = b - a + 1 AND v = n) AS ok, CASE WHEN n < 3 THEN 'TOO_FEW_POINTS' WHEN n <> b - a + 1 THEN 'MISSING_MONTHS' WHEN v < n THEN 'SUPPRESSED_CELLS' END AS reason FROM s""")
def series_guard(spark, sf_dir):
    return panel.guard(provider_panel(spark, sf_dir).withColumnRenamed("provider", "name"))


@query(f"""WITH {PANEL}, s AS (SELECT provider AS name, arg_min(value, period) AS first, arg_max(value, period) AS last, min(value) AS least, max(value) AS greatest, max(year(period) * 12 + month(period)) - min(year(period) * 12 + month(period)) AS months FROM panel WHERE value IS NOT NULL GROUP BY 1)
SELECT name, first, last, least, greatest, round(last / first, 6) AS ratio, round(CASE WHEN months > 0 THEN pow(last / first, 12.0::DOUBLE / months) - 1 END, 6) AS growth_per_year FROM s""")
def series_trend(spark, sf_dir):
    return panel.trend(provider_panel(spark, sf_dir).withColumnRenamed("provider", "name"))


MONTHLY = "m AS (SELECT (row_number() OVER (ORDER BY p) - 1)::BIGINT AS i, value FROM (SELECT date_trunc('month', o_orderdate) AS p, count(*)::DOUBLE AS value FROM orders GROUP BY 1))"


def monthly_orders(spark, sf_dir):
    m = t(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("p")).agg(F.count("*").cast("double").alias("value"))
    return m.select((F.row_number().over(Window.orderBy("p")) - 1).cast("long").alias("i"), "value")


@query(f"""WITH {MONTHLY} SELECT i, slope_break FROM (SELECT i, round(abs(regr_slope(value, i::DOUBLE) OVER a - regr_slope(value, i::DOUBLE) OVER b), 4) AS slope_break, count(*) OVER a AS na, count(*) OVER b AS nb FROM m
WINDOW a AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), b AS (ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE na = 12 AND nb = 12""")
def slope_break_by_month(spark, sf_dir):
    return panel.slope_breaks(monthly_orders(spark, sf_dir), 12)


DAILY = "d AS (SELECT (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)))::BIGINT AS i, count(*) FILTER (event_type = 'click')::DOUBLE AS x, count(*) FILTER (event_type = 'view')::DOUBLE AS y FROM events GROUP BY 1)"


def daily_events(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    one = lambda k: F.count_if(F.col("event_type") == k).cast("double")
    return e.groupBy(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("i")).agg(one("click").alias("x"), one("view").alias("y"))


@query(f"""WITH {DAILY}, j AS (SELECT l.lag, a.x, b.y FROM (SELECT unnest(range(-4, 5))::INT AS lag) l JOIN d a ON true JOIN d b ON b.i = a.i + l.lag)
SELECT lag, count(*) AS n, round(corr(x, y), 6) AS r FROM j GROUP BY 1""")
def lag_cross_correlation(spark, sf_dir):
    return stats.lagged(daily_events(spark, sf_dir), 4)


@query(f"""WITH {DAILY}, h AS (SELECT * FROM d WHERE i % 7 <> 3), s AS (SELECT i, i - lag(i) OVER (ORDER BY i) AS step, x - lag(x) OVER (ORDER BY i) AS dx, y - lag(y) OVER (ORDER BY i) AS dy FROM h) SELECT i, dx, dy FROM s WHERE step = 1""")
def runwise_first_difference(spark, sf_dir):
    d = daily_events(spark, sf_dir).filter("i % 7 <> 3")
    return stats.differences(d.select("i", F.col("x").alias("v")), d.select("i", F.col("y").alias("v")))


SUPPLIERS = "s AS (SELECT l_suppkey AS key, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE AS size, count(*)::DOUBLE AS n, avg(CAST(round(l_discount * 100) AS BIGINT)) AS disc FROM lineitem GROUP BY 1)"


def supplier_stats(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100).alias("size"), F.count("*").cast("double").alias("n"), F.avg(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"))


RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE)"


@query(f"""WITH {SUPPLIERS}, r AS (SELECT {RANK.format('size')} AS x, {RANK.format('disc')} AS y, {RANK.format('n')} AS z FROM s),
c AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r)
SELECT n, round(xy, 6) AS spearman, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c""")
def spearman_and_partial(spark, sf_dir):
    return stats.rank_correlations(supplier_stats(spark, sf_dir), "size", "disc", "n")


@query(f"""WITH {SUPPLIERS}, r AS (SELECT key % 2 AS g, {RANK.format('n')} AS r, count(*) OVER (PARTITION BY n) AS t FROM s),
a AS (SELECT sum(r) FILTER (g = 1) AS r1, count(*) FILTER (g = 1)::DOUBLE AS n1, count(*) FILTER (g <> 1)::DOUBLE AS n2, sum(t * t - 1)::DOUBLE AS ties FROM r)
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(r1 - n1 * (n1 + 1) / 2, 4) AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM a""")
def mann_whitney(spark, sf_dir):
    return stats.mann_whitney(supplier_stats(spark, sf_dir).withColumn("g", F.col("key") % 2), "g", "n")


@query(f"""WITH {SUPPLIERS}, r AS (SELECT key, size, row_number() OVER (ORDER BY size, key) - 1 AS i, count(*) OVER () // 3 AS third FROM s)
SELECT key, size, CASE WHEN third > 0 THEN least(2, i // third) ELSE 2 END::INT AS tertile FROM r""")
def size_tertiles(spark, sf_dir):
    return panel.tertiles(supplier_stats(spark, sf_dir).select("key", "size"))


GRID_A, GRID_B = 5, 9


@query(f"""WITH {MONTHLY}, g AS (SELECT a.v * {GRID_B} + b.v AS g, 100.0::DOUBLE * a.v AS a, 0.5::DOUBLE * (b.v - 4) AS b FROM (SELECT unnest(range({GRID_A})) AS v) a, (SELECT unnest(range({GRID_B})) AS v) b),
f AS (SELECT g, sqrt(avg(pow(value - (a + b * i), 2))) / (max(value) - min(value)) AS d FROM g, m GROUP BY 1)
SELECT g, round(d, 6) AS distance, d <= 0.15::DOUBLE AS accepted FROM f""")
def calibrate_mechanisms(spark, sf_dir):
    grid = spark.range(GRID_A * GRID_B).select(F.col("id").alias("g"), (100.0 * F.floor(F.col("id") / GRID_B)).alias("a"), (0.5 * (F.col("id") % GRID_B - 4)).alias("b"))
    return stats.calibrate(monthly_orders(spark, sf_dir), F.broadcast(grid), 0.15)


@query(f"""WITH {DAILY}, spine AS (SELECT unnest(range(0, 35))::BIGINT AS i) SELECT spine.i AS day, x::BIGINT AS monitored_clicks, round(CASE WHEN x + y > 0 THEN x / (x + y) * 1e6 ELSE NULL END, 4) AS per_million FROM spine LEFT JOIN d USING (i)""")
def media_intensity_spine(spark, sf_dir):
    spine = spark.range(35).select(F.col("id").alias("i"))
    whole = F.col("x") + F.col("y")
    return F.broadcast(spine).join(daily_events(spark, sf_dir), "i", "left").select(F.col("i").alias("day"), F.col("x").cast("long").alias("monitored_clicks"), F.round(F.when(whole > 0, N.per_million(F.col("x"), whole)), 4).alias("per_million"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'z' WHEN 1 THEN ' 1,234.5 ' WHEN 2 THEN 'low' WHEN 3 THEN 'abc' WHEN 4 THEN '' ELSE p_size::VARCHAR END AS raw FROM part),
v AS (SELECT p_partkey, trim(raw) AS x, lower(trim(raw)) IN ('z','c','x','k','u','low','~',':','-','') AS miss, TRY_CAST(replace(trim(raw), ',', '') AS DOUBLE) AS num FROM c)
SELECT p_partkey, CASE WHEN NOT miss THEN num END AS value, CASE WHEN miss THEN CASE WHEN x = '' THEN ':' ELSE x END WHEN num IS NULL THEN x END AS marker FROM v""")
def parse_cells(spark, sf_dir):
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, "z").when(k == 1, " 1,234.5 ").when(k == 2, "low").when(k == 3, "abc").when(k == 4, "").otherwise(F.col("p_size").cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", N.marked_cell(raw).alias("c")).select("p_partkey", "c.value", "c.marker")


@query("""SELECT DISTINCT year(o_orderdate) AS y, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, (year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END)::VARCHAR || '/' || lpad(((year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END + 1) % 100)::VARCHAR, 2, '0') AS fy,
(year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS ordinal, 'calendar_year' AS basis, 3 AS span FROM orders""")
def parse_periods(spark, sf_dir):
    d, y = F.col("o_orderdate"), F.year("o_orderdate")
    label = F.concat(y.cast("string"), F.lit(" - "), F.lpad(((y + 2) % 100).cast("string"), 2, "0"))
    return t(spark, sf_dir, "orders").select(y.alias("y"), F.to_date(F.trunc(d, "month")).alias("month"), N.financial_year(d).alias("fy"), N.month_ordinal(d).alias("ordinal"), N.period_basis(y.cast("string")).alias("basis"), N.span_years(label).alias("span")).distinct()


CUE = ["the paper was retracted", "we replicated and reproduced it", "a risk of bias and confounding", "no significant and no evidence", "a common cause and a rival model", "none of these", "critique"]
CUED = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CUE)) + " END"
LANE_HITS = ", ".join("(" + " + ".join(f"regexp_matches(x, '(?i){c}')::INT" for c in cues) + f") AS h{i}" for i, (_, cues) in enumerate(T.LANE_CUES))


def cued(spark, sf_dir):
    k, cue = F.col("doc_id") % 7, F.lit(None).cast("string")
    for i, c in enumerate(CUE):
        cue = F.when(k == i, c).otherwise(cue)
    return t(spark, sf_dir, "documents").select("doc_id", "source", F.concat_ws(" ", "text", cue).alias("x"))


LANES = f"""c AS (SELECT doc_id, source, text || ' ' || {CUED} AS x FROM documents), h AS (SELECT doc_id, source, {LANE_HITS} FROM c),
n AS (SELECT doc_id, source, CASE {' '.join(f"WHEN h{i} > 0 THEN '{lane}'" for i, (lane, _) in enumerate(T.LANE_CUES))} ELSE 'UNCLASSIFIED' END AS lane, CASE {' '.join(f'WHEN h{i} > 0 THEN h{i}' for i in range(len(T.LANE_CUES)))} ELSE 0 END::BIGINT AS hits FROM h),
l AS (SELECT doc_id, source, CASE WHEN hits > 0 THEN least(0.9::DOUBLE, 0.5::DOUBLE + 0.15::DOUBLE * hits) ELSE 0::DOUBLE END AS confidence, hits, lane FROM n)"""


@query(f"WITH {LANES} SELECT doc_id, CASE WHEN confidence >= 0.55 THEN lane ELSE 'UNCLASSIFIED' END AS lane, confidence, hits FROM l")
def lane_classification(spark, sf_dir):
    return cued(spark, sf_dir).select("doc_id", T.lane(F.col("x")).alias("l")).select("doc_id", "l.lane", "l.confidence", "l.hits")


@query(f"WITH {LANES} SELECT source, lane, count(*) AS n FROM l GROUP BY 1, 2")
def lane_coverage(spark, sf_dir):
    return cued(spark, sf_dir).groupBy("source", T.lane(F.col("x"))["lane"].alias("lane")).agg(F.count("*").alias("n"))


PHRASES = ["no evidence", "rival", "proves", "common cause"]


@query(f"""WITH c AS (SELECT doc_id, text || ' ' || {CUED} AS x FROM documents) SELECT doc_id, array_to_string(list_filter([{', '.join(f"'{p}'" for p in PHRASES)}], lambda p: regexp_matches(x, '(?i)\\b' || p)), '|') AS found FROM c""")
def wording_gate(spark, sf_dir):
    return cued(spark, sf_dir).select("doc_id", F.array_join(T.phrases_in(F.col("x"), PHRASES), "|").alias("found"))


@query("""WITH c AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*)::DOUBLE AS n, sum((a = b)::INT) / count(*)::DOUBLE AS po FROM c),
e AS (SELECT sum(ra * cb) / max(t.n * t.n) AS pe FROM (SELECT a, count(*)::DOUBLE AS ra FROM c GROUP BY 1) x JOIN (SELECT b, count(*)::DOUBLE AS cb FROM c GROUP BY 1) y ON x.a = y.b, t)
SELECT n::BIGINT AS n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM t, e""")
def cohens_kappa(spark, sf_dir):
    return stats.kappa(t(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH f AS (SELECT sha256(text) AS k, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS records, count(*) AS families, count(*) FILTER (n > 1) AS shared_families, max(n) AS largest, round(1 - count(*)::DOUBLE / sum(n), 6) AS inflation FROM f""")
def dependency_summary(spark, sf_dir):
    return synthesis.dependency_summary(t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("k")), "k")


@query("""WITH d AS (SELECT count(*) AS size FROM documents GROUP BY text) SELECT size, count(*) AS families FROM d GROUP BY 1""")
def family_sizes(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("families"))


@query("""WITH e AS (SELECT c_custkey AS node, 'body ' || (c_custkey % 50) AS name FROM customer) SELECT name, count(*) AS size, min(node) AS root, count(*) = 1 AS is_unique FROM e GROUP BY 1""")
def exact_unique_lookup(spark, sf_dir):
    name = T.normalise_name(F.concat(F.lit("The Body, "), (F.col("c_custkey") % 50).cast("string"), F.lit(" Ltd.")))
    return t(spark, sf_dir, "customer").groupBy(name.alias("name")).agg(F.count("*").alias("size"), F.min("c_custkey").alias("root"), (F.count("*") == 1).alias("is_unique"))


RELATIONS = """r AS (SELECT DISTINCT 'C' || o_custkey AS a, 'S' || l_suppkey AS b, o_orderpriority AS kind, o_orderstatus AS family, o_orderkey * 10 + l_linenumber AS ordinal FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_quantity >= 49 AND l_discount < 0.02 AND o_orderdate < DATE '2000-01-01')"""


RELATIONS_WHOLE = """WITH r AS (SELECT DISTINCT 'C' || o_custkey AS a, 'S' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '2000-01-01')"""


def relations(spark, sf_dir, kept="l_quantity >= 49 AND l_discount < 0.02", *more):
    e = t(spark, sf_dir, "lineitem").filter(kept).join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return e.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("b"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("family"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.to_date("o_orderdate").alias("valid_from"), *more)


def domains(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    c = t(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node"), F.col("n_regionkey").cast("string").alias("domain"))
    s = t(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"), F.col("n_regionkey").cast("string").alias("domain"))
    return c.union(s)


@query(f"WITH {RELATIONS} SELECT a AS person, count(DISTINCT b) AS bodies FROM r GROUP BY 1 HAVING count(DISTINCT b) >= 2")
def bridges(spark, sf_dir):
    r = relations(spark, sf_dir).filter("valid_from < '2000-01-01'")
    return graph.bridges(r.select(F.col("a").alias("person"), F.col("b").alias("body")))


@query(RELATIONS_WHOLE + " SELECT a AS person, count(DISTINCT b) AS bodies FROM r GROUP BY 1 HAVING count(DISTINCT b) >= 2")
def bridges_whole(spark, sf_dir):
    r = relations(spark, sf_dir, "true").filter("valid_from < '2000-01-01'")
    return graph.bridges(r.select(F.col("a").alias("person"), F.col("b").alias("body")))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_last_wins(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return synthesis.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "event_id")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1""")
def dedup_first_wins(spark, sf_dir):
    return synthesis.first_wins(t(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("""SELECT n_name AS path, CASE WHEN n_nationkey % 5 > 0 THEN n_regionkey::VARCHAR END AS old, CASE WHEN n_nationkey % 7 > 0 THEN (n_regionkey + (n_nationkey % 3 = 0)::INT)::VARCHAR END AS new,
CASE WHEN n_nationkey % 5 = 0 THEN 'ADDED' WHEN n_nationkey % 7 = 0 THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM nation WHERE (n_nationkey % 5 > 0 OR n_nationkey % 7 > 0) AND (n_nationkey % 5 = 0 OR n_nationkey % 7 = 0 OR n_nationkey % 3 = 0)""")
def spec_drift(spark, sf_dir):
    n, k = t(spark, sf_dir, "nation"), F.col("n_nationkey")
    return synthesis.drift(n.filter(k % 5 > 0).select(F.col("n_name").alias("path"), F.col("n_regionkey").cast("string").alias("value")), n.filter(k % 7 > 0).select(F.col("n_name").alias("path"), (F.col("n_regionkey") + (k % 3 == 0).cast("int")).cast("string").alias("value")))


@query("""SELECT p_partkey, ceil(1.96::DOUBLE * 1.96::DOUBLE * (p_size / 100.0::DOUBLE) * (1 - p_size / 100.0::DOUBLE) / (0.05::DOUBLE * 0.05::DOUBLE))::BIGINT AS n_proportion, ceil(2 * pow(1.96::DOUBLE + 0.84::DOUBLE, 2) / pow(p_size / 20.0::DOUBLE, 2))::BIGINT AS n_per_arm, round(1 + (p_size - 1) * 0.05::DOUBLE, 6) AS design_effect,
CASE WHEN p_size >= 10 THEN round((exp(2 * 2.801585::DOUBLE / sqrt(p_size - 3)) - 1) / (exp(2 * 2.801585::DOUBLE / sqrt(p_size - 3)) + 1), 6) END AS detectable_r, round(p_size / 10.0::DOUBLE + 0, 6) AS ratio FROM part""")
def attainable_envelope(spark, sf_dir):
    s = F.col("p_size")
    return t(spark, sf_dir, "part").select("p_partkey", N.sample_for_proportion(s / 100, F.lit(0.05)).alias("n_proportion"), N.sample_per_arm(s / 20).alias("n_per_arm"), F.round(N.design_effect(s, F.lit(0.05)), 6).alias("design_effect"), F.round(N.detectable_correlation(s), 6).alias("detectable_r"), F.round(s / 10, 6).alias("ratio"))


@query("""SELECT p_partkey, round(u + sqrt(u * (u - 1)), 6) AS e_value FROM (SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size / 10.0::DOUBLE ELSE 10.0::DOUBLE / p_size END AS u FROM part)""")
def e_value(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.round(N.e_value(F.col("p_size") / 10), 6).alias("e_value"))


@query(None)
def permutation_p(spark, sf_dir):
    return stats.permutation_p(supplier_stats(spark, sf_dir), "size", "disc", 20000, 20260816)
