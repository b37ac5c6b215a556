"""Registered queries of the look-ups and of counterevidence searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolvers
from .registry import query, t

c = F.col

REGISTER = """ent AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'body ' || (c_custkey % 60) END AS key, c_custkey % 5 = 0 AS strong FROM customer),
reg AS (SELECT 'body ' || (s_suppkey % 70) AS key, 'N' || s_suppkey AS number, ['active', 'Open', 'dissolved', 'dissolved'][s_suppkey % 4 + 1] AS status FROM supplier),
n AS (SELECT key, count(DISTINCT number) FILTER (lower(status) IN ('active', 'open')) AS n, min(number) FILTER (lower(status) IN ('active', 'open')) AS number FROM reg GROUP BY 1),
a AS (SELECT node, CASE WHEN strong THEN 'ALREADY_HAS_STRONG_IDENTIFIER' WHEN ent.key = '' THEN 'EMPTY_NAME' WHEN n = 1 THEN 'EXACT_UNIQUE_ACTIVE_MATCH' WHEN n > 1 THEN 'AMBIGUOUS_' || n || '_ACTIVE_MATCHES' WHEN n = 0 THEN 'ONLY_DISSOLVED_NAME_MATCH' ELSE 'NO_EXACT_NAME_MATCH' END AS reason, number FROM ent LEFT JOIN n USING (key))"""


def attempts(spark, sf_dir):
    """Customers as bodies, suppliers as entries of a register of companies."""
    k, s = c("c_custkey"), c("s_suppkey")
    name = F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("The Body "), (k % 60).cast("string"), F.lit(" Limited")))
    ids = F.when(k % 5 == 0, F.create_map(F.lit("lei"), F.lit("L"))).otherwise(F.create_map(F.lit("website"), F.lit("w")))
    entities = t(spark, sf_dir, "customer").select(k.alias("node"), name.alias("name"), ids.alias("identifiers"))
    status = F.get(F.array(*[F.lit(x) for x in ("active", "Open", "dissolved", "dissolved")]), (s % 4).cast("int"))
    register = t(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), s.cast("string")).alias("number"), F.concat(F.lit("BODY, "), (s % 70).cast("string"), F.lit(" Ltd.")).alias("title"), status.alias("status"))
    return resolvers.resolve_names(entities, register, "companies")


@query(f"WITH {REGISTER} SELECT node, reason, CASE WHEN reason LIKE 'EXACT%' THEN number END AS resolved FROM a")
def register_lookup(spark, sf_dir):
    return attempts(spark, sf_dir).select("node", "reason", "resolved")


@query(f"WITH {REGISTER} SELECT reason, count(*) AS n FROM a WHERE reason NOT LIKE 'EXACT%' GROUP BY 1")
def resolution_reasons(spark, sf_dir):
    return resolvers.resolution_reasons(attempts(spark, sf_dir))


@query(f"WITH {REGISTER} SELECT node, CASE WHEN reason LIKE 'EXACT%' THEN number END AS companies_house FROM a")
def identified_bodies(spark, sf_dir):
    return resolvers.identified(attempts(spark, sf_dir), "companies").select("node", c("identifiers")["companies_house"].alias("companies_house"))


LONG = "an abstract that is long enough to be taken"


@query(f"""WITH e AS (SELECT doc_id, doc_id % 6 AS k FROM documents WHERE doc_id % 6 < 5), a AS (SELECT *, CASE WHEN k = 0 THEN 'doi' WHEN k = 1 THEN 'pmid' WHEN k IN (2, 3) THEN 'title' END AS lookup_kind FROM e)
SELECT doc_id AS evidence_id, CASE WHEN k = 1 THEN 'OpenAlex' ELSE 'EuropePMC' END AS source, lookup_kind, CASE k WHEN 0 THEN '10.1/' || doc_id WHEN 1 THEN doc_id::VARCHAR ELSE 'title ' || doc_id END AS lookup_value,
CASE WHEN k = 3 THEN NULL WHEN k = 2 THEN 'title ' || doc_id || chr(10) || chr(10) || '{LONG}' ELSE 'own' || chr(10) || chr(10) || '{LONG}' END AS content FROM a WHERE lookup_kind IS NOT NULL""")
def abstract_enrichment(spark, sf_dir):
    """Documents as records: of six, one is found by DOI before its PMID, one by PMID in the second source, two by title, one only has a short abstract."""
    k, n = c("doc_id") % 6, c("doc_id").cast("string")
    title = F.concat(F.lit("title "), n)
    ids = F.when(k == 0, F.create_map(F.lit("DOI"), F.concat(F.lit("https://doi.org/10.1/"), n), F.lit("pmid"), n)).when(k == 1, F.create_map(F.lit("pubmed"), n)).otherwise(F.create_map().cast("map<string,string>"))
    content = F.when(k == 2, "").when(k == 3, f"Has {LONG.upper()}.").otherwise("own")
    docs = t(spark, sf_dir, "documents")
    evidence = docs.select(c("doc_id").alias("evidence_id"), title.alias("title"), content.alias("content"), F.lit("heuristic:x").alias("dependency_family"), ids.alias("identifiers"))
    row = lambda source, place, kind, value, text: F.struct(F.lit(source).alias("source"), F.lit(place).alias("ordinal"), F.lit(kind).alias("kind"), value.alias("value"), text.alias("abstract"))
    long, short = F.lit(f" {LONG} "), F.lit("short")
    found = F.when(k == 0, F.array(row("OpenAlex", 2, "pmid", n, long), row("OpenAlex", 2, "doi", F.concat(F.lit("10.1/"), n), long), row("EuropePMC", 1, "doi", F.concat(F.lit("10.1/"), n), long))).when(k == 1, F.array(row("EuropePMC", 1, "pmid", n, short), row("OpenAlex", 2, "pmid", n, long))).when(k.isin(2, 3), F.array(row("EuropePMC", 1, "title", title, long)))
    abstracts = docs.select(F.explode(F.when(found.isNotNull(), found).otherwise(F.array(row("EuropePMC", 1, "title", title, short)))).alias("a")).select("a.*")
    return resolvers.enrich(evidence, abstracts)


SEARCHES = """q AS (SELECT o_custkey % 30 AS proposition, ['CONTRADICT', 'RIVAL', 'NULL', 'SUPPORT'][o_orderkey % 4 + 1] AS lane, CASE WHEN o_custkey % 30 < 5 THEN false ELSE o_orderkey % 9 > 0 END AS completed, CASE WHEN o_custkey % 30 >= 20 THEN 0 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS errors, CASE WHEN o_custkey % 30 > 25 THEN 0 ELSE o_orderkey % 3 END AS returned, o_orderkey % 2 AS confirmed FROM orders WHERE NOT (o_custkey % 30 = 7 AND o_orderkey % 4 = 1)),
s AS (SELECT proposition, lane, count(*) AS queries, sum(returned)::BIGINT AS returned, sum(confirmed)::BIGINT AS confirmed, CASE WHEN count(*) FILTER (completed) = 0 THEN 'UNSEARCHED_ERROR' WHEN sum(errors) > 0 OR count(*) FILTER (completed) < count(*) THEN 'SEARCHED_PARTIAL' ELSE 'SEARCHED_COMPLETE' END AS status FROM q GROUP BY 1, 2),
z AS (SELECT *, status = 'SEARCHED_COMPLETE' AND returned = 0 AS genuine_zero FROM s)"""


def searches(spark, sf_dir):
    """Orders as queries of counterevidence; one proposition has no search of one lane, five only failed ones."""
    p, o = c("o_custkey") % 30, c("o_orderkey")
    lane = F.get(F.array(*[F.lit(x) for x in ("CONTRADICT", "RIVAL", "NULL", "SUPPORT")]), (o % 4).cast("int"))
    rows = t(spark, sf_dir, "orders").filter(~((p == 7) & (o % 4 == 1)))
    return resolvers.lane_searches(rows.select(p.alias("proposition"), lane.alias("lane"), F.when(p < 5, False).otherwise(o % 9 > 0).alias("completed"), F.when((p < 20) & (o % 7 == 0), 1).otherwise(0).alias("errors"), F.when(p > 25, 0).otherwise(o % 3).alias("returned"), (o % 2).alias("confirmed")))


@query(f"WITH {SEARCHES} SELECT proposition, lane, queries, returned, confirmed, status, genuine_zero FROM z")
def lane_search_status(spark, sf_dir):
    return searches(spark, sf_dir)


@query(f"WITH {SEARCHES} SELECT lane, sum(returned)::BIGINT AS returned, sum(confirmed)::BIGINT AS lane_confirmed, count(*) FILTER (status = 'SEARCHED_COMPLETE') AS searched_complete, count(*) FILTER (status = 'SEARCHED_PARTIAL') AS searched_partial, count(*) FILTER (status = 'UNSEARCHED_ERROR') AS unsearched, count(*) FILTER (genuine_zero) AS genuine_zero FROM z GROUP BY 1")
def lane_totals(spark, sf_dir):
    return resolvers.lane_totals(searches(spark, sf_dir))


@query(f"""WITH {SEARCHES}, m AS (SELECT DISTINCT proposition, unnest(['CONTRADICT', 'RIVAL', 'NULL']) AS lane FROM q) SELECT proposition, lane, coalesce(status, 'NOT_ATTEMPTED') AS status FROM m LEFT JOIN z USING (proposition, lane)""")
def mandatory_lane_status(spark, sf_dir):
    return resolvers.mandatory_lanes(searches(spark, sf_dir))


@query(f"""WITH {SEARCHES}, m AS (SELECT DISTINCT proposition, unnest(['CONTRADICT', 'RIVAL', 'NULL']) AS lane, unnest([1, 2, 3]) AS place FROM q), b AS (SELECT proposition, lane, place, coalesce(status, 'NOT_ATTEMPTED') IN ('NOT_ATTEMPTED', 'UNSEARCHED_ERROR') AS bad FROM m LEFT JOIN z USING (proposition, lane))
SELECT proposition, string_agg(lane, ',' ORDER BY place) FILTER (bad) AS missing FROM b GROUP BY 1""")
def missing_mandatory_lanes(spark, sf_dir):
    return resolvers.missing_lanes(searches(spark, sf_dir))
