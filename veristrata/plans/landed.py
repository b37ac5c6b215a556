"""Cases of the parsers of landed items, and queries of the tables' readers over rows that the driver's tables give."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from ..operators import preregistration as V
from ..sources import registers as R
from ..sources import tables, works
from .cases import cases
from .registry import query, t
from .rules import joined, pairs

c = F.col
j = json.dumps


def fields(r):
    """A parsed record's parts in the order of the cases."""
    return [r["source_record_id"], r["title"], r["content"], r["source_uri"], r["published_at"], pairs(r["identifiers"]), joined(r["authors"])]


RECORD = "record string, title string, content string, uri string, published string, ids string, authors string"


@cases(
    "x string",
    [
        ((j({"id": "https://w/1", "display_name": "On Elms", "publication_date": "2020-01-02", "ids": {"doi": "10.1/E", "mag": None}, "abstract_inverted_index": {"grow": [1, 3], "Elms": [0], "and": [2]}, "authorships": [{"author": {"display_name": "Ito Y"}}, {"author": {}}]}),), ("https://w/1", "On Elms", "On Elms\n\nElms grow and grow", "https://w/1", "2020-01-02", "doi=10.1/E", "Ito Y")),
        ((j({"title": "Second", "ids": {"openalex": "W2"}}),), ("W2", "Second", "Second", "https://openalex.org", None, "openalex=W2", "")),
        (("{}",), ("Untitled OpenAlex work", "Untitled OpenAlex work", "Untitled OpenAlex work", "https://openalex.org", None, "", "")),
    ],
    RECORD,
)
def openalex_works():
    return fields(works.openalex(c("x")))


@cases(
    "x string",
    [
        ((j({"DOI": "10.2/a", "title": ["Oaks", "Alt"], "abstract": "Long.", "author": [{"given": "Ana", "family": "Silva"}, {"family": "Ito"}, {}], "issued": {"date-parts": [[2019, 3]]}, "created": {"date-parts": [[2018, 1, 1]]}}),), ("10.2/a", "Oaks", "Oaks\n\nLong.", "https://doi.org/10.2/a", "2019-03", "doi=10.2/a", "Ana Silva|Ito")),
        ((j({"URL": "http://u", "published-online": {"date-parts": [[2021, 11, 5]]}, "published-print": {"date-parts": []}}),), ("http://u", "Untitled Crossref work", "Untitled Crossref work", "http://u", "2021-11-05", "", "")),
        ((j({"title": []}),), ("Untitled Crossref work", "Untitled Crossref work", "Untitled Crossref work", "https://crossref.org", None, "", "")),
    ],
    RECORD,
)
def crossref_works():
    return fields(works.crossref(c("x")))


@cases(
    "id string, x string",
    [
        (("11", j({"title": "Ash", "pubdate": "2020 Jan", "articleids": [{"idtype": "doi", "value": "10.3/z"}, {"idtype": "pmid", "value": "0"}, {"idtype": "", "value": "q"}, {"idtype": "doi", "value": "10.3/y"}], "authors": [{"name": "Ito Y"}, {"name": ""}]})), ("11", "Ash", "Ash", "https://pubmed.ncbi.nlm.nih.gov/11/", "2020 Jan", "doi=10.3/y|pmid=11", "Ito Y")),
        (("12", None), ("12", "PubMed 12", "PubMed 12", "https://pubmed.ncbi.nlm.nih.gov/12/", None, "pmid=12", "")),
    ],
    RECORD,
)
def pubmed_summaries():
    return fields(works.pubmed(c("id"), c("x")))


@cases(
    "x string, first string, last string",
    [
        ((j({"id": "5", "source": "PPR", "doi": " 10.4/q ", "title": " T ", "abstractText": "A", "authorString": "Ito Y, Silva A,", "pubYear": "2018"}), "2020-01-01", None), ("PPR:5", "T", "A", "https://europepmc.org/article/PPR/5", "2018", "doi=10.4/q", "Ito Y|Silva A", "x AND FIRST_PDATE:[2020-01-01 TO 3000-01-01]")),
        ((j({"pmid": "9", "firstPublicationDate": "2019-02-03", "pubYear": "2018"}), "", "2021-01-01"), ("MED:9", "", "", "https://europepmc.org/article/MED/9", "2019-02-03", "pmid=9", "", "x AND FIRST_PDATE:[1800-01-01 TO 2021-01-01]")),
        (("{}", None, None), ("MED:", "", "", "https://europepmc.org/", None, "", "", "x")),
    ],
    RECORD + ", query string",
)
def europe_pmc_works():
    return [*fields(works.europe_pmc(c("x"))), works.europe_pmc_query(F.lit("x"), c("first"), c("last"))]


def oaf(**entity):
    return {"header": {"dri:objIdentifier": {"$": "obj::1"}}, "metadata": {"oaf:entity": {"oaf:result": entity}}}


@cases(
    "x string",
    [
        ((j(oaf(title=[{"$": "Alt"}, {"$": "Main", "@classid": "main title"}], creator=[{"$": "Silva", "@rank": "2"}, {"$": "Ito", "@rank": "1"}, {"$": " "}], pid=[{"$": "10.5/A", "@classid": "DOI"}, {"$": "10.5/B", "@classid": "doi"}], relevantdate=[{"$": "2020-05-01", "@classid": "issued"}, {"$": "2020-04-01", "@classid": "published-online"}], description=[{"$": "short"}, {"$": "longer text"}])),), ("obj::1", "Main", "longer text", "https://doi.org/10.5/A", "2020-04-01", "doi=10.5/A", "Ito|Silva")),
        ((j(oaf(title={"$": "Only"}, creator={"$": "Ito"}, relevantdate={"$": "2019", "@classid": "harvested"}, dateofacceptance={"$": "2018-01-01"})),), ("obj::1", "Only", "", "https://explore.openaire.eu/search/publication?articleId=obj::1", "2018-01-01", "", "Ito")),
        ((j({"metadata": {}}),), (None, None, None, None, None, None, None)),
    ],
    RECORD,
)
def openaire_works():
    r = works.openaire(c("x"))
    return [F.when(r.isNotNull(), f) for f in fields(r)]


def protocol(**modules):
    return {"protocolSection": modules}


@cases(
    "x string",
    [
        ((j(protocol(identificationModule={"nctId": "NCT1", "briefTitle": "Brief", "officialTitle": "Official"}, statusModule={"studyFirstPostDateStruct": {"date": "2020-02-02"}}, descriptionModule={"briefSummary": "Sum", "detailedDescription": "Det"}, sponsorCollaboratorsModule={"leadSponsor": {"name": "Elm"}}) | {"resultsSection": {"a": 1}}),), ("NCT1", "Brief", "Brief\n\nSum\n\nDet", "https://clinicaltrials.gov/study/NCT1", "2020-02-02", "nct=NCT1", "Elm", True)),
        ((j(protocol(identificationModule={"nctId": "NCT2", "officialTitle": "Official"})),), ("NCT2", "Official", "Official", "https://clinicaltrials.gov/study/NCT2", None, "nct=NCT2", "", False)),
        ((j(protocol()),), ("UNKNOWN_NCT", "ClinicalTrials.gov UNKNOWN_NCT", "ClinicalTrials.gov UNKNOWN_NCT", "https://clinicaltrials.gov/study/UNKNOWN_NCT", None, "nct=UNKNOWN_NCT", "", False)),
    ],
    RECORD + ", results boolean",
)
def trial_registrations():
    r = works.trial(c("x"))
    return [*fields(r), F.get_json_object(r["metadata"], "$.has_results_posted").cast("boolean")]


@cases(
    "number string, assigned string, title string, scientific string, published string",
    [
        (("123", "2019-05-06T00:00:00", "T", "S" * 250, "true"), ("ISRCTN123", date(2019, 5, 6), "S" * 200, "published", None)),
        (("isrctn9", "", "T", "", "false"), ("isrctn9", None, "T", "unpublished", "REGISTRATION_UNDATED")),
        ((" ", "2019-05-06", None, None, None), (None, date(2019, 5, 6), "", "unpublished", "NO_REGISTRATION_NUMBER")),
    ],
    "id string, registered date, title string, status string, skipped string",
)
def isrctn_trials():
    r = R.isrctn(c("number"), c("assigned"), c("title"), c("scientific"), c("published"))
    return [r["registration_id"], r["registered_on"], r["title"], r["status"], r["skipped"]]


@cases(
    "x string",
    [
        ((j({"DOI": "10.6/N", "title": ["Notice"], "issued": {"date-parts": [[2022, 1, 9]]}, "update-to": [{"DOI": "https://doi.org/10.6/a", "type": "Retraction"}, {"DOI": "10.6/n", "type": "erratum"}, {"DOI": "", "type": "erratum"}, {"DOI": "10.6/B"}]}),), ("10.6/n>10.6/a:Retraction:true:2022-01-09|10.6/n>10.6/b:unknown:false:2022-01-09", "EV-RETRACT-9F4AEC05B01F7AF2")),
        ((j({"DOI": "10.6/m", "update-to": []}),), ("", "EV-RETRACT-AB39C74E3DE4BF02")),
    ],
    "targets string, evidence string",
)
def retraction_notices():
    told = F.transform(R.retraction_targets(c("x")), lambda r: F.concat(r["notice_doi"], F.lit(">"), r["retracted_doi"], F.lit(":"), r["update_type"], F.lit(":"), r["invalidates"].cast("string"), F.lit(":"), F.coalesce(r["issued"], F.lit(""))))
    return [joined(told), R.notice_evidence_id(F.lower(F.get_json_object(c("x"), "$.DOI")))]


DAY = 86_400_000


@cases(
    "x string",
    [
        ((j({"id": "P1", "title": "Trees", "grantReference": "G/1", "fund": {"start": 18262 * DAY, "end": 18628 * DAY, "valuePounds": 5.5, "funder": {"id": "F1", "name": "Elm &amp; Oak"}}}),), ("GTR-F1", "GTR-PROJECT-P1", date(2020, 1, 1), date(2021, 1, 1), 5.5, None)),
        ((j({"id": "P2", "fund": {"start": 18262 * DAY, "end": 18000 * DAY, "valuePounds": -1, "funder": {"id": "F1", "name": "Elm"}}}),), ("GTR-F1", "GTR-PROJECT-P2", date(2020, 1, 1), None, None, None)),
        ((j({"id": "P3", "fund": {"funder": {"id": "F1", "name": "Elm"}}}),), ("GTR-F1", "GTR-PROJECT-P3", None, None, None, "GRANT_UNDATED")),
        ((j({"id": "P4", "fund": {"start": 0, "funder": {"id": " "}}}),), (None, "GTR-PROJECT-P4", date(1970, 1, 1), None, None, "FUNDER_MISSING")),
    ],
    "funder string, recipient string, valid_from date, valid_to date, pounds double, skipped string",
)
def research_grants():
    r = R.research_grant(c("x"))
    return [r["source"], r["target"], r["valid_from"], r["valid_to"], r["amount_gbp"], r["skipped"]]


@cases(
    "row map<string,string>",
    [
        (({"Funding Org:Identifier": "GB-CHC-1", "funding org:name": "Elm", "Recipient Org:Identifier": "GB-COH-2", "Recipient Org:Name": "Oak", "Award Date": "03/02/2021", "Amount Awarded": "£1,000", "Currency": ""},), ("360G-GB-CHC-1", "360G-GB-COH-2", date(2021, 2, 3), 1000.0, None)),
        (({"Funding Org:Name": "Elm", "Funding Org:Charity Number": "9", "Recipient Org:Name": "Oak", "Recipient Org:Charity Number": "9", "Award Date": "2021-02-03", "Amount Awarded": "7", "Currency": "USD"},), ("360G-GB-CHC-9", "360G-GB-CHC-9", date(2021, 2, 3), None, "FUNDER_IS_RECIPIENT")),
        (({"Funding Org:Identifier": "A", "Funding Org:Name": "Elm", "Recipient Org:Identifier": "B", "Recipient Org:Name": "Oak", "Award Date": "soon"},), ("360G-A", "360G-B", None, None, "GRANT_UNDATED")),
        (({"Funding Org:Identifier": "A", "Recipient Org:Identifier": "B", "Recipient Org:Name": "Oak"},), ("360G-A", "360G-B", None, None, "FUNDER_MISSING")),
        (({"Funding Org:Identifier": "A", "Funding Org:Name": "Elm", "Recipient Org:Identifier": "B"},), ("360G-A", "360G-B", None, None, "RECIPIENT_MISSING")),
    ],
    "funder string, recipient string, valid_from date, pounds double, skipped string",
)
def grant_rows():
    r = R.grant_relation(R.grant_row(c("row")))
    return [r["source"], r["target"], r["valid_from"], r["amount_gbp"], r["skipped"]]


@cases(
    "title string, url string, updated string",
    [
        ((" Elm Act 2004 ", "http://x/ukpga/2003/12/contents", "2020-01-02T03:04:05Z"), ("Elm Act 2004", 2003, date(2003, 1, 1), date(2020, 1, 2))),
        (("Oak Order 1999", "http://x/id", "now"), ("Oak Order 1999", 1999, date(1999, 1, 1), None)),
        (("Ash Rules", "http://x/id", None), ("Ash Rules", None, None, None)),
        (("Search Results", "http://x/2003/1", None), (None, None, None, None)),
    ],
    "title string, enacted int, anchored date, updated_on date",
)
def acts():
    a = R.act(c("title"), c("url"), c("updated"))
    return [a["title"], a["enacted_year"], a["anchor"], a["record_updated"]]


@cases(
    "x string",
    [
        ((j({"title": {"rendered": "<b>Elm</b> &amp; Oak"}, "link": " http://a ", "date_gmt": "2021-03-04T00:00:00", "modified": "2022-01-01", "status": "publish"}),), ("Elm & Oak", "http://a", date(2021, 3, 4), date(2022, 1, 1), False, None)),
        ((j({"title": {"rendered": "Plan 2015"}, "link": "http://b", "date": "2021-03-04", "status": "draft"}),), ("Plan 2015", "http://b", None, None, True, "TITLE_YEAR_CONFLICT")),
        ((j({"title": {"rendered": "Plan"}, "link": "http://c"}),), ("Plan", "http://c", None, None, False, "NO_PUBLISH_DATE")),
        ((j({"title": {"rendered": "<i></i>"}, "link": "http://d", "date": "2021-03-04"}),), ("", "http://d", date(2021, 3, 4), None, False, "TITLE_OR_LINK_MISSING")),
    ],
    "title string, url string, published_on date, updated_on date, withdrawn boolean, skipped string",
)
def guidance_pages():
    g = R.page_guidance(c("x"))
    return [g["title"], g["url"], g["published_on"], g["last_updated"], g["withdrawn"], g["skipped"]]


@cases(
    "html string",
    [
        (('<script type="application/ld+json">{"a":1}</script><SCRIPT type="application/ld+json">[{"b":2},{"c":3}]</SCRIPT>',), ('{"a":1}|{"b":2}|{"c":3}',)),
        (('<script type="application/ld+json">{"@graph":[{"d":4}]}</script>',), ('{"@graph":[{"d":4}]}|{"d":4}',)),
        (("<p>none</p>",), ("",)),
    ],
    "objects string",
)
def linked_data():
    return [joined(R.json_ld(c("html")))]


@cases(
    "x string, required array<string>, pinned array<string>, truncated string, codes array<string>",
    [
        ((j({"geography": {"geogcode": "E92"}, "time": {"value": "2021"}, "measures": {"description": "value"}, "obs_value": {"value": 12}, "obs_status": {"value": "A", "description": "Normal"}}), ["age", "sex"], ["AGE", "sex"], "false", ["0", "0"]), ("E92", "2021", 12.0, "Normal", None, "grand_total")),
        ((j({"obs_value": {"value": 12}, "obs_status": {"value": "Q", "description": "Missing"}}), ["age", "sex"], ["sex"], "false", ["0", "3"]), (None, None, None, "Missing", "UNPINNED:age", "margin")),
        ((j({"obs_value": {"value": "-"}, "obs_status": {"value": "A"}}), ["age"], ["age", "zz"], "false", ["1001", "3"]), (None, None, None, None, "UNKNOWN:zz", "aggregate_cell")),
        ((j({}), [], [], "True", ["4", "3"]), (None, None, None, None, "TRUNCATED", "cross_cell")),
    ],
    "geography string, period string, value double, status string, problem string, kind string",
)
def cube_observations():
    o = tables.cube_cell(c("x"))
    return [o["geography"], o["period"], o["value"], o["status"], tables.slice_problem(c("required"), c("pinned"), c("truncated")), tables.cell_kind(c("codes"))]


# ------------------------------------------------------------------ tables

ARCHIVE = """a AS (SELECT l_suppkey AS k, l_orderkey AS o, l_linenumber AS n, l_shipdate::DATE AS d, l_quantity AS q FROM lineitem)"""


def archive(spark, sf_dir):
    """Line items as rows of a monthly archive: starts in three ways of writing, some windows of two months, some cells suppressed."""
    first, last = F.trunc("l_shipdate", "month"), F.last_day("l_shipdate")
    k = c("l_orderkey") % 5
    start = F.when(k == 0, F.date_format(first, "dd/MM/yyyy")).when(k == 1, F.date_format(first, "MM/dd/yyyy")).when(k == 2, F.date_format(first, "yyyy-MM-dd")).when(k == 3, F.date_format(F.add_months(first, -1), "dd/MM/yyyy")).otherwise(F.date_format(first, "dd/MM/yyyy"))
    text = lambda x: x.cast("string")
    rows = t(spark, sf_dir, "lineitem").select(
        start.alias("REPORTING_PERIOD_START"), F.date_format(last, "dd/MM/yyyy").alias("REPORTING_PERIOD_END"), F.when(c("l_linenumber") % 2 == 0, " England ").otherwise("Provider").alias("BREAKDOWN"), F.concat(F.lit("P"), text(c("l_suppkey"))).alias("PRIMARY_LEVEL"), F.lit("NONE").alias("SECONDARY_LEVEL"),
        F.concat(F.lit("M"), text(c("l_linenumber") % 3)).alias("MEASURE_ID"), F.concat(F.lit("Measure "), text(c("l_linenumber") % 3)).alias("MEASURE_NAME"), F.when(c("l_suppkey") % 9 == 0, "*").otherwise(F.concat(F.lit(" "), text(c("l_quantity").cast("int")))).alias("MEASURE_VALUE"),
    )
    return rows


@query(f"""WITH {ARCHIVE} SELECT 'M' || (n % 3) AS measure_id, CASE WHEN n % 2 = 0 THEN 'England' ELSE 'Provider' END AS breakdown, strftime(d, '%Y-%m') AS month, count(*) AS cells, count(*) FILTER (k % 9 = 0) AS suppressed, sum(CASE WHEN k % 9 > 0 THEN q::INT END)::DOUBLE AS total FROM a WHERE o % 5 <> 3 GROUP BY 1, 2, 3""")
def archive_by_month(spark, sf_dir):
    cells = tables.archive_cells(archive(spark, sf_dir))
    return cells.groupBy("measure_id", "breakdown", "month").agg(F.count("*").alias("cells"), F.count_if("suppressed").alias("suppressed"), F.sum("value").alias("total"))


@query("SELECT 'M' || (l_linenumber % 3) AS measure_id, 'Measure ' || (l_linenumber % 3) AS names FROM lineitem WHERE l_linenumber % 2 = 0 AND l_orderkey % 5 <> 3 GROUP BY 1, 2")
def archive_measures(spark, sf_dir):
    return tables.available_measures(tables.archive_cells(archive(spark, sf_dir), breakdowns=["England"]), "England")


@query("""SELECT (1990 + c_custkey % 5)::INT AS year, sum(c_nationkey)::BIGINT AS population, count(*) AS rows_matched FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0 AND c_custkey % 100 BETWEEN 10 AND 95 AND c_custkey % 7 <> 0 GROUP BY 1""")
def population_slice(spark, sf_dir):
    """Customers as rows of a population table: places, sexes, single years and an oldest band."""
    k = c("c_custkey")
    age = F.when(k % 7 == 0, "Total").when(k % 100 >= 90, "90+").otherwise((k % 100).cast("string"))
    rows = t(spark, sf_dir, "customer").filter(~((k % 7 > 0) & (k % 100 > 95))).select(F.when(k % 2 == 0, " england").otherwise("Wales").alias("geography"), F.when(k % 3 == 0, "All").otherwise("Male").alias("sex"), age.alias("age"), (1990 + k % 5).cast("string").alias("year"), c("c_nationkey").cast("string").alias("value"))
    return tables.population(rows, "England", None, 10, 95)


INDICATORS = """i AS (SELECT p_partkey % 10 AS ind, 'E' || (p_partkey % 4) AS area, CASE WHEN p_partkey % 3 = 0 THEN 'Persons' ELSE 'Male' END AS sex, (2000 + p_partkey % 20)::VARCHAR AS label, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size::DOUBLE END AS value FROM part)"""


def indicators(spark, sf_dir):
    """Parts as rows of an indicator table, each written twice."""
    k = c("p_partkey")
    text = lambda x: x.cast("string")
    one = t(spark, sf_dir, "part").select(
        text(k % 10).alias("Indicator ID"), F.concat(F.lit(" E"), text(k % 4)).alias("Area Code"), F.when(k % 3 == 0, "Persons").otherwise("Male").alias("Sex"), F.lit("All ages").alias("Age"), F.lit("").alias("Category Type"), F.lit("").alias("Category"), F.lit("").alias("Time period Sortable"),
        text(2000 + k % 20).alias("Time period"), F.when(c("p_size") % 20 == 0, "-1").when(c("p_size") % 10 == 0, "*").otherwise(text(c("p_size"))).alias("Value"), F.lit("1").alias("Count"), F.lit("n/a").alias("Denominator"),
    )
    return one.union(one)


@query(f"WITH {INDICATORS} SELECT area, sex, label, value, count(*) AS n FROM (SELECT DISTINCT area, sex, label, value FROM i) GROUP BY 1, 2, 3, 4")
def indicator_rows(spark, sf_dir):
    found = tables.indicator_observations(indicators(spark, sf_dir))
    return found.select(c("area_code").alias("area"), "sex", "label", "value").groupBy("area", "sex", "label", "value").agg(F.count("*").alias("n"))


@query(f"""WITH {INDICATORS}, d AS (SELECT DISTINCT label, value FROM i WHERE area = 'E1' AND sex = 'Persons') SELECT label AS period, CASE WHEN count(*) > 1 THEN 'REPEATED_PERIOD' END AS problem FROM d GROUP BY 1""")
def indicator_series(spark, sf_dir):
    return tables.stratum_series(tables.indicator_observations(indicators(spark, sf_dir)), "E1", "Persons").select("period", "problem")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS n, count(*) FILTER (event_type <> 'purchase') AS m FROM events WHERE day(CAST(ts AS DATE)) % 4 > 0 GROUP BY 1), s AS (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-10', INTERVAL 1 DAY))::DATE AS period)
SELECT period, CASE WHEN m > 0 THEN n END AS count, coalesce(m, 0) = 0 AS missing FROM s LEFT JOIN d ON day = period""")
def media_spine(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("period", F.to_date("ts")).filter(F.day("period") % 4 > 0)
    counts = e.groupBy("period").agg(F.count_if(c("event_type") == "click").alias("count"), F.count_if(c("event_type") != "purchase").alias("monitored"))
    return tables.spine(counts, "2023-12-25", "2024-02-10")


@query("SELECT s_suppkey AS org_id, 'Body ' || (s_suppkey % 10) AS name FROM supplier WHERE s_suppkey % 10 = 3 ORDER BY 1 LIMIT 5 OFFSET 2")
def directory_page(spark, sf_dir):
    """The second page of a directory's search, whose page size is what is asked for."""
    k = c("s_suppkey")
    rows = t(spark, sf_dir, "supplier").select(k.alias("org_id"), F.concat(F.lit("Body "), (k % 10).cast("string")).alias("name"))
    return tables.organisations(rows, name="body 3", limit=5, offset=2)


# ------------------------------------------------------------------ canonical JSON


@cases(
    "x string",
    [
        (('{"b": [2, 1], "a": {"d": 1.0, "c": "é"}}',), ('{"a":{"c":"\\u00e9","d":1.0},"b":[2,1]}', 'a.c="\\u00e9"|a.d=1.0|b=[2,1]')),
        (("[]",), ("[]", "=[]")),
        (('{"k": null}',), ('{"k":null}', "k=null")),
        ((None,), (None, None)),
    ],
    "canonical string, flat string",
)
def canonical_payloads():
    flat = V.flattened(c("x"))
    return [V.canonical_json(c("x")), joined(F.transform(flat, lambda e: F.concat(e["path"], F.lit("="), e["value"])))]


@cases(
    "text string",
    [(("It proves it.\n  Nothing unproved.\nTHIS PROVES more ",), ("line 1: It proves it.|line 3: THIS PROVES more",)), (("improves",), ("",))],
    "context string",
)
def sentence_contexts():
    return [joined(V.sentence_context(c("text"), "proves"))]


SPECS = """s AS (SELECT n_nationkey AS k, '{"a":{"x":' || n_regionkey || ',"y":1},"id":"S' || n_nationkey || '"}' AS now, '{"a":{"x":' || CASE WHEN n_nationkey % 3 = 1 THEN n_regionkey + 1 ELSE n_regionkey END || CASE WHEN n_nationkey % 5 = 2 THEN '' ELSE ',"y":1' END || '},"id":"S' || n_nationkey || '"}' AS was, n_nationkey % 4 > 0 AS frozen FROM nation)"""


def specifications(spark, sf_dir):
    """Nations as specifications written with blanks and in another order; of four, one was never frozen."""
    k, r = c("n_nationkey"), c("n_regionkey")
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    rows = t(spark, sf_dir, "nation")
    now = rows.select(text("S", k).alias("specification_id"), text('{"id": "S', k, '", "a": {"y": 1, "x": ', r, "}}").alias("payload"))
    old = rows.filter(k % 4 > 0).select(text("S", k).alias("specification_id"), text('{"a": {"x": ', F.when(k % 3 == 1, r + 1).otherwise(r), F.when(k % 5 == 2, "").otherwise(', "y": 1'), '}, "id": "S', k, '"}').alias("payload"))
    return now, V.freeze(old, F.lit("2020-06-01").cast("date"))


@query(f"""WITH {SPECS} SELECT 'S' || k AS specification_id, p AS path, CASE p WHEN 'a.x' THEN (CASE WHEN k % 3 = 1 THEN x + 1 ELSE x END)::VARCHAR ELSE NULL END AS frozen_value, CASE p WHEN 'a.x' THEN x::VARCHAR ELSE '1' END AS current_value
FROM (SELECT n_nationkey AS k, n_regionkey AS x, unnest(['a.x', 'a.y']) AS p FROM nation WHERE n_nationkey % 4 > 0) WHERE (p = 'a.x' AND k % 3 = 1) OR (p = 'a.y' AND k % 5 = 2)""")
def specification_drift(spark, sf_dir):
    return V.drift(*specifications(spark, sf_dir))


@query(f"""WITH {SPECS}, r AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT frozen THEN 'NO_PREREGISTRATION_FREEZE' END, CASE WHEN frozen AND now <> was THEN 'SPECIFICATION_DRIFT_AFTER_FREEZE' END, CASE WHEN frozen AND k % 2 = 0 THEN 'FREEZE_POSTDATES_DATA_RETRIEVAL' END], lambda x: x IS NOT NULL), '|') AS reasons FROM s)
SELECT 'S' || k AS specification_id, reasons = '' AS permitted, reasons FROM r""")
def confirmatory_analyses(spark, sf_dir):
    now, frozen = specifications(spark, sf_dir)
    k = c("n_nationkey")
    read = t(spark, sf_dir, "nation").select(F.concat(F.lit("S"), k.cast("string")).alias("specification_id"), F.explode(F.array(F.lit("2021-01-01").cast("date"), F.when(k % 2 == 0, F.lit("2020-01-01").cast("date")))).alias("retrieved_at"))
    return V.confirmatory(now, frozen, read)
