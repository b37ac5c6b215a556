"""Bibliographic records as they are landed, read from JSON items by explicit schemas into one shape.

Each parser takes a column of JSON objects and gives a struct of source_name, source_record_id,
title, content, source_uri, published_at, identifiers, authors and metadata (JSON). Files are read by
`items`, which explodes the array that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import given, stripped
from ..functions.text import dependency_family, evidence_id, lane
from ..operators.governance import evidence_failures

TEXTS = "array<string>"
# Ids under which sources are registered, and date classes by preference.
SOURCE_IDS = {"OpenAlex": "DS001", "Crossref": "DS002", "PubMed": "DS003", "ClinicalTrials.gov": "DS004"}
DATE_CLASSES = ["published-print", "published-online", "issued"]


def items(spark: SparkSession, path: str, at: str) -> DataFrame:
    """(file, item): the objects of the array at a JSON path of each landed page."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.get_json_object("value", at).alias("items"))
    return pages.select("file", F.posexplode(F.from_json("items", TEXTS)).alias("place", "item"))


def told(*parts: Column) -> Column:
    """The parts that say something, a blank line between."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")


def either(*values: Column) -> Column:
    """The first value that is no empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def mapped(pairs: dict[str, Column]) -> Column:
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()]), lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def record(source: str, key: Column, title: Column, content: Column, uri: Column, published: Column, identifiers: Column, authors: Column, metadata: Column | None = None) -> Column:
    return F.struct(
        F.lit(source).alias("source_name"), key.alias("source_record_id"), title.alias("title"), content.alias("content"), uri.alias("source_uri"), published.alias("published_at"),
        identifiers.alias("identifiers"), F.filter(authors, lambda a: F.coalesce(a, F.lit("")) != "").alias("authors"), (F.lit("{}") if metadata is None else metadata).alias("metadata"),
    )


def abstract_of(index: Column) -> Column:
    """A text from its inverted index (word to places), in the order of places, words of one place in theirs."""
    spread = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("place"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(spread), lambda x: x["word"]), " ")


def openalex(item: Column) -> Column:
    w = F.from_json(item, "id string, display_name string, title string, publication_date string, type string, is_retracted boolean, cited_by_count long, ids map<string,string>, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>")
    title = F.coalesce(either(w["display_name"], w["title"]), F.lit("Untitled OpenAlex work"))
    ids = F.map_filter(F.coalesce(w["ids"], F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    abstract = F.when(F.size(w["abstract_inverted_index"]) > 0, abstract_of(w["abstract_inverted_index"])).otherwise("")
    authors = F.transform(F.coalesce(w["authorships"], F.array().cast("array<struct<author:struct<display_name:string>>>")), lambda a: a["author"]["display_name"])
    meta = F.to_json(F.struct(w["type"].alias("type"), w["cited_by_count"].alias("cited_by_count"), w["is_retracted"].alias("is_retracted")))
    return record("OpenAlex", F.coalesce(either(w["id"], ids["openalex"]), title), title, told(title, abstract), F.coalesce(either(w["id"]), F.lit("https://openalex.org")), w["publication_date"], ids, authors, meta)


def date_parts(parts: Column) -> Column:
    """2021-03 from [[2021, 3]]; null without parts."""
    first = F.get(parts, 0)
    return F.when(F.size(first) > 0, F.array_join(F.transform(first, lambda p: F.lpad(p.cast("string"), F.greatest(F.length(p.cast("string")), F.lit(2)), F.lit("0"))), "-"))


def crossref(item: Column) -> Column:
    parts = "struct<`date-parts`:array<array<int>>>"
    w = F.from_json(item, f"DOI string, URL string, title array<string>, abstract string, type string, author array<struct<given:string,family:string>>, `published-print` {parts}, `published-online` {parts}, issued {parts}, created {parts}")
    title = F.coalesce(F.get(w["title"], 0), F.lit("Untitled Crossref work"))
    doi = either(w["DOI"])
    authors = F.transform(F.coalesce(w["author"], F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.array_join(F.filter(F.array(a["given"], a["family"]), lambda x: F.coalesce(x, F.lit("")) != ""), " "))
    published = F.coalesce(*[date_parts(w[k]["date-parts"]) for k in ("published-print", "published-online", "issued", "created")])
    uri = F.coalesce(either(w["URL"]), F.concat(F.lit("https://doi.org/"), doi), F.lit("https://crossref.org"))
    return record("Crossref", F.coalesce(doi, either(w["URL"]), title), title, told(title, w["abstract"]), uri, published, mapped({"doi": doi}), authors)


def pubmed(pmid: Column, item: Column) -> Column:
    """A summary by its id; an id without one gets a placeholder."""
    w = F.from_json(item, "title string, pubdate string, articleids array<struct<idtype:string,value:string>>, authors array<struct<name:string>>")
    title = F.coalesce(either(w["title"]), F.concat(F.lit("PubMed "), pmid))
    ids = F.filter(F.coalesce(w["articleids"], F.array().cast("array<struct<idtype:string,value:string>>")), lambda a: (F.coalesce(a["idtype"], F.lit("")) != "") & (F.coalesce(a["value"], F.lit("")) != "") & (a["idtype"] != "pmid"))
    # A kind given twice keeps its last value.
    kinds = F.array_distinct(F.transform(ids, lambda a: a["idtype"]))
    last = F.transform(kinds, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(ids, lambda a: a["idtype"] == k), -1)["value"].alias("value")))
    identifiers = F.map_concat(F.map_from_entries(last), F.create_map(F.lit("pmid"), pmid))
    authors = F.transform(F.coalesce(w["authors"], F.array().cast("array<struct<name:string>>")), lambda a: a["name"])
    return record("PubMed", pmid, title, title, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")), w["pubdate"], identifiers, authors)


def europe_pmc(item: Column) -> Column:
    w = F.from_json(item, "id string, source string, pmid string, pmcid string, doi string, title string, abstractText string, authorString string, firstPublicationDate string, pubYear string")
    ids = mapped({k: stripped(w[k]) for k in ("pmid", "pmcid", "doi")})
    key, source = F.coalesce(either(w["id"], ids["doi"], ids["pmid"]), F.lit("")), F.coalesce(either(w["source"]), F.lit("MED"))
    uri = F.when(key != "", F.concat(F.lit("https://europepmc.org/article/"), source, F.lit("/"), key)).otherwise("https://europepmc.org/")
    blank = lambda c: F.coalesce(stripped(c), F.lit(""))
    return record("EuropePMC", F.concat(source, F.lit(":"), key), blank(w["title"]), blank(w["abstractText"]), uri, either(w["firstPublicationDate"], w["pubYear"]), ids, F.transform(F.split(F.coalesce(w["authorString"], F.lit("")), ","), stripped))


def europe_pmc_query(concept: Column, start: Column, end: Column) -> Column:
    span = F.when(given(start).isNotNull(), F.concat(F.lit("FIRST_PDATE:["), start, F.lit(" TO "), F.coalesce(given(end), F.lit("3000-01-01")), F.lit("]"))).when(given(end).isNotNull(), F.concat(F.lit("FIRST_PDATE:[1800-01-01 TO "), end, F.lit("]")))
    return F.concat_ws(" AND ", concept, span)


def as_list(value: Column, kind: str) -> Column:
    """JSON that is a list, one object or nothing, as an array."""
    return F.when(value.isNull() | (value == "null"), F.array().cast(f"array<{kind}>")).when(F.substring(F.ltrim(value), 1, 1) == "[", F.from_json(value, f"array<{kind}>")).otherwise(F.array(F.from_json(F.concat(F.lit('{"x":'), value, F.lit("}")), f"x {kind}")["x"]))


NODE = "struct<`$`:string,`@classid`:string,`@rank`:string>"


def node_text(node: Column) -> Column:
    return F.coalesce(stripped(node["$"]), F.lit(""))


def openaire(item: Column) -> Column:
    """A result with its title, authors, identifiers and date chosen by class; null without an entity or a key."""
    field = lambda name: F.get_json_object(item, f"$.metadata['oaf:entity']['oaf:result'].{name}")
    nodes = {k: as_list(field(k), NODE) for k in ("title", "creator", "pid", "relevantdate", "description")}
    first = lambda a, rule: F.get(F.filter(F.transform(F.filter(a, rule), node_text), lambda t: t != ""), 0)
    title = F.coalesce(first(nodes["title"], lambda n: n["@classid"] == "main title"), first(nodes["title"], lambda n: F.lit(True)), F.lit(""))
    ranked = F.transform(F.filter(nodes["creator"], lambda n: node_text(n) != ""), lambda n, i: F.struct(F.coalesce(n["@rank"].try_cast("double"), F.lit(0.0)).alias("rank"), i.alias("i"), node_text(n).alias("name")))
    authors = F.transform(F.array_sort(ranked), lambda x: x["name"])
    pids = F.filter(F.transform(nodes["pid"], lambda n: F.struct(F.lower(F.coalesce(stripped(n["@classid"]), F.lit(""))).alias("key"), node_text(n).alias("value"))), lambda e: (e["key"] != "") & (e["value"] != ""))
    keys = F.array_distinct(F.transform(pids, lambda e: e["key"]))
    ids = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.get(F.filter(pids, lambda e: e["key"] == k), 0)["value"].alias("value"))))
    of_class = lambda c: first(nodes["relevantdate"], lambda n: n["@classid"] == c)
    dated = [of_class(c) for c in DATE_CLASSES]
    published = F.coalesce(*dated, given(F.coalesce(F.get_json_object(field("dateofacceptance"), "$['$']"), field("dateofacceptance"))))
    header = F.get_json_object(item, "$.header['dri:objIdentifier']")
    key = either(F.coalesce(F.get_json_object(header, "$['$']"), header), ids["doi"])
    abstracts = F.transform(nodes["description"], lambda n, i: F.struct(F.length(node_text(n)).alias("n"), (-i).alias("i"), node_text(n).alias("text")))
    uri = F.coalesce(F.concat(F.lit("https://doi.org/"), ids["doi"]), F.concat(F.lit("https://explore.openaire.eu/search/publication?articleId="), key))
    entity = F.get_json_object(item, "$.metadata['oaf:entity']['oaf:result']")
    return F.when(entity.isNotNull() & key.isNotNull(), record("OpenAIRE", key, title, F.coalesce(F.array_max(abstracts)["text"], F.lit("")), uri, published, ids, authors))


def trial(item: Column) -> Column:
    """A registered study: never published by itself."""
    p = F.from_json(F.get_json_object(item, "$.protocolSection"), "identificationModule struct<nctId:string,briefTitle:string,officialTitle:string>, statusModule struct<overallStatus:string,studyFirstPostDateStruct:struct<date:string>>, descriptionModule struct<briefSummary:string,detailedDescription:string>, designModule struct<studyType:string>, sponsorCollaboratorsModule struct<leadSponsor:struct<name:string>>")
    nct = F.coalesce(either(p["identificationModule"]["nctId"]), F.lit("UNKNOWN_NCT"))
    title = F.coalesce(either(p["identificationModule"]["briefTitle"], p["identificationModule"]["officialTitle"]), F.concat(F.lit("ClinicalTrials.gov "), nct))
    results = F.coalesce(F.get_json_object(item, "$.resultsSection"), F.lit("{}")) != "{}"
    meta = F.to_json(F.struct(F.lit("registration").alias("record_kind"), F.lit(False).alias("published"), results.alias("has_results_posted"), p["statusModule"]["overallStatus"].alias("overall_status")))
    content = told(title, p["descriptionModule"]["briefSummary"], p["descriptionModule"]["detailedDescription"])
    return record("ClinicalTrials.gov", nct, title, content, F.concat(F.lit("https://clinicaltrials.gov/study/"), nct), p["statusModule"]["studyFirstPostDateStruct"]["date"], F.create_map(F.lit("nct"), nct), F.array(p["sponsorCollaboratorsModule"]["leadSponsor"]["name"]), meta)


def fixtures(rows: DataFrame, most: int) -> DataFrame:
    """(place, id, title, content, uri) in memory: the first `most` with what they lack filled in."""
    n = F.col("place").cast("string")
    title = F.coalesce(either(F.col("title")), F.concat(F.lit("Fixture record "), n))
    return rows.orderBy("place").limit(most).select(F.coalesce(either(F.col("id")), n).alias("source_record_id"), title.alias("title"), F.coalesce(either(F.col("content")), title).alias("content"), F.coalesce(either(F.col("uri")), F.concat(F.lit("fixture://"), n)).alias("source_uri"))


def once(records: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of each id within a run."""
    from ..operators.synthesis import first_wins

    return first_wins(records, [key], order)


def once_by_either(records: DataFrame, order: str) -> DataFrame:
    """Records (id, doi) whose id and lower-cased DOI are both new in the order: a record goes if an earlier one has either.

    An earlier record that goes itself still hides later ones, as both of its keys were seen.
    """
    keyed = records.withColumn("doi_", F.lower(F.col("doi")))
    by_id = keyed.groupBy("id").agg(F.min(order).alias("first_id"))
    by_doi = keyed.filter("coalesce(doi_, '') <> ''").groupBy("doi_").agg(F.min(order).alias("first_doi"))
    met = keyed.join(by_id, "id").join(by_doi, "doi_", "left")
    return met.filter((F.col(order) == F.col("first_id")) & F.coalesce(F.col(order) == F.col("first_doi"), F.lit(True))).select(*records.columns)


def evidence(records: DataFrame, query: Column, concept: Column, checksum: Column) -> DataFrame:
    """Records (a column `r`) as evidence: id, lane, dependency family, provenance and the verdict of the gates."""
    r = F.col("r")
    family = dependency_family(F.coalesce(r["identifiers"]["doi"], r["identifiers"]["DOI"]), r["identifiers"]["pmid"], r["title"], F.get(r["authors"], 0), r["published_at"])
    source = r["source_name"]
    for name, code in SOURCE_IDS.items():
        source = F.when(r["source_name"] == name, F.lit(code)).otherwise(source)
    coded = lane(F.concat_ws(" ", r["title"], r["content"]))
    base = records.select(
        evidence_id(r["source_name"], r["source_record_id"]).alias("evidence_id"), source.alias("source_id"), r["title"].alias("title"), r["content"].alias("content"), coded["lane"].alias("lane"), r["source_uri"].alias("source_uri"), r["published_at"].alias("published_at"),
        r["source_record_id"].alias("locator"), checksum.alias("checksum_sha256"), query.alias("query_id"), concept.alias("retrieval_query"), family.alias("dependency_family"), F.sha2(r["content"], 256).alias("content_sha256"),
    )
    row = F.struct(
        F.lit("VERIFIED").alias("source_status"), F.col("source_uri"), F.col("checksum_sha256"), F.lit("OPEN").alias("access_class"), F.lit("PUBLIC_API_TERMS_APPLY").alias("licence_or_approval"), F.lit(False).alias("raw_person_level"),
        F.col("dependency_family"), F.lit(False).alias("retracted"), F.col("content"), F.col("content_sha256"),
    )
    bad = evidence_failures(row)
    return base.withColumns({"failures": bad, "admitted": F.size(bad) == 0})
