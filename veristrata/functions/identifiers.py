"""Expressions over identifiers, names and links of records. All Catalyst built-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise_doi

# Namespaces whose identifiers alone prove that two records are one body.
STRONG_NAMESPACES = ["companies_house", "charity_number", "ror", "grid", "oc_id", "lei", "ch_officer_id", "ch_psc_id"]

# Organisation id prefixes of charities and companies, and schemes of contract parties.
CHARITY_PREFIXES = ["GB-CHC-", "GB-SC-", "GB-NIC-", "GB-EDU-"]
COMPANY_PREFIXES = ["GB-COH-"]
PARTY_SCHEMES = {"GB-COH": "companies_house", "GB-CHC": "charity_number", "OSCR": "charity_number", "GB-SC": "charity_number", "GB-NIC": "charity_number", "LEI": "lei"}

# Accession numbers of data sets; those with (?i) are met in either case.
ACCESSIONS = [r"\bGSE\d{4,7}\b", r"\bEGA[SD]\d{11}\b", r"\bphs\d{6}\b", r"(?i)\bdoi:10\.5281/zenodo\.\d+\b"]

# Organisation types in order of precedence, with their domain and role.
BODY_TYPES = [
    ("education", "ACADEMIC", "ACADEMIC_BODY"),
    ("healthcare", "CLINICAL", "PROVIDER"),
    ("government", "POLICY", "GOVERNMENT_DEPARTMENT"),
    ("nonprofit", "ADVOCACY", "ADVOCACY_ORGANISATION"),
    ("facility", "ACADEMIC", "ACADEMIC_BODY"),
    ("funder", "PHILANTHROPIC", "PHILANTHROPIC_FUNDER"),
]

# Words that say nothing about a concept.
CONCEPT_STOP_WORDS = ["the", "and", "or", "of", "in", "to", "a", "an", "for", "with", "by", "on", "not", "is", "are", "may", "must", "be", "been", "that", "this", "than", "after", "before", "under", "from", "at", "as", "its", "their"]

# Hosts and paths whose publishers forbid automated retrieval.
DECLINED_ROUTES = [("files.digital.nhs.uk", "/"), ("ckan.publishing.service.gov.uk", "/api/"), ("data.england.nhs.uk", "/api/")]

ABSTRACT_CHARS = 40


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def given(value: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(stripped(value), F.lit(""))


def strong_identifiers(identifiers: Column) -> Column:
    """Sorted `namespace:value` of the strong namespaces, values trimmed and in lower case."""
    return _named(F.map_filter(identifiers, lambda k, v: k.isin(STRONG_NAMESPACES)))


def weak_identifiers(identifiers: Column) -> Column:
    return F.array_except(_named(identifiers), strong_identifiers(identifiers))


def _named(identifiers: Column) -> Column:
    told = F.filter(F.map_entries(identifiers), lambda e: F.coalesce(stripped(e["value"]), F.lit("")) != "")
    return F.array_sort(F.array_distinct(F.transform(told, lambda e: F.concat(e["key"], F.lit(":"), F.lower(stripped(e["value"]))))))


def accessions(text: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in ACCESSIONS])
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def cohorts(title: Column, content: Column, lexicon: Sequence[str]) -> Column:
    """Terms of the caller's lexicon that the record names; none without a lexicon."""
    text = F.lower(F.concat_ws(" ", title, content))
    return F.filter(F.array(*[F.lit(x) for x in sorted(lexicon)]).cast("array<string>"), lambda x: F.contains(text, x))


def concept_terms(text: Column, limit: int) -> Column:
    """The first distinct words of three letters or more that say something, in their order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z][a-zA-Z-]{2,}"), 0)
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(CONCEPT_STOP_WORDS))), 1, limit)


def organisation_identifiers(org_id: Column, charity: Column, company: Column) -> Column:
    """Identifiers that a grant's organisation id and its explicit numbers give; explicit ones win."""
    own = given(org_id)

    def after(prefixes: list[str]) -> Column:
        rest = F.lit(None).cast("string")
        for p in reversed(prefixes):
            rest = F.when(F.upper(own).startswith(p), F.substring(own, len(p) + 1, 1 << 30)).otherwise(rest)
        return rest

    return _told({"threesixtygiving_org_id": own, "charity_number": F.coalesce(given(charity), after(CHARITY_PREFIXES)), "companies_house": F.coalesce(given(company), after(COMPANY_PREFIXES))})


def party_identifiers(scheme: Column, number: Column, party_id: Column) -> Column:
    """Identifiers of a contract's party by its scheme, else by a scheme that its id begins with."""
    schemes = F.create_map(*[F.lit(x) for pair in PARTY_SCHEMES.items() for x in pair])
    own = F.when(given(number).isNotNull(), schemes[F.upper(scheme)])
    embedded = r"(?i)^(GB-COH|GB-CHC|GB-NIC)-([0-9A-Z]{5,10})$"
    inside = F.nullif(F.regexp_extract(stripped(party_id), embedded, 1), F.lit(""))
    name = F.coalesce(own, F.when(inside.isNotNull(), schemes[F.upper(inside)]))
    value = F.when(own.isNotNull(), F.upper(given(number))).otherwise(F.upper(F.regexp_extract(stripped(party_id), embedded, 2)))
    pairs = F.array(F.struct(name.alias("key"), value.alias("value")), F.struct(F.lit("ocds_party_id").alias("key"), F.nullif(party_id, F.lit("")).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))


def _told(values: dict[str, Column]) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def grant_body_id(org_id: Column, charity: Column, name: Column) -> Column:
    """A grant's organisation by its id, else its charity number, else a hash of its name."""
    by_name = F.upper(F.substring(F.sha2(F.lower(F.coalesce(stripped(name), F.lit(""))), 256), 1, 16))
    return F.coalesce(F.concat(F.lit("360G-"), given(org_id)), F.concat(F.lit("360G-GB-CHC-"), given(charity)), F.concat(F.lit("360G-NAME-"), by_name))


def officer_id(path: Column) -> Column:
    """The id in `/officers/<id>/...`."""
    return F.nullif(F.regexp_extract(path, r"^/*officers/+([^/]+)", 1), F.lit(""))


def controller_id(path: Column) -> Column:
    """The last part of a path."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit(""))


def normalise_pmid(value: Column) -> Column:
    return F.regexp_extract(value, r"(\d+)", 1)


def lookup_keys(identifiers: Column, family: Column, title: Column) -> Column:
    """(kind, value) by which a record is looked up: DOI, then PMID, then title, as far as they are there."""
    lowered = F.map_from_entries(F.transform(F.filter(F.map_entries(identifiers), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    of_family = lambda prefix: F.when(family.startswith(prefix), F.substring(family, len(prefix) + 1, 1 << 30))
    doi = F.coalesce(lowered["doi"], lowered["doi_url"], of_family("doi:"))
    pmid = F.coalesce(lowered["pmid"], lowered["pubmed"], of_family("pmid:"))
    keys = [("doi", normalise_doi(doi)), ("pmid", normalise_pmid(pmid)), ("title", stripped(title))]
    return F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in keys]), lambda e: F.coalesce(e["value"], F.lit("")) != "")


def clean_abstract(value: Column) -> Column:
    """White space made single; null if too short to be one."""
    text = F.regexp_replace(stripped(value), r"\s+", " ")
    return F.when(F.length(text) >= ABSTRACT_CHARS, text)


def merged_content(title: Column, content: Column, abstract: Column) -> Column:
    """The content with the abstract after it; null where it holds that already."""
    old = F.coalesce(stripped(content), F.lit(""))
    return F.when(old == "", F.concat(stripped(title), F.lit("\n\n"), abstract)).when(~F.contains(F.lower(old), F.lower(abstract)), F.concat(old, F.lit("\n\n"), abstract))


def search_id(run_id: Column, concept: Column, lane: Column) -> Column:
    return F.concat(F.lit("LS-"), run_id, F.lit("-"), F.upper(F.substring(F.sha2(concept, 256), 1, 12)), F.lit("-"), lane)


def comparison_key(*scope: Column) -> Column:
    """What two results' scopes must share, in one text."""
    return F.concat_ws("␟", *[F.lower(stripped(c)) for c in scope])


def body_domain(types: Column) -> Column:
    """(domain, role) by the first of the types in order of precedence; null for none."""
    lowered = F.transform(types, F.lower)
    out = F.lit(None).cast("struct<domain:string,role:string>")
    for kind, domain, role in reversed(BODY_TYPES):
        out = F.when(F.array_contains(lowered, kind), F.struct(F.lit(domain).alias("domain"), F.lit(role).alias("role"))).otherwise(out)
    return out


def display_name(names: Column) -> Column:
    """names (value, types): the one tagged for display, else the first label, else the first, else empty."""
    tagged = lambda tag: F.get(F.filter(names, lambda n: F.array_contains(n["types"], tag)), 0)["value"]
    return F.coalesce(tagged("ror_display"), tagged("label"), F.get(names, 0)["value"], F.lit(""))


def in_country(codes: Column, code: Column) -> Column:
    """Whether any of a body's country codes is the one asked for; no code asks for nothing."""
    return (F.coalesce(code, F.lit("")) == "") | F.coalesce(F.exists(codes, lambda c: F.upper(c) == F.upper(code)), F.lit(False))


def declined_host(url: Column) -> Column:
    """The host whose policy forbids fetching the url; null if none does."""
    host, path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    out = F.lit(None).cast("string")
    for name, prefix in DECLINED_ROUTES:
        out = F.when((host == name) & path.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def guard_route(url: Column) -> Column:
    """The url; a declined one is an error of the query."""
    return F.when(declined_host(url).isNotNull(), F.raise_error(F.concat(F.lit("route declined: "), url))).otherwise(url)


def census_table(name: Column) -> Column:
    """The table code that a data set's name begins with."""
    return F.nullif(F.regexp_extract(name, r"^\s*([A-Z]{2}\d{3}[A-Z]?)\b", 1), F.lit(""))


def code_role(code: Column) -> Column:
    """Whether a census code is the total, an aggregate or a component."""
    return F.when(code == "0", "total").when(code.isin("1001", "1002", "1003"), "aggregate").otherwise("component")


def first_present(row: Column, *candidates: str) -> Column:
    """The first candidate column, of any case, that holds text in a row given as a map; else empty."""
    folded = F.transform(F.map_entries(row), lambda e: F.struct(F.lower(stripped(e["key"])).alias("key"), stripped(e["value"]).alias("value")))
    told = lambda c: F.get(F.transform(F.filter(folded, lambda e: (e["key"] == c.strip().lower()) & (F.coalesce(e["value"], F.lit("")) != "")), lambda e: e["value"]), 0)
    return F.coalesce(*[told(c) for c in candidates], F.lit(""))
