"""Cases of the scalar rules: what goes in, and what must come out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import design as X
from ..functions import identifiers as I
from ..functions import numbers as N
from ..functions import text as T
from ..operators import governance as G
from ..operators import panel as P
from .cases import cases

c = F.col
joined = lambda a: F.array_join(a, "|")


def pairs(m):
    """A map as sorted `key=value` texts."""
    return joined(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))


# ------------------------------------------------------------------ names and identifiers


@cases(
    "x string",
    [
        (("Okafor, Ngozi M.",), ("okafor,n",)),
        (("Ngozi Okafor",), ("okafor,n",)),
        (("Okafor N.",), ("okafor,n",)),
        (("Okafor nm",), ("okafor,n",)),
        (("Okafor",), ("okafor,",)),
        (("O'Hara, Liam",), ("o hara,l",)),
        (("Liam O'Hara-Lee",), ("hara-lee,l",)),
        (("  , Liam",), ("",)),
        (("1234",), ("",)),
        (("Müller, Änne",), ("m ller,n",)),
        ((None,), (None,)),
    ],
    "author string",
)
def author_names():
    return [T.normalise_author(c("x"))]


@cases(
    "doi string, pmid string, title string, author string, published string",
    [
        (("https://doi.org/10.5/AB", "12", "T", "X", "2020"), ("doi:10.5/ab",)),
        (("", "12", "T", "X", "2020"), ("pmid:12",)),
        ((None, None, "A Study: of *things*", "Okafor, N", "2021-05-06"), ("heuristic:a-study-of-things:okafor, n:2021",)),
        ((None, "", "--", None, None), ("heuristic::unknown:unkn",)),
        ((None, None, "Late", None, ""), ("heuristic:late:unknown:unkn",)),
    ],
    "family string",
)
def dependency_families():
    return [T.dependency_family(c("doi"), c("pmid"), c("title"), c("author"), c("published"))]


@cases(
    "title string, content string",
    [
        (("Abstracts of the 4th meeting", "short"), (True,)),
        (("Poster sessions", None), (True,)),
        (("Annual congress: selected abstracts", "  "), (True,)),
        (("Proceedings of things", "x" * 200), (False,)),
        (("A trial of something", "short"), (False,)),
        (("Conference programme", "x" * 199), (True,)),
    ],
    "container boolean",
)
def container_records():
    return [T.is_container(c("title"), c("content"))]


@cases(
    "text string, title string, content string",
    [
        (("see GSE1234 and gse999 and EGAS00001000001", "The Elm cohort", "of children"), ("EGAS00001000001|GSE1234", "elm cohort")),
        (("DOI:10.5281/zenodo.77 phs000123", "oak study", None), ("DOI:10.5281/ZENODO.77|PHS000123", "oak")),
        (("GSE123 PHS000123 EGAX00001000001", "none", "at all"), ("", "")),
        (("GSE12345 GSE12345", "Elm Cohort and OAK", "x"), ("GSE12345", "elm cohort|oak")),
    ],
    "accessions string, cohorts string",
)
def accessions_and_cohorts():
    return [joined(I.accessions(c("text"))), joined(I.cohorts(c("title"), c("content"), ["oak", "elm cohort"]))]


@cases(
    "names array<string>, members array<string>",
    [
        ((["Okafor, N", "N Okafor", "Ito Y", "99"], ["b", "a"]), ("ito,y|okafor,n", "family:0eab8a0a3380abf4")),
        (([], ["a", "b", "b"]), ("", "family:0eab8a0a3380abf4")),
    ],
    "authors string, family string",
)
def author_sets():
    return [joined(T.author_keys(c("names"))), T.family_key(c("members"))]


@cases(
    "ids map<string,string>",
    [
        (({"companies_house": " AB12 ", "website": "X.org", "ror": ""},), ("companies_house:ab12", "website:x.org")),
        (({"lei": "Q", "ch_psc_id": "7", "ch_officer_id": "z9", "oc_id": "k", "grid": "G.1"},), ("ch_officer_id:z9|ch_psc_id:7|grid:g.1|lei:q|oc_id:k", "")),
        (({"twitter": "@a"},), ("", "twitter:@a")),
    ],
    "strong string, weak string",
)
def strong_and_weak_identifiers():
    return [joined(I.strong_identifiers(c("ids"))), joined(I.weak_identifiers(c("ids")))]


@cases(
    "org_id string, charity string, company string, name string",
    [
        (("GB-CHC-123", None, None, "A"), ("charity_number=123|threesixtygiving_org_id=GB-CHC-123", "360G-GB-CHC-123")),
        (("gb-coh-00X", None, " 99 ", "A"), ("companies_house=99|threesixtygiving_org_id=gb-coh-00X", "360G-gb-coh-00X")),
        (("GB-COH-00X", "7", "", "A"), ("charity_number=7|companies_house=00X|threesixtygiving_org_id=GB-COH-00X", "360G-GB-COH-00X")),
        (("  ", "7", None, "A"), ("charity_number=7", "360G-GB-CHC-7")),
        (("GB-CHC-", None, None, "A"), ("threesixtygiving_org_id=GB-CHC-", "360G-GB-CHC-")),
        ((None, None, None, " The Elm "), ("", "360G-NAME-8F30102875600570")),
    ],
    "ids string, body string",
)
def grant_organisations():
    return [pairs(I.organisation_identifiers(c("org_id"), c("charity"), c("company"))), I.grant_body_id(c("org_id"), c("charity"), c("name"))]


@cases(
    "scheme string, number string, party string",
    [
        (("gb-coh", " ab1 ", "P-1"), ("companies_house=AB1|ocds_party_id=P-1",)),
        (("OSCR", "sc9", None), ("charity_number=SC9",)),
        (("XX", "1", "gb-chc-12345"), ("charity_number=12345|ocds_party_id=gb-chc-12345",)),
        (("LEI", "", "GB-COH-1234"), ("ocds_party_id=GB-COH-1234",)),
        ((None, None, "GB-NIC-00001Z"), ("charity_number=00001Z|ocds_party_id=GB-NIC-00001Z",)),
        ((None, None, None), ("",)),
    ],
    "ids string",
)
def contract_parties():
    return [pairs(I.party_identifiers(c("scheme"), c("number"), c("party")))]


@cases(
    "path string",
    [
        (("/officers/abc123/appointments",), ("abc123", "appointments")),
        (("/company/1/persons-with-significant-control/individual/zz",), (None, "zz")),
        (("officers/x1",), ("x1", "x1")),
        (("/officers/",), (None, "officers")),
        ((None,), (None, None)),
    ],
    "officer string, controller string",
)
def register_links():
    return [I.officer_id(c("path")), I.controller_id(c("path"))]


@cases(
    "ids map<string,string>, family string, title string",
    [
        (({"DOI": "https://doi.org/10.1/A", "pubmed": "PMID: 42"}, "x", " T "), ("doi=10.1/a|pmid=42|title=T",)),
        (({"doi_url": "10.2/b"}, "pmid:77", ""), ("doi=10.2/b|pmid=77",)),
        (({"pmid": "none"}, "doi:10.3/C", "T"), ("doi=10.3/c|title=T",)),
        (({}, "heuristic:a", "Only a title"), ("title=Only a title",)),
    ],
    "keys string",
)
def lookup_orders():
    return [joined(F.transform(I.lookup_keys(c("ids"), c("family"), c("title")), lambda k: F.concat(k["kind"], F.lit("="), k["value"])))]


ABSTRACT = "An abstract that is long enough to be one, really."


@cases(
    "title string, content string, abstract string",
    [
        (("T", "", f"  {ABSTRACT.replace(' is ', ' is  ')} "), (ABSTRACT, f"T\n\n{ABSTRACT}")),
        (("T", " old ", ABSTRACT), (ABSTRACT, f"old\n\n{ABSTRACT}")),
        (("T", f"Old. {ABSTRACT.upper()}", ABSTRACT), (ABSTRACT, None)),
        (("T", "old", "too short"), (None, None)),
    ],
    "abstract string, content string",
)
def abstracts():
    clean = I.clean_abstract(c("abstract"))
    return [clean, I.merged_content(c("title"), c("content"), clean)]


@cases(
    "text string",
    [
        (("The Effect of Peer Networks on peer uptake, and the uptake of care",), ("effect|peer|networks|uptake|care",)),
        (("re-analysis of x in UK",), ("re-analysis",)),
        (("alpha beta gamma delta epsilon zeta eta theta iota kappa",), ("alpha|beta|gamma|delta|epsilon|zeta|eta|theta",)),
        (("of the 12",), ("",)),
    ],
    "terms string",
)
def concepts():
    return [joined(I.concept_terms(c("text"), 8))]


@cases(
    "run string, concept string, lane string",
    [(("R1", "abc", "NULL"), ("LS-R1-BA7816BF8F01-NULL",)), (("R2", "", "RIVAL"), ("LS-R2-E3B0C44298FC-RIVAL",))],
    "search string",
)
def search_ids():
    return [I.search_id(c("run"), c("concept"), c("lane"))]


@cases(
    "types array<string>, names array<struct<value:string,types:array<string>>>, codes array<string>, code string",
    [
        ((["Funder", "Education"], [("L", ["label"]), ("D", ["ror_display"])], ["gb"], "GB"), ("ACADEMIC/ACADEMIC_BODY", "D", True)),
        ((["funder", "nonprofit"], [("A", ["alias"]), ("L", ["label"])], ["FR"], "GB"), ("ADVOCACY/ADVOCACY_ORGANISATION", "L", False)),
        ((["facility", "healthcare"], [("A", ["alias"]), ("B", [])], [], ""), ("CLINICAL/PROVIDER", "A", True)),
        ((["company"], [], [], "GB"), (None, "", False)),
        ((["government"], [], ["US", "GB"], "gb"), ("POLICY/GOVERNMENT_DEPARTMENT", "", True)),
    ],
    "body string, name string, inside boolean",
)
def research_organisations():
    body = I.body_domain(c("types"))
    return [F.when(body.isNotNull(), F.concat_ws("/", body["domain"], body["role"])), I.display_name(c("names")), I.in_country(c("codes"), c("code"))]


@cases(
    "url string",
    [
        (("https://files.digital.nhs.uk/a.csv",), ("files.digital.nhs.uk",)),
        (("https://FILES.digital.nhs.uk",), ("files.digital.nhs.uk",)),
        (("https://ckan.publishing.service.gov.uk/api/3",), ("ckan.publishing.service.gov.uk",)),
        (("https://ckan.publishing.service.gov.uk/data",), (None,)),
        (("https://data.england.nhs.uk/api/x?y",), ("data.england.nhs.uk",)),
        (("https://digital.nhs.uk/",), (None,)),
    ],
    "declined string",
)
def declined_routes():
    return [I.declined_host(c("url"))]


@cases(
    "name string, code string",
    [(("TS079 - Gender identity", "0"), ("TS079", "total")), (("RM035A x", "1002"), ("RM035A", "aggregate")), (("no table", "7"), (None, "component")), ((" AB123", "10"), ("AB123", "component"))],
    "table_code string, role string",
)
def census_codes():
    return [I.census_table(c("name")), I.code_role(c("code"))]


@cases(
    "row map<string,string>",
    [(({" Title ": " A ", "name": "B"},), ("A",)), (({"TITLE": " ", "Name": "B"},), ("B",)), (({"other": "C"},), ("",))],
    "found string",
)
def csv_lookups():
    return [I.first_present(c("row"), "title", "NAME")]


# ------------------------------------------------------------------ dates and periods


@cases(
    "x string",
    [
        (("2021-02-03T10:00:00Z",), (date(2021, 2, 3), date(2021, 2, 3), date(2021, 2, 3), date(2021, 2, 3))),
        (("03/02/2021",), (date(2021, 2, 3), None, None, None)),
        (("3-2-2021 10:00",), (date(2021, 2, 3), None, None, None)),
        (("2021/02/03",), (date(2021, 2, 3), None, None, None)),
        (("13/14/2021",), (None, None, None, None)),
        (("2021-02-30",), (None, None, None, None)),
        (("2021-02-03 and more",), (date(2021, 2, 3), None, date(2021, 2, 3), None)),
        (("2021-07",), (None, None, None, date(2021, 7, 1))),
        (("1999",), (None, None, None, date(1999, 1, 1))),
        (("2021-02-03T23:30:00+05:00",), (date(2021, 2, 3), date(2021, 2, 3), date(2021, 2, 3), date(2021, 2, 3))),
        (("",), (None, None, None, None)),
        ((None,), (None, None, None, None)),
    ],
    "granted date, contracted date, guided date, registered date",
)
def written_dates():
    return [D.grant_date(c("x")), D.contract_date(c("x")), D.iso_date(c("x")), D.registration_date(c("x"))]


@cases(
    "millis long, title string, day date, year int",
    [
        ((0, "Plan 2019", date(2021, 5, 1), 2004), (date(1970, 1, 1), 2019, date(2004, 1, 1))),
        ((86_399_999, "Plan 2019 to 2020", date(2021, 5, 1), None), (date(1970, 1, 1), None, None)),
        ((-1, "Plan 2011, 2014", date(2021, 5, 1), 1967), (date(1969, 12, 31), 2014, date(1967, 1, 1))),
        ((1_612_310_400_000, "Plan 12019", date(2021, 5, 1), None), (date(2021, 2, 3), None, None)),
        ((None, "Plan 2001", None, 2010), (None, None, date(2010, 1, 1))),
    ],
    "stamped date, conflict int, anchor date",
)
def stamped_dates():
    return [D.epoch_date(c("millis")), D.year_conflict(c("title"), c("day")), D.anchor_date(c("year"))]


@cases(
    "first string, last string",
    [
        (("01/05/2021", "31/05/2021"), ("2021-05", None)),
        (("05/01/2021", "31/05/2021"), ("2021-05", None)),
        (("2021-05-01", "2021-05-31"), ("2021-05", None)),
        (("01/03/2021", "31/05/2021"), (None, None)),
        (("01/05/2021", "05/06/2021"), (None, "AMBIGUOUS_END")),
        (("01/05/2021", "May"), (None, "UNPARSEABLE_END")),
        (("", "31/05/2021"), (None, None)),
    ],
    "month string, problem string",
)
def monthly_windows():
    w = D.monthly_window(c("first"), c("last"))
    return [w["month"], w["problem"]]


@cases(
    "first string, last string",
    [(("2020-11", "2021-02"), ("2020-11|2020-12|2021-01|2021-02",)), (("2020-01", "2020-01"), ("2020-01",))],
    "months string",
)
def month_ranges():
    return [joined(D.month_range(c("first"), c("last")))]


@cases(
    "label string",
    [
        (("Q2 2023/24",), ("financial_quarter", 2023, None, 1)),
        (("q1 2023-2024",), ("financial_quarter", 2023, None, 1)),
        (("2020/21",), ("financial_year", 2020, None, 1)),
        (("2020 - 21",), ("financial_year", 2020, None, 2)),
        (("2020/2021",), ("financial_year", 2020, None, 1)),
        (("March 2022",), ("reporting_month", 2022, 2022, 1)),
        (("Sept 2022",), ("reporting_month", 2022, 2022, 1)),
        ((" 1998 ",), ("calendar_year", 1998, 1998, 1)),
        (("1998 - 00",), ("financial_year", 1998, None, 3)),
        (("2015/16 - 19/20",), ("unknown", None, None, 5)),
        (("2015 - 2017 pooled",), ("unknown", None, None, 3)),
        (("spring",), ("unknown", None, None, 1)),
    ],
    "basis string, start int, calendar int, span int",
)
def period_labels():
    return [N.period_basis(c("label")), N.start_year(c("label")), N.calendar_year(c("label")), N.span_years(c("label"))]


@cases(
    "source string, target string, first date, last date",
    [
        (("a", "b", date(2020, 1, 1), date(2021, 1, 1)), (None, date(2020, 1, 1), date(2021, 1, 1), False, False)),
        (("a", "b", date(2020, 1, 1), None), (None, date(2020, 1, 1), None, True, False)),
        (("a", "a", None, None), ("SELF_LOOP", None, None, True, False)),
        (("a", "b", date(2021, 1, 1), date(2020, 1, 1)), ("VALID_TO_PRECEDES_VALID_FROM", None, None, False, True)),
    ],
    "problem string, valid_from date, valid_to date, is_current boolean, inverted boolean",
)
def tie_intervals():
    t = D.tie_interval(c("first"), c("last"))
    return [D.interval_problem(c("source"), c("target"), c("first"), c("last")), t["valid_from"], t["valid_to"], t["current"], t["inverted"]]


# ------------------------------------------------------------------ cells


@cases(
    "x string",
    [
        (("1,234.5",), (1234.5, None, 1234.5, False, None, None)),
        (("12",), (12.0, None, 12.0, False, 12.0, 12.0)),
        (("-1",), (-1.0, None, -1.0, False, None, -1.0)),
        ((" low ",), (None, "low", None, False, None, None)),
        (("Z",), (None, "Z", None, True, None, None)),
        (("",), (None, ":", None, False, None, None)),
        (("Suppressed",), (None, "Suppressed", None, True, None, None)),
        (("*",), (None, "*", None, True, None, None)),
        (("12 500",), (None, "12 500", 12500.0, False, None, None)),
        ((":",), (None, ":", None, True, None, None)),
        (("n/a",), (None, "n/a", None, True, None, None)),
        ((None,), (None, ":", None, None, None, None)),
    ],
    "value double, marker string, published double, suppressed boolean, indicator double, cube double",
)
def published_cells():
    m = N.marked_cell(c("x"))
    return [m["value"], m["marker"], N.published_cell(c("x")), N.is_suppressed(c("x")), N.indicator_cell(c("x")), N.cube_cell(c("x"))]


@cases(
    "amount string, currency string",
    [(("£1,000", "gbp"), (1000.0,)), (("12.5", None), (12.5,)), (("12.5", " "), (12.5,)), (("5", "EUR"), (None,)), (("-5", "GBP"), (None,)), (("x", "GBP"), (None,)), ((None, None), (None,))],
    "pounds double",
)
def grant_amounts():
    return [N.pounds(c("amount"), c("currency"))]


SIXTEEN = "c struct<" + ",".join(f"{n}:double" for n in N.CERTAINTY) + ">"


def certainty(default: float, **some: float) -> tuple:
    return tuple(some.get(n, default) for n in N.CERTAINTY)


@cases(
    f"{SIXTEEN}, families array<string>, evidence int",
    [
        ((certainty(0.5), ["a", "b"], 2), ("statistical_precision", 0.5, 0.5, 0.5, "MODERATE")),
        ((certainty(0.8, replication=0.2), ["a", "a"], 4), ("replication", 0.2, 0.7625, 0.125, "LOW")),
        ((certainty(0.9, replication=0.64, transportability=0.64), [], 0), ("replication", 0.64, 0.8675, 0.4, "HIGH")),
        ((certainty(1.0, explanatory_contribution=0.0), ["a"], 0), ("explanatory_contribution", 0.0, 0.9375, 0.0, "NEGLIGIBLE")),
    ],
    "weakest string, least double, mean double, weight double, band string",
)
def certainties():
    least = N.weakest(c("c"))
    return [least["name"], least["value"], F.round(N.mean_certainty(c("c")), 9), F.round(N.result_weight(least["value"], c("families"), c("evidence")), 9), N.severity_band(least["value"])]


# ------------------------------------------------------------------ gates

RECORD = "e struct<source_status:string,source_uri:string,checksum_sha256:string,access_class:string,licence_or_approval:string,raw_person_level:boolean,dependency_family:string,retracted:boolean,content:string,content_sha256:string,valid_from:date>"
ABC = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
DAY = date(2020, 1, 1)


@cases(
    RECORD,
    [
        ((("VERIFIED", "u", "s", "OPEN", None, False, "f", False, "abc", ABC, DAY),), ("", "", "")),
        ((("UNVERIFIED", "", None, "LICENSED", "", False, "", True, "abc", "0", None),), ("SOURCE_STATUS_UNVERIFIED|SOURCE_URI_MISSING|CHECKSUM_MISSING|LICENCE_OR_APPROVAL_MISSING|DEPENDENCY_FAMILY_MISSING|SOURCE_WORK_RETRACTED|CONTENT_HASH_MISMATCH", "SOURCE_STATUS_UNVERIFIED|SOURCE_URI_MISSING|CHECKSUM_MISSING|LICENCE_OR_APPROVAL_MISSING|DEPENDENCY_FAMILY_MISSING", "SOURCE_STATUS_UNVERIFIED|SOURCE_URI_MISSING|CHECKSUM_MISSING|LICENCE_OR_APPROVAL_MISSING|DEPENDENCY_FAMILY_MISSING|RELATION_UNDATED")),
        ((("ASSERTED", "u", "s", "TRE_SDE", None, True, "f", None, "", "0", DAY),), ("TRE_APPROVAL_MISSING|TRE_RAW_PERSON_LEVEL_PAYLOAD_PROHIBITED", "TRE_SDE_SOURCE_PROHIBITED_FOR_ONTOLOGY", "TRE_SDE_SOURCE_PROHIBITED_FOR_ONTOLOGY")),
        ((("VERIFIED", "u", "s", "PARTICIPANT_SECURE", "ref", False, "f", False, "abc", None, None),), ("", "", "RELATION_UNDATED")),
        ((("VERIFIED", "u", "s", "TRE_SDE", "ref", False, "f", False, None, ABC, DAY),), ("", "TRE_SDE_SOURCE_PROHIBITED_FOR_ONTOLOGY", "TRE_SDE_SOURCE_PROHIBITED_FOR_ONTOLOGY")),
    ],
    "evidence string, entity string, relation string",
)
def admission_gates():
    return [joined(G.evidence_failures(c("e"))), joined(G.entity_failures(c("e"))), joined(G.relation_failures(c("e")))]


@cases(
    "start date, outcome date, access string, raw boolean, impacts map<string,double>",
    [
        ((date(2020, 1, 1), date(2020, 1, 2), "TRE_SDE", True, {"NULL_OR_ALTERNATIVE": 1.0}), (True, True, None)),
        ((date(2020, 1, 1), date(2020, 1, 1), "TRE_SDE", False, {"OTHER": 0.1}), (False, False, "UNKNOWN_MODEL_FAMILY")),
        ((None, date(2020, 1, 1), "OPEN", True, {"MIXTURE_HETEROGENEITY": -1.5}), (False, False, "IMPACT_OUT_OF_RANGE")),
        ((date(2019, 1, 1), date(2020, 1, 1), "OPEN", False, {}), (True, False, None)),
    ],
    "earlier boolean, crossed boolean, impact string",
)
def record_guards():
    return [G.precedes(c("start"), c("outcome")), G.crosses_boundary(c("access"), c("raw")), G.impact_problem(c("impacts"))]


@cases(
    f"{SIXTEEN}, status string, theory boolean, simulated boolean",
    [
        ((certainty(0.9), "CAUSAL_INFERENCE", False, True), ("SIMULATION_ONLY",)),
        ((certainty(0.9), "SIMULATION", True, False), ("SIMULATION_ONLY",)),
        ((certainty(0.9), "INTERPRETATION", True, False), ("THEORY_DEPENDENT_INTERPRETATION",)),
        ((certainty(0.9), "INTERPRETATION", False, False), ("DESCRIPTIVE_EVIDENCE_ONLY",)),
        ((certainty(0.9), "OBSERVATION", False, False), ("DESCRIPTIVE_EVIDENCE_ONLY",)),
        ((certainty(0.9), "ASSOCIATION", True, False), ("ASSOCIATION_ONLY",)),
        ((certainty(0.9, causal_identification=0.69), "CAUSAL_INFERENCE", False, False), ("ASSOCIATION_ONLY",)),
        ((certainty(0.9, temporal_ordering=0.69), "RECOMMENDATION", False, False), ("ASSOCIATION_ONLY",)),
        ((certainty(0.8), "CAUSAL_INFERENCE", False, False), ("HIGH_TRIANGULATED_CAUSAL_EVIDENCE",)),
        ((certainty(0.7, replication=0.6), "CAUSAL_INFERENCE", False, False), ("MODERATE_TRIANGULATED_CAUSAL_EVIDENCE",)),
        ((certainty(0.7, replication=0.49), "RECOMMENDATION", False, False), ("LIMITED_CAUSAL_EVIDENCE",)),
        ((certainty(0.7, transportability=0.39), "CAUSAL_INFERENCE", False, False), ("ASSOCIATION_ONLY",)),
    ],
    "tier string",
)
def claim_tiers():
    return [G.claim_tier(c("c"), c("status"), c("theory"), c("simulated"))]


@cases(
    "held_type string, held int, type string, proposed int, human boolean, method string",
    [
        ((None, None, "NOTE", 0, False, "HUMAN_CODER"), (None, False, 4)),
        (("NOTE", 3, "NOTE", 3, False, "SOURCE_DECLARED"), (None, False, 3)),
        (("NOTE", 3, "NOTE", 2, True, "AUTOMATED_CLASSIFIER"), ("LOWER_AUTHORITY_OVERWRITE", False, 1)),
        (("NOTE", 3, "PLAN", 6, True, None), ("OBJECT_TYPE_MISMATCH", False, 1)),
        ((None, None, "ETHICS_DECISION", 3, False, None), ("PROTECTED_TYPE_REQUIRES_HUMAN_AUTHORISATION", True, 1)),
        ((None, None, "ETHICS_DECISION", 3, True, None), (None, True, 1)),
        (("RELEASE_DECISION", 4, "RELEASE_DECISION", 4, False, None), (None, True, 1)),
    ],
    "refused string, protected boolean, lane_level int",
)
def authority_patches():
    return [G.patch_problem(c("held_type"), c("held"), c("type"), c("proposed"), c("human")), G.is_protected(c("type")), G.lane_authority(c("method"))]


@cases(
    "population string, status string, tier string, falsifier string, complete double, warnings array<string>, contradictions int",
    [
        (("Adults", "OBSERVATION", "ASSOCIATION_ONLY", "NOT_TESTED", 0.9, [], 0), ("", "")),
        (("School children", "CAUSAL_INFERENCE", "LIMITED_CAUSAL_EVIDENCE", "TRIGGERED", 0.79, ["Z", "A"], 1), ("SENSITIVE_OR_CHILD_POPULATION|CAUSAL_CLAIM_WITH_LIMITED_CERTAINTY|FALSIFIER_TRIGGERED|LOW_PROVENANCE_COMPLETENESS", "A|UNRESOLVED_SUBSTANTIVE_CONTRADICTION|Z")),
        (("Vulnerable adults", "CAUSAL_INFERENCE", "HIGH_TRIANGULATED_CAUSAL_EVIDENCE", "PARTIALLY_TRIGGERED", 0.8, ["A", "A"], 0), ("SENSITIVE_OR_CHILD_POPULATION|FALSIFIER_TRIGGERED", "A|HIGH_IMPACT_CAUSAL_RELEASE")),
    ],
    "kernel string, synthesis string",
)
def review_reasons():
    return [joined(G.kernel_review(c("population"), c("status"), c("tier"), c("falsifier"), c("complete"))), joined(G.synthesis_review(c("warnings"), c("contradictions"), c("tier")))]


RESULT = "declared string, has_result boolean, r struct<proposition_id:string,evidence_ids:array<string>,dependency_families:array<string>,evidence:array<struct<evidence_id:string,admitted:boolean>>,lanes_searched:array<string>,wording:string,claim_tier:string,review_kind:string,review_decision:string>"
ALL_LANES = ["NULL", "RIVAL", "CONTRADICT"]


@cases(
    RESULT,
    [
        (("ASSOCIATION_ONLY", True, ("P", ["e"], ["f"], [("e", True)], ALL_LANES, "is associated with it", "ASSOCIATION_ONLY", "HUMAN", "APPROVED")), ("", "", "")),
        (("LIMITED_CAUSAL_EVIDENCE", True, ("", ["e", "g"], [], [("e", False)], ["NULL"], "It CAUSES and drives it", "ASSOCIATION_ONLY", "AI", "APPROVED")), ("causes|drives", "PROPOSITION_ID_MISSING|DEPENDENCY_FAMILIES_MISSING|EVIDENCE_IDS_NOT_RESOLVABLE:1|UNADMITTED_EVIDENCE_PRESENT:1|COUNTEREVIDENCE_LANES_NOT_SEARCHED:CONTRADICT,RIVAL|WORDING_EXCEEDS_CLAIM_TIER:causes,drives|AI_REVIEW_CANNOT_SATISFY_HUMAN_REVIEW_GATE", "DECLARED_TIER_DISAGREES_WITH_RESULT:LIMITED_CAUSAL_EVIDENCE!=ASSOCIATION_ONLY|PROPOSITION_ID_MISSING|DEPENDENCY_FAMILIES_MISSING|EVIDENCE_IDS_NOT_RESOLVABLE:1|UNADMITTED_EVIDENCE_PRESENT:1|COUNTEREVIDENCE_LANES_NOT_SEARCHED:CONTRADICT,RIVAL|WORDING_EXCEEDS_CLAIM_TIER:causes,drives|AI_REVIEW_CANNOT_SATISFY_HUMAN_REVIEW_GATE")),
        (("SIMULATION_ONLY", False, ("P", [], ["f"], [], ALL_LANES, "we found it", "SIMULATION_ONLY", "HUMAN", "REJECTED")), ("we found", "EVIDENCE_IDS_MISSING|WORDING_EXCEEDS_CLAIM_TIER:we found|HUMAN_REVIEW_DECISION_REJECTED", "WORDING_EXCEEDS_CLAIM_TIER:we found|NO_PERSISTED_RESULT_FOR_CLAIM")),
        ((None, True, ("P", ["e"], ["f"], [("e", True)], ALL_LANES, "unproves nothing", "HIGH_TRIANGULATED_CAUSAL_EVIDENCE", "TEXT", None)), ("", "HUMAN_REVIEW_REFERENCE_NOT_A_REVIEW_RECORD", "CLAIM_TIER_NOT_DECLARED")),
        (("DESCRIPTIVE_EVIDENCE_ONLY", True, ("P", ["e"], ["f"], [("e", True)], ALL_LANES, "explains", "DESCRIPTIVE_EVIDENCE_ONLY", None, None)), ("explains", "WORDING_EXCEEDS_CLAIM_TIER:explains|HUMAN_REVIEW_RECORD_MISSING", "WORDING_EXCEEDS_CLAIM_TIER:explains|HUMAN_REVIEW_RECORD_MISSING")),
    ],
    "hits string, release string, documented string",
)
def releases():
    r = c("r")
    return [joined(G.prohibited_hits(r["wording"], r["claim_tier"], G.PROHIBITED)), joined(G.release_failures(r)), joined(G.documented_failures(c("declared"), r, c("has_result")))]


@cases(
    "lane string, method string, assigned string, kind string, decision string",
    [
        (("NULL", "HUMAN_CODER", "RIVAL", "HUMAN", "APPROVED"), ("NULL", "HUMAN_CODER", True)),
        (("NULL", "SOURCE_DECLARED", "RIVAL", "HUMAN", "APPROVED_WITH_CONDITIONS"), ("NULL", "SOURCE_DECLARED", True)),
        (("NULL", None, "RIVAL", "AI", "APPROVED"), ("NULL", "SOURCE_DECLARED", False)),
        (("UNCLASSIFIED", None, "RIVAL", "HUMAN", "REJECTED"), ("RIVAL", "AUTOMATED_CLASSIFIER", False)),
        (("NULL", "AUTOMATED_CLASSIFIER", "RIVAL", "HUMAN", "DEFERRED"), ("RIVAL", "AUTOMATED_CLASSIFIER", False)),
    ],
    "lane string, method string, releases boolean",
)
def lane_assignments():
    a = G.lane_assignment(c("lane"), c("method"), c("assigned"))
    return [a["lane"], a["method"], G.can_release(c("kind"), c("decision"))]


STATE = "unresolved_issue_ids:array<string>,contradiction_ids:array<string>,rejected_path_ids:array<string>,must_read_refs:array<string>,artifact_hashes:map<string,string>>"


@cases(
    f"s struct<state_version:string,{STATE}, h struct<from_state_version:string,active_task_id:string,{STATE}",
    [
        ((("v1", ["i"], [], ["p"], ["m"], {"a": "1"}), ("v1", "t", ["i", "j"], [], ["p"], ["m"], {"a": "1", "b": "2"})), ("",)),
        ((("v2", ["i"], ["c"], ["p"], ["m"], {"b": "2", "a": "1"}), ("v1", "", [], [], [], [], {"a": "9"})), ("STALE_STATE_VERSION|RESUME_TASK_AMBIGUOUS|OPEN_ISSUE_DROPPED|CONTRADICTION_DROPPED|REJECTED_PATH_DROPPED|MUST_READ_REFERENCE_DROPPED|ARTIFACT_HASH_DRIFT:a|ARTIFACT_HASH_DRIFT:b",)),
    ],
    "failures string",
)
def handoffs():
    return [joined(G.handoff_failures(c("s"), c("h")))]


# ------------------------------------------------------------------ designs


@cases(
    "n int, parameters int, events int, deff double, attrition double, rate double, ratio double, bound double",
    [
        ((300, 5, None, 2.0, 0.0, 0.1, 2.0, 1.5), (150.0, None, "DESCRIPTIVE_EVIDENCE_ONLY", "VERY_LIMITED_EFFECTIVE_SAMPLE|CLAIM_TIER_IS_PLANNING_CEILING_NOT_CAUSAL_VALIDATION", None, 3.414213562, 2.366025404, "ROBUST")),
        ((2000, 5, 40, 1.0, 0.0, 0.1, 0.5, 1.2), (2000.0, 8.0, "ASSOCIATION_ONLY", "RARE_EVENT_INFORMATION_LIMIT|CLAIM_TIER_IS_PLANNING_CEILING_NOT_CAUSAL_VALIDATION", 400, 3.414213562, 1.0, "ROBUST")),
        ((1000, 5, 100, 1.0, 0.5, 0.3, 1.1, None), (500.0, 20.0, "ASSOCIATION_ONLY", "SUBGROUP_AND_INTERACTION_LIMIT|CLAIM_TIER_IS_PLANNING_CEILING_NOT_CAUSAL_VALIDATION", 334, 1.431662479, None, "FRAGILE")),
        ((4000, 20, 100, 2.0, 0.0, 1.5, 1.25, 1.0), (2000.0, 5.0, "ASSOCIATION_ONLY", "MODEL_PARAMETER_INFORMATION_LIMIT|CLAIM_TIER_IS_PLANNING_CEILING_NOT_CAUSAL_VALIDATION", None, 1.809016994, 1.0, "MODERATE")),
        ((4000, 5, None, 2.0, 0.25, 0.0, 1.0, 0.8), (1500.0, None, "LIMITED_CAUSAL_EVIDENCE", "CLAIM_TIER_IS_PLANNING_CEILING_NOT_CAUSAL_VALIDATION", None, 1.0, 1.809016994, "FRAGILE")),
    ],
    "effective double, each double, tier string, warnings string, population long, e_value double, at_limit double, reading string",
)
def design_envelopes():
    e, s = X.envelope(c("n"), c("parameters"), c("events"), c("deff"), c("attrition")), X.sensitivity(c("ratio"), c("bound"))
    return [e["effective_n"], e["events_per_parameter"], e["tier"], joined(e["warnings"]), X.source_population(c("events"), c("rate")), F.round(s["e_value"], 9), F.round(s["limit"], 9), s["reading"]]


@cases(
    "grid int, accepted int, tolerance double, series array<double>, power double",
    [
        ((10, 0, 0.1, [0.0, 1.0, 0.0, 1.0], 0.9), (0.737, "HIGH", "WEAKENS", "NOT_APPLICABLE_REFUTED", "")),
        ((10, 1, 0.1, [0.0, 1.0, 0.0, 1.0], 0.7), (0.711, "HIGH", "INCONCLUSIVE", "CORROBORATED_AT_HIGH_SEVERITY", "UNDERPOWERED_A_NULL_HERE_IS_NOT_EVIDENCE_OF_ABSENCE")),
        ((10, 9, 0.1, [0.0, 1.0, 0.0, 1.0], 0.9), (0.342, "LOW", "INCONCLUSIVE", "COMPATIBLE_ONLY", "")),
        ((10, 10, 0.1, [0.0, 1.0, 0.0, 1.0], 0.9), (0.0, "NEGLIGIBLE", "INCONCLUSIVE", "NO_CORROBORATION_TEST_NOT_SEVERE", "")),
        ((0, 0, 0.1, [2.0, 2.0, 2.0], 0.9), (0.0, "NEGLIGIBLE", "WEAKENS", "NOT_APPLICABLE_REFUTED", "")),
    ],
    "severity double, band string, direction string, corroboration string, warnings string",
)
def calibration_severity():
    s = X.severity(c("grid"), c("accepted"), c("tolerance"), c("series"))
    k = X.corroboration(c("accepted"), s["band"])
    return [F.round(s["index"], 3), s["band"], k["direction"], k["corroboration"], joined(X.power_warnings(F.lit(500), c("power"), F.lit(1.0)))]


@cases(
    "level double, slope double, i int, complete boolean, pooled boolean, points int",
    [((100.0, 0.1, 0, True, False, 3), (100.0, 100.0, True)), ((100.0, 0.1, 2, True, True, 3), (108.414709848, 121.0, False)), ((100.0, 0.0, 5, None, False, 3), (100.0, 100.0, False)), ((50.0, -0.5, 1, True, False, 2), (38.014361535, 25.0, False))],
    "covered double, grown double, usable boolean",
)
def mechanism_series():
    return [F.round(X.coverage_mechanism(c("level"), c("slope"), c("i")), 9), F.round(X.growth_mechanism(c("level"), c("slope"), c("i")), 9), P.usable(c("complete"), c("pooled"), c("points"))]
