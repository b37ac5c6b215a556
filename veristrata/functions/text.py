"""String expressions: identifiers, names, lanes, wording. All Catalyst built-ins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal and stop words dropped from organisation names.
NAME_DROPPED = ["the", "ltd", "limited", "llp", "plc", "inc", "cic", "trust", "foundation", "charity", "charitable", "uk", "and"]

# Lanes in order of precedence, each with its cues.
LANE_CUES = (
    ("CORRECTION_RETRACTION", (r"\bretract(ed|ion|ions)\b", r"\berrat(um|a)\b", r"\bcorrigend(um|a)\b", r"\bexpression of concern\b", r"\bwithdrawn\b", r"\bnotice of correction\b")),
    ("REPLICATION", (r"\breplicat(e|ed|ion|ions)\b", r"\breproduc(e|ed|ibility|tion)\b", r"\bindependent (cohort|sample|validation)\b", r"\bexternal validation\b")),
    ("BIAS_CRITIQUE", (r"\brisk of bias\b", r"\bselection bias\b", r"\bascertainment bias\b", r"\bmethodological (limitation|concern|critique|flaw)", r"\bcritique\b", r"\bcommentary on\b", r"\bre-?analysis\b", r"\bconfounding\b")),
    ("NULL", (r"\bno (statistically )?significant\b", r"\bno (evidence|association|difference|effect|relationship)\b", r"\bnull (result|finding|hypothesis was not rejected)\b", r"\bdid not differ\b", r"\bfailed to (find|detect|show)\b", r"\bnon-?significant\b")),
    ("RIVAL", (r"\balternative explanation\b", r"\bcompeting (model|hypothes[ei]s|explanation)\b", r"\brival (model|hypothes[ei]s|explanation)\b", r"\breverse causation\b", r"\bcommon cause\b")),
)
CONFIDENCE_FLOOR = 0.55

# Titles of records that hold no study, and the content below which they count.
CONTAINER_TITLES = (r"^\s*(scientific\s+)?abstracts?\b", r"\bproceedings\b", r"\b(oral|poster)\s+(presentations?|abstracts?|sessions?)\b", r"\bconference\s+(programme|program|abstracts?)\b", r"\b(annual\s+)?(congress|symposium|meeting)\b.*\babstracts?\b")
CONTAINER_CHARS = 200


def normalise_doi(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), r"^https?://(dx\.)?doi\.org/", "")


def slug(value: Column, most: int) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def dependency_family(doi: Column, pmid: Column, title: Column, author: Column, published: Column) -> Column:
    """doi:, else pmid:, else a heuristic key of title, first author and the first four characters of the date."""
    told = lambda c: F.nullif(c, F.lit(""))
    year = F.substring(F.coalesce(told(published), F.lit("unknown")), 1, 4)
    heuristic = F.concat_ws(":", F.lit("heuristic"), slug(title, 100), F.coalesce(F.lower(author), F.lit("unknown")), year)
    return F.coalesce(F.concat(F.lit("doi:"), normalise_doi(told(doi))), F.concat(F.lit("pmid:"), told(pmid)), heuristic)


def evidence_id(source: Column, record: Column) -> Column:
    return F.concat(F.lit("EV-"), F.upper(F.substring(F.sha2(F.concat_ws("|", source, record), 256), 1, 20)))


def family_key(members: Column) -> Column:
    """A key of a set of ids, however it is ordered."""
    return F.concat(F.lit("family:"), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "|"), 256), 1, 16))


def normalise_name(name: Column) -> Column:
    """Letters and digits only, lower case, legal and stop words dropped."""
    words = F.split(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", " ")), " +")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(NAME_DROPPED)), " ")


def normalise_author(name: Column) -> Column:
    """`surname,initial` from "Surname, Given", "Given Surname" or "Surname I."; a name alone has no initial."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z\s,.-]", " "), r"^\s+|\s+$", "")
    last, first = F.regexp_extract(clean, r"(\S+)$", 1), F.regexp_extract(clean, r"^(\S+)", 1)
    after, before = F.regexp_extract(clean, r"^\S+\s+([\s\S]*)$", 1), F.regexp_extract(clean, r"^([\s\S]*?)\s*\S+$", 1)
    # A short last word stands for the given names.
    led = (first != clean) & (F.length(F.regexp_replace(last, r"^\.+|\.+$", "")) <= 2)
    comma = F.contains(clean, F.lit(","))
    surname = F.lower(F.regexp_replace(F.when(comma, F.regexp_extract(clean, r"^([^,]*),", 1)).when(led, first).otherwise(last), r"^\s+|\s+$", ""))
    rest = F.when(comma, F.regexp_extract(clean, r"^[^,]*,([\s\S]*)$", 1)).when(led, after).otherwise(before)
    return F.when(surname == "", "").otherwise(F.concat(surname, F.lit(","), F.lower(F.regexp_extract(rest, "([A-Za-z])", 1))))


def author_keys(names: Column) -> Column:
    """Sorted distinct keys of a list of names."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, normalise_author), lambda k: k != "")))


def trial_ids(text: Column) -> Column:
    """Distinct registration ids of three schemes, upper case, spaces removed, sorted."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in (r"(?i)\bNCT\d{8}\b", r"(?i)\bISRCTN ?\d{8}\b", r"(?i)\bDRKS\d{8}\b")])
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.upper(F.replace(x, F.lit(" "), F.lit(""))))))


# Registration numbers that join reports of one study.
REGISTRATIONS = (r"\bNCT\d{8}\b", r"\bISRCTN\d{8}\b", r"\bEudraCT[- ]?\d{4}-\d{6}-\d{2}\b", r"\bCRD4?2?\d{10,13}\b", r"\bACTRN\d{14}\b", r"\bChiCTR[-A-Z]*\d{6,10}\b", r"\bDRKS\d{8}\b", r"\bNTR\d{3,4}\b")


def registrations(text: Column) -> Column:
    """Distinct registration numbers of all schemes, upper case, spaces removed, sorted."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit("(?i)" + p), 0) for p in REGISTRATIONS])
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.upper(F.replace(x, F.lit(" "), F.lit(""))))))


def split_list(value: Column) -> Column:
    """Items of a list written with commas or semicolons."""
    return F.filter(F.transform(F.split(value, "[,;]"), F.trim), lambda x: x != "")


def is_container(title: Column, content: Column) -> Column:
    shaped = F.lit(False)
    for p in CONTAINER_TITLES:
        shaped = shaped | title.rlike("(?i)" + p)
    return shaped & (F.length(F.trim(F.coalesce(content, F.lit("")))) < CONTAINER_CHARS)


def lane(text: Column) -> Column:
    """(lane, confidence, hits): the first lane with any cue, even where its confidence is then too low.

    The counts are made once a text, in an array that the choice then reads. A cue's pattern is
    only run on texts that hold the letters it begins with, which is told much faster.
    """

    def begins(cue: str) -> str:
        literal, optional = re.match(r"\\b([a-z -]+)(\??)", cue).groups()
        return literal[:-1] if optional else literal

    def counted(low: Column) -> Column:
        count = lambda cues: sum(((F.contains(low, F.lit(begins(c))) & F.regexp_like(low, F.lit(c))).cast("int") for c in cues), F.lit(0))
        every = F.array(*[F.struct(F.lit(name).alias("lane"), count(cues).alias("n")) for name, cues in LANE_CUES])
        return F.get(F.filter(every, lambda x: x["n"] > 0), 0)

    def verdict(first: Column) -> Column:
        hits = F.coalesce(first["n"], F.lit(0))
        sure = F.when(hits > 0, F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.15) * hits)).otherwise(0.0)
        return F.struct(F.when(sure >= CONFIDENCE_FLOOR, first["lane"]).otherwise("UNCLASSIFIED").alias("lane"), sure.alias("confidence"), hits.cast("long").alias("hits"))

    # Within transform each value is made once a row, however often it is read.
    return F.get(F.transform(F.transform(F.array(F.lower(text)), counted), verdict), 0)


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """The phrases that start a word in the text, in their order."""
    starts = [F.when(F.regexp_like(text, F.lit(r"(?i)\b" + re.escape(p))), F.lit(p)) for p in phrases]
    return F.array_compact(F.array(*starts))
