"""Registers as they are landed: trials, notices, contracts, tenders, grants, submissions and guidance, as dated relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import dates as D
from ..functions import identifiers as I
from ..functions import numbers as N
from ..functions.identifiers import given, stripped
from ..functions.text import normalise_doi

# Notices that take a work out.
INVALIDATING = ["retraction", "withdrawal", "removal"]


def clean_text(value: Column) -> Column:
    """Entities as characters, stripped. Only texts with an ampersand are looked at in Python: Spark has no table of all entities."""

    @pandas_udf(StringType())
    def unescaped(texts):
        import html

        return texts.map(lambda t: None if t is None else html.unescape(t))

    return stripped(F.when(F.contains(value, F.lit("&")), unescaped(value)).otherwise(F.coalesce(value, F.lit(""))))


def strip_markup(value: Column) -> Column:
    return clean_text(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]+>", ""))


# ------------------------------------------------------------------ trials and notices


def isrctn(number: Column, assigned: Column, title: Column, scientific: Column, published: Column) -> Column:
    """A registration of the XML's fields, and why it is left out: without a number or a date."""
    key = given(number)
    day = D.registration_date(F.substring(assigned, 1, 10))
    named = F.when(F.upper(key).startswith("ISRCTN"), key).otherwise(F.concat(F.lit("ISRCTN"), key))
    skipped = F.when(key.isNull(), "NO_REGISTRATION_NUMBER").when(day.isNull(), "REGISTRATION_UNDATED")
    status = F.when(published == "true", "published").otherwise("unpublished")
    return F.struct(named.alias("registration_id"), day.alias("registered_on"), F.substring(F.coalesce(given(scientific), given(title), F.lit("")), 1, 200).alias("title"), status.alias("status"), skipped.alias("skipped"))


def retraction_targets(item: Column) -> Column:
    """What a notice (JSON) updates: (notice_doi, retracted_doi, update_type, title, issued, invalidates), never itself."""
    w = F.from_json(item, "DOI string, title array<string>, issued struct<`date-parts`:array<array<int>>>, `update-to` array<struct<DOI:string,type:string>>")
    from .works import date_parts

    own, title, issued = normalise_doi(F.coalesce(w["DOI"], F.lit(""))), F.coalesce(F.get(w["title"], 0), F.lit("")), date_parts(w["issued"]["date-parts"])
    kind = lambda u: F.coalesce(F.nullif(u["type"], F.lit("")), F.lit("unknown"))
    found = F.transform(F.coalesce(w["update-to"], F.array().cast("array<struct<DOI:string,type:string>>")), lambda u: F.struct(own.alias("notice_doi"), normalise_doi(F.coalesce(u["DOI"], F.lit(""))).alias("retracted_doi"), kind(u).alias("update_type"), title.alias("title"), issued.alias("issued"), F.lower(kind(u)).isin(INVALIDATING).alias("invalidates")))
    return F.filter(found, lambda r: (r["retracted_doi"] != "") & (r["retracted_doi"] != own))


def notice_evidence_id(notice_doi: Column) -> Column:
    return F.concat(F.lit("EV-RETRACT-"), F.upper(F.substring(F.sha2(notice_doi, 256), 1, 16)))


# ------------------------------------------------------------------ contracts

RELEASE = "ocid string, id string, date string, tender struct<title:string>, buyer struct<name:string,id:string>, parties array<struct<id:string,identifier:struct<scheme:string,id:string>>>, awards array<struct<id:string,date:string,value:struct<amount:double,currency:string>,contractPeriod:struct<startDate:string,endDate:string>,suppliers:array<struct<name:string,id:string>>>>, contracts array<struct<awardID:string,dateSigned:string,period:struct<startDate:string,endDate:string>>>"


def contract_awards(releases: DataFrame, title_contains: str = "") -> DataFrame:
    """(item: JSON release) to buyer, award and supplier relations; rows with `skipped` say why there is none.

    The start is the contract's, else the award's day; an end before the start is not taken.
    """
    r = releases.select(F.from_json("item", RELEASE).alias("r"))
    ocid = F.coalesce(F.nullif(F.col("r.ocid"), F.lit("")), F.col("r.id"), F.lit(""))
    title = F.coalesce(F.col("r.tender.title"), F.lit(""))
    shut = F.when(~F.contains(F.lower(title), F.lit(title_contains.strip().lower())), "TITLE_FILTER_EXCLUDED").when(given(F.col("r.buyer.name")).isNull(), "BUYER_NAME_MISSING")
    each = r.select(ocid.alias("ocid"), stripped(F.col("r.buyer.name")).alias("buyer"), F.col("r.buyer.id").alias("buyer_id"), shut.alias("shut"), F.explode_outer(F.when(shut.isNull(), F.col("r.awards"))).alias("a")).filter("shut is not null or a is not null")
    start = F.coalesce(D.contract_date(F.col("a.contractPeriod.startDate")), D.contract_date(F.col("a.date")))
    dated = each.withColumn("start", start).withColumn("shut", F.coalesce("shut", F.when(F.col("start").isNull(), "AWARD_UNDATED")))
    out = dated.select("*", F.explode_outer(F.when(F.col("shut").isNull(), F.col("a.suppliers"))).alias("s")).filter("shut is not null or s is not null")
    supplier, end = given(F.col("s.name")), D.contract_date(F.col("a.contractPeriod.endDate"))
    body = lambda key, name: F.concat(F.lit("CF-"), F.coalesce(given(key), F.substring(F.sha2(name, 256), 1, 12)))
    source, target = body(F.col("buyer_id"), F.col("buyer")), body(F.col("s.id"), supplier)
    skipped = F.coalesce("shut", F.when(supplier.isNull(), "SUPPLIER_NAME_MISSING").when(source == target, "SELF_AWARD"))
    key = F.concat_ws("|", "ocid", F.coalesce("a.id", F.lit("")), target)
    amount = F.when(F.coalesce(F.col("a.value.currency"), F.lit("GBP")) == "GBP", F.col("a.value.amount"))
    kept = lambda c: F.when(skipped.isNull(), c)
    return out.select("ocid", kept(source).alias("source"), kept(target).alias("target"), kept(F.concat(F.lit("CFR-"), F.upper(F.substring(F.sha2(key, 256), 1, 20)))).alias("relation_id"), kept(F.col("start")).alias("valid_from"), kept(F.when(end >= F.col("start"), end)).alias("valid_to"), kept(amount).alias("amount_gbp"), skipped.alias("skipped"))


def skips(rows: DataFrame) -> DataFrame:
    """How often each reason kept a row out."""
    return rows.filter("skipped is not null").groupBy("skipped").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ grants


def research_grant(item: Column) -> Column:
    """A project (JSON) and its fund: funder, recipient placeholder, dates and pounds, and why it is left out."""
    p = F.from_json(item, "id string, title string, grantReference string, fund struct<start:long,end:long,valuePounds:double,funder:struct<id:string,name:string>>")
    start, end = D.epoch_date(p["fund"]["start"]), D.epoch_date(p["fund"]["end"])
    funder, project = given(p["fund"]["funder"]["id"]), F.coalesce(stripped(p["id"]), F.lit(""))
    locator = F.coalesce(given(p["grantReference"]), project)
    skipped = F.when(funder.isNull() | (clean_text(p["fund"]["funder"]["name"]) == ""), "FUNDER_MISSING").when(start.isNull(), "GRANT_UNDATED")
    target = F.concat(F.lit("GTR-PROJECT-"), F.coalesce(F.nullif(project, F.lit("")), F.upper(F.substring(F.sha2(locator, 256), 1, 12))))
    source = F.concat(F.lit("GTR-"), funder)
    key = F.concat(F.lit("GTRR-"), F.upper(F.substring(F.sha2(F.concat_ws("|", locator, source, target), 256), 1, 20)))
    pounds = F.when(p["fund"]["valuePounds"] >= 0, p["fund"]["valuePounds"])
    return F.struct(source.alias("source"), target.alias("target"), F.lit("GRANTS_TO").alias("relation"), key.alias("relation_id"), start.alias("valid_from"), F.when(end >= start, end).alias("valid_to"), pounds.alias("amount_gbp"), skipped.alias("skipped"))


def grant_row(row: Column) -> Column:
    """A CSV row (a map) of a grants table in the JSON shape; columns are found whatever their case."""
    find = lambda *names: I.first_present(row, *names)
    body = lambda who: F.struct(*[find(f"{who} Org:{column}").alias(field) for field, column in (("id", "Identifier"), ("name", "Name"), ("charity", "Charity Number"), ("company", "Company Number"))])
    return F.struct(find("Identifier").alias("id"), find("Title").alias("title"), F.coalesce(F.nullif(find("Currency"), F.lit("")), F.lit("GBP")).alias("currency"), find("Amount Awarded").alias("amount"), find("Award Date").alias("award_date"), body("Funding").alias("funder"), body("Recipient").alias("recipient"))


def grant_relation(grant: Column) -> Column:
    """A grant of `grant_row` as a relation of its funder and recipient."""
    body = lambda b: I.grant_body_id(b["id"], b["charity"], b["name"])
    start = D.grant_date(grant["award_date"])
    source, target = body(grant["funder"]), body(grant["recipient"])
    skipped = F.when(given(grant["funder"]["name"]).isNull(), "FUNDER_MISSING").when(given(grant["recipient"]["name"]).isNull(), "RECIPIENT_MISSING").when(start.isNull(), "GRANT_UNDATED").when(source == target, "FUNDER_IS_RECIPIENT")
    return F.struct(source.alias("source"), target.alias("target"), start.alias("valid_from"), N.pounds(grant["amount"], grant["currency"]).alias("amount_gbp"), skipped.alias("skipped"))


# ------------------------------------------------------------------ acts and guidance


def act(title: Column, url: Column, updated: Column) -> Column:
    """An entry of a feed of acts: the year is the address's, else the title's last resort; null for the feed's own heading."""
    name = F.coalesce(stripped(title), F.lit(""))
    year = F.coalesce(F.nullif(F.regexp_extract(url, r"/((?:19|20)\d{2})/", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))).cast("int")
    kept = (name != "") & (F.lower(name) != "search results")
    return F.when(kept, F.struct(name.alias("title"), url.alias("url"), year.alias("enacted_year"), D.anchor_date(year).alias("anchor"), D.contract_date(stripped(updated)).alias("record_updated")))


def page_guidance(item: Column) -> Column:
    """A page of a publishing site (JSON): a title's year that contradicts the site's day takes the day away."""
    w = F.from_json(item, "id string, title struct<rendered:string>, link string, date_gmt string, date string, modified_gmt string, modified string, status string")
    title, url = strip_markup(w["title"]["rendered"]), F.coalesce(stripped(w["link"]), F.lit(""))
    stamped = D.iso_date(F.coalesce(F.nullif(w["date_gmt"], F.lit("")), w["date"]))
    conflict = D.year_conflict(title, stamped)
    skipped = F.when((title == "") | (url == ""), "TITLE_OR_LINK_MISSING").when(conflict.isNotNull(), "TITLE_YEAR_CONFLICT").when(stamped.isNull(), "NO_PUBLISH_DATE")
    status = F.coalesce(w["status"], F.lit(""))
    return F.struct(title.alias("title"), url.alias("url"), F.when(conflict.isNull(), stamped).alias("published_on"), D.iso_date(F.coalesce(F.nullif(w["modified_gmt"], F.lit("")), w["modified"])).alias("last_updated"), (~status.isin("publish", "")).alias("withdrawn"), skipped.alias("skipped"))


def merged_guidance(documents: DataFrame) -> DataFrame:
    """(url, ordinal, ...) of several harvests: the first document of each address."""
    from ..operators.synthesis import first_wins

    return first_wins(documents, ["url"], "ordinal")


def on_topic(documents: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with `kept`: whether the title holds any of the terms."""
    low = F.lower("title")
    return documents.withColumn("kept", sum((F.contains(low, F.lit(x)).cast("int") for x in terms), F.lit(0)) > 0)


def json_ld(html: Column) -> Column:
    """Every JSON-LD object of a page as JSON, lists and @graph taken apart one level."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    one = F.flatten(F.transform(blocks, lambda b: F.when(F.substring(F.ltrim(b), 1, 1) == "[", F.coalesce(F.from_json(b, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(stripped(b)))))
    graphs = F.flatten(F.transform(one, lambda o: F.coalesce(F.from_json(F.get_json_object(o, "$['@graph']"), "array<string>"), F.array().cast("array<string>"))))
    return F.concat(one, graphs)
