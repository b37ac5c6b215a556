"""Landed pages, whole readers and the store."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from veristrata.sources import registers, store, tables, works


def test_pages_become_items_and_evidence(spark, tmp_path):
    pages = [[{"id": "https://w/1", "display_name": "A replicated trial", "ids": {"doi": "https://doi.org/10.1/A"}}, {"id": "https://w/2", "display_name": "B"}], [{"id": "https://w/1", "display_name": "A again"}]]
    for k, items in enumerate(pages):
        (tmp_path / f"{k}.json").write_text(json.dumps({"results": items, "meta": {"next_cursor": None}}))
    found = works.items(spark, str(tmp_path / "*.json"), "$.results")
    assert found.count() == 3
    records = found.withColumn("r", works.openalex(F.col("item"))).withColumn("key", F.col("r.source_record_id")).withColumn("order", F.concat("file", F.col("place").cast("string")))
    once = works.once(records, "key", "order")
    got = {r.locator: r for r in works.evidence(once, F.lit("Q1"), F.lit("trees"), F.lit("f" * 64)).collect()}
    a = got["https://w/1"]
    assert set(got) == {"https://w/1", "https://w/2"} and a.dependency_family == "doi:10.1/a" and a.source_id == "DS001" and a.admitted
    assert a.lane == "REPLICATION" and got["https://w/2"].dependency_family == "heuristic:b:unknown:unkn" and a.title == "A replicated trial"
    assert not works.evidence(once, F.lit("Q1"), F.lit("trees"), F.lit("")).first().admitted


def test_either_key_hides_a_later_record(spark):
    rows = spark.createDataFrame([("a", "10.1/X", 1), ("b", "10.1/x", 2), ("b", "10.1/y", 3), ("c", None, 4), ("d", "", 5), ("e", "", 6)], "id string, doi string, n int")
    assert sorted(r.n for r in works.once_by_either(rows, "n").collect()) == [1, 4, 5, 6]


def test_fixture_rows_are_filled_in(spark):
    rows = spark.createDataFrame([(2, None, "", None, None), (1, "x", "T", "C", "u"), (3, "z", "Z", "", "")], "place int, id string, title string, content string, uri string")
    got = [tuple(r) for r in works.fixtures(rows, 2).orderBy("source_uri").collect()]
    assert got == [("2", "Fixture record 2", "Fixture record 2", "fixture://2"), ("x", "T", "C", "u")]


def test_contract_awards(spark):
    def release(**more):
        return {"ocid": "o", "date": "2020-01-01", "tender": {"title": "Trees"}, "buyer": {"name": "Town", "id": "T"}, "awards": []} | more

    def award(**more):
        return {"id": "1", "date": "2020-02-01T00:00:00Z", "value": {"amount": 5, "currency": "GBP"}, "suppliers": [{"name": "Oak", "id": "O"}]} | more

    rows = [
        release(awards=[award(contractPeriod={"startDate": "2020-03-01", "endDate": "2019-01-01"}), award(id="2", value={"amount": 5, "currency": "EUR"}, contractPeriod={"endDate": "2021-01-01"})]),
        release(buyer={"name": " "}, awards=[award()]),
        release(tender={"title": "Roads"}, awards=[award()]),
        release(awards=[award(date="soon"), award(suppliers=[{"name": "", "id": "O"}, {"name": "Town", "id": "T"}])]),
    ]
    got = registers.contract_awards(spark.createDataFrame([(json.dumps(r),) for r in rows], "item string"), "tree")
    kept = [(r.source, r.target, r.valid_from, r.valid_to, r.amount_gbp) for r in got.filter("skipped is null").orderBy("valid_from").collect()]
    assert kept == [("CF-T", "CF-O", date(2020, 2, 1), date(2021, 1, 1), None), ("CF-T", "CF-O", date(2020, 3, 1), None, 5.0)]
    assert {r.skipped: r.n for r in registers.skips(got).collect()} == {"BUYER_NAME_MISSING": 1, "TITLE_FILTER_EXCLUDED": 1, "AWARD_UNDATED": 1, "SUPPLIER_NAME_MISSING": 1, "SELF_AWARD": 1}


def test_documents_merge_and_stay_on_topic(spark):
    rows = spark.createDataFrame([("u1", 1, "Elm care"), ("u1", 2, "Later"), ("u2", 3, "Roads")], "url string, ordinal int, title string")
    merged = registers.on_topic(registers.merged_guidance(rows), ["elm", "oak"])
    assert {(r.url, r.title, r.kept) for r in merged.collect()} == {("u1", "Elm care", True), ("u2", "Roads", False)}


def test_archives_refuse_a_changed_schema_and_populations_their_aggregates(spark):
    with pytest.raises(ValueError, match="MEASURE_VALUE"):
        tables.archive_cells(spark.createDataFrame([("x",)], "BREAKDOWN string"))
    rows = spark.createDataFrame([("England", "All", a, "2020", v) for a, v in (("Total", "100"), ("5", "7.0"), ("90+", "3"), ("x", "9"), ("89", ""))], "geography string, sex string, age string, year string, value string")
    total = lambda **k: [r.population for r in tables.population(rows, "england", **k).collect()]
    assert total() == [100] and total(low=0) == [10] and total(high=89) == [7] and total(low=91) == [] and total(sex="Male") == []


def test_series_say_why_they_cannot_be_used(spark):
    def reason(rows, **k):
        return tables.observed(spark.createDataFrame(rows, "period string, value double, span int"), **k).first().reason

    whole = [(str(p), 1.0, 1) for p in range(3)]
    assert reason(whole) is None and reason(whole[:2]) == "TOO_FEW_POINTS" and reason([]) == "EMPTY" and reason([*whole, ("9", None, 1)]) == "MISSING_PERIODS"
    pooled = [(p, v, 3) for p, v, _ in whole]
    assert reason(pooled) == "POOLED_PERIODS" and reason(pooled, allow_pooled=True) is None


def test_directories_ask_for_a_filter(spark):
    rows = spark.createDataFrame([(i, "Elm" if i % 2 else "Oak", "R1") for i in range(6)], "org_id int, name string, primary_role_id string")
    assert [r.org_id for r in tables.organisations(rows, name="elm", limit=2, offset=1).collect()] == [3, 5]
    for bad in ({}, {"name": "x", "limit": 0}, {"name": "x", "limit": 1001}):
        with pytest.raises(ValueError):
            tables.organisations(rows, **bad)


def test_store_keeps_the_last_write_and_guards_runs(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.read("evidence_objects") is None and s.latest_census() is None
    row = lambda i, v, ok=True: (i, "S", v, ok)
    frame = lambda *rows: spark.createDataFrame(rows, "evidence_id string, source_id string, title string, admitted boolean")
    s.save("evidence_objects", frame(row("b", "old"), row("a", "old", False)))
    s.save("evidence_objects", frame(row("b", "new"), row("c", "new")))
    assert [(r.evidence_id, r.title) for r in s.evidence().collect()] == [("a", "old"), ("b", "new"), ("c", "new")]
    assert [r.evidence_id for r in s.evidence(admitted_only=True).collect()] == ["b", "c"] and s.source_ids().count() == 1
    results = spark.createDataFrame([("r1", "run")], "result_id string, run_id string")
    with pytest.raises(ValueError, match="manifest"):
        s.save("kernel_results", results)
    s.save("run_manifests", spark.createDataFrame([("run", "o")], "run_id string, objective string"))
    s.save("kernel_results", results)
    assert s.read("kernel_results", run_id="run").count() == 1 and s.read("kernel_results", run_id="x").count() == 0
    for k, at in enumerate(("2020-01-02", "2020-01-01")):
        census = spark.createDataFrame([(f"c{k}", at)], "census_id string, assessed_at string")
        s.save_census(census, spark.createDataFrame([(f"c{k}", p) for p in ("p2", "p1")], "census_id string, proposition_id string"), spark.createDataFrame([(f"c{k}", "p1")], "census_id string, proposition_id string"))
    assert s.latest_census() == "c0" and [p.proposition_id for p in s.census("c1").first().propositions] == ["p1", "p2"]


def test_claims_and_reports(spark, tmp_path):
    claims = spark.createDataFrame([("C1", ["e1", "e2"]), ("C2", [])], "claim_id string, evidence_ids array<string>")
    store.write_claims(claims, str(tmp_path / "claims"))
    assert {(r.claim_id, r.evidence_ids) for r in spark.read.option("header", True).csv(str(tmp_path / "claims")).collect()} == {("C1", "e1;e2"), ("C2", None)}
    text = store.markdown(claims.orderBy("claim_id"), "Claims", most=1)
    assert text.startswith("# Claims\n") and "| C1 |" in text and "More than 1 rows." in text and "C2" not in text
