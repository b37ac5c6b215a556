"""Small cases of the linkage and series operators."""

import datetime as dt

from veristrata.operators import graph, linkage, series

DAY = dt.date


def test_registrations_link_by_id_in_text(spark):
    regs = spark.createDataFrame([("NCT00000001", DAY(2018, 1, 1)), ("NCT00000002", DAY(2018, 1, 1)), ("NCT00000003", DAY(2023, 1, 1))], "reg_id string, registered_on date")
    pubs = spark.createDataFrame([(1, DAY(2019, 1, 1), "see nct00000001."), (2, DAY(2018, 6, 1), "NCT00000001 again, NCT00000001"), (3, DAY(2017, 1, 1), "NCT00000002"), (4, None, None)], "pub_id long, published_on date, text string")
    links = linkage.link_registrations(regs, pubs, "2022-01-01")
    got = {r.reg_id: r for r in links.collect()}
    assert (got["NCT00000001"].publications, got["NCT00000001"].first_published, got["NCT00000001"].status) == (2, DAY(2018, 6, 1), "PUBLISHED")
    assert got["NCT00000002"].status == "UNPUBLISHED"  # published before it was registered
    assert got["NCT00000003"].status == "TOO_RECENT"
    (summary,) = linkage.linkage_summary(links).collect()
    assert (summary.denominator, summary.published, summary.too_recent, summary.rate) == (2, 1, 1, 0.5)


def test_last_notice_counts(spark):
    works = spark.createDataFrame([(1, "https://doi.org/10.1/A"), (2, "10.1/b"), (3, None)], "work_id long, doi string")
    notices = spark.createDataFrame([("10.1/a", "Retraction", 1), ("10.1/A", "erratum", 2), ("10.1/b", "withdrawal", 3)], "doi string, type string, ordinal int")
    assert {r.work_id: r.status for r in linkage.screen_retractions(works, notices).collect()} == {1: "AMENDED", 2: "INVALIDATED", 3: "CURRENT"}


def test_entities_resolve_with_their_tier(spark):
    rows = [(1, {"lei": "R1"}, "a", "x"), (2, {"lei": " r1", "site": "s"}, "b", "x"), (3, {"site": "S"}, "The B Ltd", "X"), (4, {}, "c", "x"), (5, {}, "c", "y"), (6, {"ror": "R2"}, "d", "x"), (7, {"ror": "R2"}, "e", "x"), (8, {}, "f", "x"), (9, {}, "f", "x"), (10, {}, "g", "x"), (11, {}, "g", "x")]
    entities = spark.createDataFrame([(f"{n:02d}", name, place, ids) for n, ids, name, place in rows], "node string, name string, jurisdiction string, identifiers map<string,string>")
    ties = spark.createDataFrame([("10", "99"), ("98", "08"), ("99", "11")], "a string, b string")
    found = graph.resolve_bodies(entities, ties)
    assert {r.node: r.root for r in found.collect()} == {"01": "01", "02": "01", "03": "01", "06": "06", "07": "06", "08": "08", "09": "08", "10": "10", "11": "10"}
    assert {r.root: r.tier for r in graph.merge_tiers(found, entities, ties).collect()} == {"01": "CORROBORATED_NAME", "06": "STRONG_IDENTIFIER", "08": "NAME_ONLY", "10": "CORROBORATED_NAME"}
    assert {r.node for r in graph.resolve_bodies(entities, ties, graph.STRONG).collect()} == {"01", "02", "06", "07"}
    assert {r.node for r in graph.resolve_bodies(entities, ties, graph.CORROBORATED).collect()} == {"01", "02", "03", "06", "07", "10", "11"}


def test_intensity_leaves_out_months_without_both(spark):
    child = spark.createDataFrame([("p", i, None if i == 2 else 1.0) for i in range(4)] + [("q", 0, 1.0)], "provider string, period int, value double")
    parent = spark.createDataFrame([("p", i, None if i == 3 else 4.0) for i in range(4)] + [("q", 0, 2.0)], "provider string, period int, value double")
    assert [tuple(r) for r in series.intensity(child, parent, 2).collect()] == [("p", 2, 0.25)]


def test_upper_median_is_the_upper_one(spark):
    rows = spark.createDataFrame([("a", v) for v in (4, 1, 3, 2)] + [("b", 7), ("b", None)], "g string, v int")
    assert {r.g: r.middle for r in series.upper_median(rows, "g", "v").collect()} == {"a": 3, "b": 7}


def test_strata_ratio_needs_shared_periods(spark):
    a = spark.createDataFrame([(i, 6.0) for i in range(3)], "period int, value double")
    b = spark.createDataFrame([(0, 3.0), (1, 0.0), (2, 2.0)], "period int, value double")
    assert series.strata_ratio(a, b).count() == 0
    assert sorted(tuple(r) for r in series.strata_ratio(a, b, 2).collect()) == [(0, 2.0), (2, 3.0)]


def test_power_rises_with_size_and_repeats(spark):
    designs = spark.createDataFrame([(1, 40, 0.3, 3.0, 0.5), (2, 400, 0.3, 3.0, 0.5), (3, 400, 0.3, 1.0, 0.5)], "design long, n int, baseline double, odds_ratio double, exposed double")
    one, two = ({r.design: r.power for r in series.selection_power(designs.repartition(k)).collect()} for k in (1, 3))
    assert one == two and one[1] < one[2] and one[3] < 0.1


def test_label_steps_cover_every_supplier(spark, tmp_path):
    from pyspark.sql import functions as F

    from veristrata.plans import registry

    rows = [(s, f"1995-{m:02d}-01", "A" if m < 6 else "N", 1) for s in (1, 7, 900) for m in range(1, 11) for _ in range(1 + (m > 5) * s % 3)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate string, l_returnflag string, l_quantity int").withColumn("l_shipdate", F.to_date("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.provider: (r.i, r.was, r.labels, r.step) for r in registry.Q["label_change_step_by_provider"](spark, str(tmp_path)).collect()}
    assert got == {1: (5, "A", "N", 2.0), 7: (5, "A", "N", 2.0), 900: (5, "A", "N", 1.0)}
