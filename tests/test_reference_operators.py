"""Small cases of the expression library and the operators."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from veristrata.functions import numbers as N
from veristrata.functions import text as T
from veristrata.operators import governance, graph, panel, stats, synthesis
from veristrata.sources import landed


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_authors_and_names(spark):
    rows = [("Okafor, Ngozi P.",), ("Ngozi P. Okafor",), ("Okafor N",), ("Okafor n.p.",), ("Okafor",), ("",)]
    assert values(spark, rows, T.normalise_author(F.col("x"))) == ["okafor,n", "okafor,n", "okafor,n", "n.p.,o", "okafor,", ""]
    assert values(spark, [("The Açme Trust, Ltd.",)], T.normalise_name(F.col("x"))) == ["açme"]
    assert values(spark, [(" HTTPS://doi.org/10.1/AB ",)], T.normalise_doi(F.col("x"))) == ["10.1/ab"]


def test_lanes_stop_at_the_first_with_a_hit(spark):
    rows = [("retracted, and replicated",), ("we replicated it",), ("nothing here",)]
    assert [tuple(v) for v in values(spark, rows, T.lane(F.col("x")))] == [("CORRECTION_RETRACTION", 0.65, 1), ("REPLICATION", 0.65, 1), ("UNCLASSIFIED", 0.0, 0)]


def test_cells_keep_missing_missing(spark):
    got = values(spark, [("7,650",), ("low",), ("n/k",), ("0",), (None,)], N.marked_cell(F.col("x")))
    assert [tuple(v) for v in got] == [(7650.0, None), (None, "low"), (None, "n/k"), (0.0, None), (None, ":")]
    assert values(spark, [("-1",), ("2",), ("N/A",)], N.indicator_cell(F.col("x"))) == [None, 2.0, None]
    assert values(spark, [("2005 - 09",), ("1997 - 01",), ("2016/17",), ("2014/15 - 18/19",), ("2011",)], N.span_years(F.col("x"))) == [5, 5, 1, 5, 1]
    for bad, rule in (("12%", N.published_cell), (" ", N.period_basis)):
        with pytest.raises(Exception, match="percentage|empty period"):
            values(spark, [(bad,)], rule(F.col("x")))


def frame(spark, cells):
    rows = [(p, date.fromisoformat(m + "-01"), v) for m, of in cells.items() for p, v in of.items()]
    return spark.createDataFrame(rows, "provider string, period date, value double")


def test_cohort_excludes_suppressed(spark):
    p = frame(spark, {"2020-01": {"A": 10.0, "B": 5.0}, "2020-02": {"A": 11.0, "B": None}, "2020-03": {"A": 12.0, "B": 6.0, "C": 100.0}})
    assert [r[0] for r in panel.continuous(p, "2020-01-01", "2020-03-01").collect()] == ["A"]
    assert sorted(r[0] for r in panel.joiners(p, "2020-01-01", "2020-03-01").collect()) == ["B", "C"]
    assert {str(r.period)[:7]: r.valued for r in panel.coverage(p).collect()} == {"2020-01": 2, "2020-02": 1, "2020-03": 3}
    with pytest.raises(ValueError):
        panel.n_months("2020-03-01", "2020-01-01")


def test_tertiles_leave_the_rest_to_the_last(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(8)], "key long, size double")
    assert [r.tertile for r in panel.tertiles(rows).orderBy("key").collect()] == [0, 0, 1, 1, 2, 2, 2, 2]


def test_constant_columns_are_refused_not_errors(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 3.0, 2.0), (1.0, 4.0, 3.0)], "x double, y double, z double")
    assert tuple(stats.rank_correlations(rows, "x", "y", "z").first()) == (3, None, None)


def test_kappa_of_agreement_is_one(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "a int, b int")
    assert stats.kappa(rows, "a", "b").first().kappa == 1.0


def test_families_are_transitive_and_order_free(spark):
    rows = [(1, "x", None), (2, "x", "k"), (3, None, "k"), (4, "z", None)]
    for order in (rows, rows[::-1]):
        got = graph.families(spark.createDataFrame(order, "id long, a string, b string"), "id", ["a", "b"])
        assert sorted(map(tuple, got.collect())) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1)]


def test_authority_and_upsert(spark):
    state = spark.createDataFrame([(1, "NOTE", 3, "old"), (2, "NOTE", 1, "old")], "id long, type string, level int, value string")
    patch = spark.createDataFrame([(1, "NOTE", 2, "new", True), (2, "NOTE", 1, "new", False), (3, "CONSENT_DECISION", 3, "new", False)], "id long, type string, level int, value string, human boolean")
    got = {r.id: (r.level, r.value, r.refused) for r in governance.apply_patches(state, patch).collect()}
    assert got == {1: (3, "old", "LOWER_AUTHORITY_OVERWRITE"), 2: (1, "new", None), 3: (None, None, "PROTECTED_TYPE_REQUIRES_HUMAN_AUTHORISATION")}
    a, b = (spark.createDataFrame([(1, o, v)], "k long, o long, v string") for o, v in ((1, "old"), (2, "new")))
    assert synthesis.upsert(a, b, ["k"], "o").first().v == "new"
    assert synthesis.first_wins(a.union(b), ["k"], "o").first().v == "old"


def test_chain_breaks_are_found(spark):
    rows = spark.createDataFrame([("j", k, f"t{k}", "E", '{"a":1}') for k in range(4)], "journal string, ordinal int, timestamp string, event_type string, payload string")
    whole = synthesis.append(rows, "journal")
    assert [tuple(r) for r in synthesis.verify(whole, "journal").collect()] == [("j", 4, True, None)]
    for hurt, first in ((whole.filter("sequence <> 2"), 3), (whole.withColumn("payload", F.when(F.col("sequence") == 3, "{}").otherwise(F.col("payload"))), 3), (whole.withColumn("previous_hash", F.lit("0" * 64)), 2)):
        assert [tuple(r)[2:] for r in synthesis.verify(hurt, "journal").collect()] == [(False, first)]


def test_paths_stars_and_trees_are_one_component(spark):
    path = [0, *range(199, 0, -1)]
    edges = [*zip(path[:-1], path[1:], strict=True), *((500, i) for i in range(300, 400)), (900, 900)]
    nodes = spark.createDataFrame([(i,) for i in [*range(200), *range(300, 400), 500, 900, 901]], "node long")
    for name, kind in ((lambda i: i, "long"), (lambda i: f"n{i:04d}", "string")):
        frame = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}").repartition(6, "b", "a")
        got = {r.node: r.root for r in graph.components(frame, spark.createDataFrame([(name(r.node),) for r in nodes.collect()], f"node {kind}")).collect()}
        assert got == {**{name(i): name(0) for i in range(200)}, **{name(i): name(300) for i in [*range(300, 400), 500]}, name(900): name(900), name(901): name(901)}


def test_verdicts_on_coupling(spark):
    def verdict(rows, known="ABCDEFG"):
        frame = spark.createDataFrame([(a, b, kind, family, date(2019, 1, 1) if early else date(2021, 1, 1), ok, i) for i, (a, b, kind, family, early, ok) in enumerate(rows)], "a string, b string, kind string, family string, valid_from date, admitted boolean, ordinal int")
        domains = spark.createDataFrame([(n, d) for n, d in zip(known, ["X", "Y", "X", "Y", "X", "UNKNOWN", "Z"], strict=True)], "node string, domain string")
        r = graph.assess_coupling(frame, domains, "2020-01-01").first()
        return r.verdict, r.discriminating

    chain = [("A", "B", "k1", "f1", True, True), ("B", "C", "k2", "f2", True, True), ("C", "D", "k1", "f1", True, True)]
    late = [("D", "E", "k1", "f1", False, True)]
    assert verdict([*chain, *late]) == ("MD15_COUPLING_SUPPORTED", True)
    assert verdict(chain) == ("MD15_COUPLING_SUPPORTED", False)
    assert verdict(chain[:2])[0] == "CENTRAL_COORDINATION_NOT_COUPLING"
    assert verdict(chain[:1] + late)[0] == "INSUFFICIENT_ADMITTED_RELATIONS"
    assert verdict([(a, b, k, "f1", e, ok) for a, b, k, _, e, ok in chain])[0] == "INSUFFICIENT_INDEPENDENT_SOURCES"
    assert verdict([(a, b, "k1", f, e, ok) for a, b, _, f, e, ok in chain])[0] == "MX09_ISOLATED_PROCESSES_BETTER"
    assert verdict([("A", "C", "k1", "f1", True, True), ("C", "E", "k2", "f2", True, True), ("E", "F", "k1", "f1", True, True)])[0] == "MX09_ISOLATED_PROCESSES_BETTER"
    assert verdict([(*r[:5], False) for r in chain])[0] == "INSUFFICIENT_ADMITTED_RELATIONS"


def test_landed_notices_and_awards(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"DOI": "10.1/n", "update-to": [{"DOI": "10.1/A", "type": "Retraction"}, {"DOI": "10.1/N", "type": "erratum"}]}\n')
    assert [tuple(r) for r in landed.notices(spark, str(tmp_path / "n.json")).collect()] == [("10.1/a", "10.1/n", "retraction", True)]
    (tmp_path / "a.json").write_text('{"ocid": "o", "buyer": {"id": "b"}, "awards": [{"id": "1", "date": "2020-02-01T00:00:00Z", "contractPeriod": {"startDate": "2020-01-01", "endDate": "2019-01-01"}, "suppliers": [{"id": "s"}]}]}\n')
    row = landed.awards(spark, str(tmp_path / "a.json")).first()
    assert (row.valid_from, row.valid_to, row.skipped) == (date(2020, 1, 1), None, None)


def test_micro_batches_drop_repeats(spark, tmp_path):
    from veristrata.streaming.micro_batch import ingest

    spark.sql("SELECT 1 AS id, timestamp'2024-01-01' AS ts UNION ALL SELECT 1, timestamp'2024-01-01' UNION ALL SELECT 2, timestamp'2024-01-01'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp").parquet(str(tmp_path / "in"))
    ingest(stream, lambda d: d.withColumn("twice", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "cp"), "id", "ts").awaitTermination(60)
    assert sorted(r.twice for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4]


def test_permutation_p_is_spearmans(spark):
    from itertools import permutations

    import numpy as np

    x, y = [1.0, 2.0, 3.0, 4.0, 4.0, 1000.0, 7.0], [3.0, 1.0, 2.0, 9.0, 5.0, 5.0, 4000.0]
    a, b = ([sum(w < v for w in c) + (sum(w == v for w in c) + 1) / 2 for v in c] for c in (x, y))
    a, b = np.array(a) - 4, np.array(b) - 4
    every = np.abs(np.array(list(permutations(b))) @ a)
    exact = (every >= abs(a @ b) - 1e-9).mean()
    rows = spark.createDataFrame(list(zip(x, y, strict=True)), "x double, y double")
    got = stats.permutation_p(rows, "x", "y", 20000, 7).first()
    assert got.n == 7 and got.r == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-12)
    assert abs(got.p - exact) < 5 * (exact * (1 - exact) / 20000) ** 0.5
    assert got == stats.permutation_p(rows, "x", "y", 20000, 7).first()
    none = stats.permutation_p(rows.limit(2), "x", "y", 100, 7).first()
    assert none.n == 2 and none.r != none.r
    assert stats.permutation_p(rows.limit(0), "x", "y", 100, 7).count() == 0
