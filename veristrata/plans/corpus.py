"""Registered queries over records, bodies, results and journals: gates, families, coupling, synthesis, feasibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import feasibility, graph, panel, series, synthesis
from ..operators import governance as G
from .registry import PANEL, RELATIONS_WHOLE, domains, provider_panel, query, relations, t

c = F.col


def text_of(k):
    return k.cast("string")


# ------------------------------------------------------------------ admission

ADMIT = "e AS (SELECT doc_id, text, source, lang, doc_id % 11 AS k, ['OPEN', 'LICENSED', 'PARTICIPANT_SECURE', 'TRE_SDE'][doc_id % 4 + 1] AS access FROM documents)"


@query(f"""WITH {ADMIT}, x AS (SELECT doc_id, 'EV-' || upper(substr(sha256(coalesce(source, '') || '|' || doc_id), 1, 20)) AS evidence_id, sha256(text) AS content_sha256,
list_filter([CASE WHEN k = 0 THEN 'SOURCE_STATUS_UNVERIFIED' END, CASE WHEN k = 1 THEN 'SOURCE_URI_MISSING' END, CASE WHEN k = 2 THEN 'CHECKSUM_MISSING' END,
 CASE WHEN access IN ('LICENSED', 'PARTICIPANT_SECURE') AND k < 6 THEN 'LICENCE_OR_APPROVAL_MISSING' END, CASE WHEN access = 'TRE_SDE' AND k < 6 THEN 'TRE_APPROVAL_MISSING' END,
 CASE WHEN access = 'TRE_SDE' AND k = 7 THEN 'TRE_RAW_PERSON_LEVEL_PAYLOAD_PROHIBITED' END, CASE WHEN source IS NULL THEN 'DEPENDENCY_FAMILY_MISSING' END,
 CASE WHEN k = 8 THEN 'SOURCE_WORK_RETRACTED' END, CASE WHEN k = 9 AND coalesce(text, '') <> '' THEN 'CONTENT_HASH_MISMATCH' END], lambda f: f IS NOT NULL) AS f FROM e)
SELECT doc_id, evidence_id, content_sha256, array_to_string(f, '|') AS failures, len(f) = 0 AS admitted FROM x""")
def evidence_admission(spark, sf_dir):
    """Documents as records; their numbers decide which of the gates' conditions they meet."""
    from ..functions.text import evidence_id

    d, k = t(spark, sf_dir, "documents"), c("doc_id") % 11
    access = F.get(F.array(*[F.lit(x) for x in ("OPEN", "LICENSED", "PARTICIPANT_SECURE", "TRE_SDE")]), (c("doc_id") % 4).cast("int"))
    own = F.sha2("text", 256)
    record = F.struct(
        F.when(k == 0, "UNVERIFIED").otherwise("VERIFIED").alias("source_status"), F.when(k != 1, "https://a.example/").alias("source_uri"), F.when(k == 2, "").otherwise(own).alias("checksum_sha256"), access.alias("access_class"),
        F.when(k >= 6, "ref").alias("licence_or_approval"), (k == 7).alias("raw_person_level"), c("source").alias("dependency_family"), (k == 8).alias("retracted"), c("text").alias("content"), F.when(k == 9, "0").otherwise(own).alias("content_sha256"),
    )
    bad = G.evidence_failures(record)
    key = evidence_id(F.coalesce("source", F.lit("")), c("doc_id").cast("string"))
    return d.select("doc_id", key.alias("evidence_id"), own.alias("content_sha256"), F.array_join(bad, "|").alias("failures"), (F.size(bad) == 0).alias("admitted"))


@query("""WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'ETHICS_DECISION' ELSE 'NOTE' END AS type, (c_custkey % 5)::INT AS level, 'old' AS value FROM customer WHERE c_custkey % 5 > 0),
p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'ETHICS_DECISION' WHEN c_custkey % 11 = 0 THEN 'PLAN' ELSE 'NOTE' END AS nt, (c_custkey % 6)::INT AS asked, c_custkey % 2 = 0 AS human FROM customer WHERE c_custkey % 3 > 0),
b AS (SELECT *, CASE WHEN asked IS NULL THEN NULL WHEN level IS NOT NULL AND type <> nt THEN 'OBJECT_TYPE_MISMATCH' WHEN level IS NOT NULL AND asked < level THEN 'LOWER_AUTHORITY_OVERWRITE'
 WHEN nt = 'ETHICS_DECISION' AND asked < 4 AND NOT human THEN 'PROTECTED_TYPE_REQUIRES_HUMAN_AUTHORISATION' END AS refused FROM s FULL JOIN p USING (id))
SELECT id, CASE WHEN type IS NOT NULL THEN type WHEN asked IS NOT NULL AND refused IS NULL THEN nt END AS type, CASE WHEN asked IS NOT NULL AND refused IS NULL THEN asked ELSE level END AS level,
CASE WHEN asked IS NOT NULL AND refused IS NULL THEN 'new' ELSE value END AS value, refused FROM b""")
def authority_lattice(spark, sf_dir):
    cust, k = t(spark, sf_dir, "customer"), c("c_custkey")
    guarded = F.when(k % 7 == 0, "ETHICS_DECISION")
    state = cust.filter(k % 5 > 0).select(k.alias("id"), guarded.otherwise("NOTE").alias("type"), (k % 5).cast("int").alias("level"), F.lit("old").alias("value"))
    patches = cust.filter(k % 3 > 0).select(k.alias("id"), guarded.when(k % 11 == 0, "PLAN").otherwise("NOTE").alias("type"), (k % 6).cast("int").alias("level"), F.lit("new").alias("value"), (k % 2 == 0).alias("human"))
    return G.apply_patches(state, patches)


# ------------------------------------------------------------------ families and bodies

STUDIES = r"""r AS (SELECT doc_id AS id, 'EV' || lpad(doc_id::VARCHAR, 8, '0') AS evidence_id, doc_id % 17 = 0 AS container, md5(coalesce(text, '')) AS dk,
 CASE WHEN doc_id % 6 = 0 THEN 'NCT' || lpad((doc_id % 300)::VARCHAR, 8, '0') END AS reg, CASE WHEN doc_id % 10 = 1 THEN 'GSE' || (1000 + doc_id % 110) END AS acc, CASE WHEN doc_id % 70 = 2 THEN 'elm cohort' END AS coh,
 list_sort(list_distinct(['okafor' || chr((97 + doc_id % 26)::INT) || ',n', 'ito' || chr((97 + doc_id % 25)::INT) || ',y', 'silva' || chr((97 + doc_id % 24)::INT) || ',a', 'extra' || chr((97 + doc_id % 7)::INT) || ',z'])) AS names FROM documents),
i AS (SELECT * FROM r WHERE NOT container),
k AS (SELECT evidence_id, 'SAME_DEDUP_KEY' AS signal, dk AS key FROM i UNION ALL SELECT evidence_id, 'SHARED_TRIAL_REGISTRATION', reg FROM i WHERE reg IS NOT NULL UNION ALL SELECT evidence_id, 'SHARED_DATASET_ACCESSION', acc FROM i WHERE acc IS NOT NULL UNION ALL SELECT evidence_id, 'SHARED_NAMED_COHORT', coh FROM i WHERE coh IS NOT NULL),
star AS (SELECT evidence_id AS a, min(evidence_id) OVER (PARTITION BY signal, key) AS b, signal FROM k),
au AS (SELECT x.evidence_id AS a, y.evidence_id AS b, 'AUTHOR_NETWORK_OVERLAP' AS signal FROM i x JOIN i y ON x.evidence_id < y.evidence_id AND len(list_intersect(x.names, y.names)) >= 2 AND len(list_intersect(x.names, y.names)) / len(list_distinct(x.names || y.names))::DOUBLE >= 0.6),
links AS (SELECT a, b, signal FROM star WHERE a <> b UNION SELECT a, b, signal FROM au),
e AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
lab(node, root) USING KEY (node) AS (SELECT evidence_id, evidence_id FROM i UNION SELECT e.y, min(lab.root) FROM lab JOIN e ON e.x = lab.node JOIN recurring.lab AS held ON held.node = e.y WHERE lab.root < held.root GROUP BY e.y),
m AS (SELECT root, string_agg(node, '|' ORDER BY node) AS members, count(*) AS size FROM lab GROUP BY 1),
sg AS (SELECT root, string_agg(DISTINCT signal, '|' ORDER BY signal) AS basis FROM (SELECT a AS node, signal FROM links UNION SELECT b, signal FROM links) JOIN lab USING (node) GROUP BY 1)
SELECT node AS evidence_id, 'family:' || substr(sha256(members), 1, 16) AS family, size::INT AS size, coalesce(basis, 'SINGLETON_NO_SIGNAL') AS basis FROM lab JOIN m USING (root) LEFT JOIN sg USING (root)
UNION ALL SELECT evidence_id, 'family:' || substr(sha256(evidence_id), 1, 16), 1::INT, 'CONTAINER_RECORD_NOT_A_STUDY' FROM r WHERE container"""


def study_records(spark, sf_dir):
    k = c("doc_id")
    say = lambda rule, *parts: F.when(rule, F.concat(*parts)).otherwise("")
    content = F.concat_ws(" ", say(k % 6 == 0, F.lit("see nct"), F.lpad(text_of(k % 300), 8, "0")), say(k % 10 == 1, F.lit("data GSE"), text_of(1000 + k % 110)), say(k % 70 == 2, F.lit("the Elm Cohort")))
    name = lambda stem, n, first: F.concat(F.lit(f"{stem}"), F.chr(97 + k % n), F.lit(f", {first}"))
    return t(spark, sf_dir, "documents").select(
        F.concat(F.lit("EV"), F.lpad(text_of(k), 8, "0")).alias("evidence_id"), F.when(k % 17 == 0, "Poster abstracts").otherwise("A study").alias("title"), content.alias("content"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("dedup_key"),
        F.array(name("Okafor", 26, "Ngozi"), name("Ito", 25, "Yu"), name("Silva", 24, "Ana"), name("Extra", 7, "Zoe")).alias("authors"),
    )


@query(f"WITH RECURSIVE {STUDIES}")
def study_families(spark, sf_dir):
    """Documents as records: equal texts share a key, their numbers give registrations, accessions, a cohort and authors."""
    return graph.study_families(study_records(spark, sf_dir), ["elm cohort"])


@query(f"WITH RECURSIVE f AS (WITH RECURSIVE {STUDIES}) SELECT basis, count(DISTINCT family) AS families, count(*) AS records, round(1 - count(DISTINCT family)::DOUBLE / count(*), 6) AS collapse_rate FROM f GROUP BY 1")
def family_basis_counts(spark, sf_dir):
    found = study_families(spark, sf_dir)
    return found.groupBy("basis").agg(F.countDistinct("family").alias("families"), F.count("*").alias("records"), F.round(1 - F.countDistinct("family") / F.count("*"), 6).alias("collapse_rate"))


BODIES = """ent AS (SELECT 'B' || lpad(c_custkey::VARCHAR, 8, '0') AS node, c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN ['companies_house:r' || (c_custkey % 400)] ELSE [] END || CASE WHEN c_custkey % 9 = 0 THEN ['lei:q' || (c_custkey % 63)] ELSE [] END AS strong,
 CASE WHEN c_custkey % 5 = 0 THEN ['website:w' || (c_custkey % 250)] ELSE [] END AS weak, 'body ' || (c_custkey % 50) || '|' || c_nationkey AS place FROM customer),
rel AS (SELECT 'B' || lpad(c_custkey::VARCHAR, 8, '0') AS node, 'F' || (c_custkey % 37) AS other FROM customer WHERE c_custkey % 3 = 0),
keys AS (SELECT node, unnest(strong) AS key FROM ent {names}),
star AS (SELECT node AS a, min(node) OVER (PARTITION BY key) AS b FROM keys), e AS (SELECT a AS x, b AS y FROM star WHERE a <> b UNION SELECT b, a FROM star WHERE a <> b),
lab(node, root) USING KEY (node) AS (SELECT node, node FROM ent UNION SELECT e.y, min(lab.root) FROM lab JOIN e ON e.x = lab.node JOIN recurring.lab AS held ON held.node = e.y WHERE lab.root < held.root GROUP BY e.y),
big AS (SELECT * FROM (SELECT node, root, count(*) OVER (PARTITION BY root) AS size FROM lab) WHERE size > 1)"""
BY_NAME = BODIES.format(names="UNION ALL SELECT node, place FROM ent")
BY_SIGNAL = BODIES.format(names="UNION ALL SELECT node, 'w' || place || w FROM (SELECT node, place, unnest(weak) AS w FROM ent) UNION ALL SELECT node, 'p' || place || other FROM ent JOIN rel USING (node)")


def bodies(spark, sf_dir):
    """Customers as bodies with strong and weak identifiers, every third in a relation with one of 37 others."""
    k = c("c_custkey")
    node = F.concat(F.lit("B"), F.lpad(text_of(k), 8, "0"))
    some = lambda rule, name, stem, n: F.when(rule, F.struct(F.lit(name).alias("key"), F.concat(F.lit(stem), text_of(k % n)).alias("value")))
    ids = F.map_from_entries(F.array_compact(F.array(some(k % 4 == 0, "companies_house", " R", 400), some(k % 9 == 0, "lei", "Q", 63), some(k % 5 == 0, "website", "W", 250))))
    cust = t(spark, sf_dir, "customer")
    entities = cust.select(node.alias("node"), F.concat(F.lit("The Body, "), text_of(k % 50), F.lit(" Ltd.")).alias("name"), text_of(c("c_nationkey")).alias("jurisdiction"), ids.alias("identifiers"))
    return entities, cust.filter(k % 3 == 0).select(node.alias("a"), F.concat(F.lit("F"), text_of(k % 37)).alias("b"))


@query(f"WITH RECURSIVE {BY_NAME} SELECT node, root, size FROM big")
def resolve_entities(spark, sf_dir):
    return graph.resolve_bodies(*bodies(spark, sf_dir))


@query(f"WITH RECURSIVE {BY_SIGNAL} SELECT node, root, size FROM big")
def resolve_corroborated(spark, sf_dir):
    return graph.resolve_bodies(*bodies(spark, sf_dir), least=graph.CORROBORATED)


@query(f"""WITH RECURSIVE {BY_NAME}, s AS (SELECT root FROM (SELECT root, any_value(size) AS size, key, count(DISTINCT node) AS n FROM (SELECT root, size, node, unnest(strong) AS key FROM big JOIN ent USING (node)) GROUP BY 1, 3) WHERE n = size),
w AS (SELECT root FROM (SELECT root, node, unnest(weak) AS key FROM big JOIN ent USING (node) UNION ALL SELECT root, node, other FROM big JOIN rel USING (node)) GROUP BY root, key HAVING count(DISTINCT node) > 1)
SELECT DISTINCT root, size, CASE WHEN root IN (SELECT root FROM s) THEN 'STRONG_IDENTIFIER' WHEN root IN (SELECT root FROM w) THEN 'CORROBORATED_NAME' ELSE 'NAME_ONLY' END AS tier FROM big""")
def merge_tiers(spark, sf_dir):
    entities, ties = bodies(spark, sf_dir)
    return graph.merge_tiers(graph.resolve_bodies(entities, ties), entities, ties)


# ------------------------------------------------------------------ coupling

COUPLING = """r AS (SELECT 'C' || o_custkey AS a, 'S' || l_suppkey AS b, o_orderpriority AS kind, o_orderstatus AS family, o_orderkey * 10 + l_linenumber AS ordinal, o_orderdate < DATE '2000-01-01' AS prior, l_returnflag <> 'A' AS admitted FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT * FROM r WHERE prior AND admitted),
k AS (SELECT a, b, arg_max(kind, ordinal) AS kind FROM p GROUP BY 1, 2), e AS (SELECT a AS x, b AS y FROM k UNION ALL SELECT b, a FROM k),
lab(node, root) USING KEY (node) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, min(lab.root) FROM lab JOIN e ON e.x = lab.node JOIN recurring.lab AS held ON held.node = e.y WHERE lab.root < held.root GROUP BY e.y),
dom AS (SELECT 'C' || c_custkey AS node, n_regionkey AS d FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'S' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT root, count(*) AS nodes, count(DISTINCT d) AS domains FROM lab LEFT JOIN dom USING (node) GROUP BY 1), g AS (SELECT root, count(*) AS edges, count(DISTINCT kind) AS kinds FROM k JOIN lab ON k.a = node GROUP BY 1),
c AS (SELECT root, nodes, domains, edges, kinds, nodes > 2 AND domains > 1 AND kinds > 1 AS diffusing FROM n JOIN g USING (root))"""


def ties(spark, sf_dir):
    rows = relations(spark, sf_dir, "true", "l_returnflag")
    return rows.withColumn("admitted", c("l_returnflag") != "A")


@query(f"WITH RECURSIVE {COUPLING} SELECT * FROM c")
def coupling_components(spark, sf_dir):
    return graph.coupling(ties(spark, sf_dir), domains(spark, sf_dir), "2000-01-01")


@query(f"WITH RECURSIVE {COUPLING} SELECT * FROM c ORDER BY nodes DESC, root LIMIT 5")
def components_topk(spark, sf_dir):
    return graph.top_components(coupling_components(spark, sf_dir))


@query(f"""WITH RECURSIVE {COUPLING}, o AS (SELECT count(*) FILTER (NOT admitted) AS excluded, count(*) FILTER (admitted) AS n_admitted FROM r), f AS (SELECT count(*) AS prior, count(DISTINCT family) AS families FROM p),
ends AS (SELECT a AS node FROM p UNION ALL SELECT b FROM p), m AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM ends GROUP BY node)), d AS (SELECT count(DISTINCT d) AS domains FROM ends JOIN dom USING (node)), z AS (SELECT count(*) AS components, bool_or(diffusing) AS diffusing FROM c),
v AS (SELECT *, CASE WHEN prior < 2 THEN 'INSUFFICIENT_ADMITTED_RELATIONS' WHEN families < 2 THEN 'INSUFFICIENT_INDEPENDENT_SOURCES' WHEN most = prior THEN 'CENTRAL_COORDINATION_NOT_COUPLING' WHEN domains < 2 OR NOT diffusing THEN 'MX09_ISOLATED_PROCESSES_BETTER' ELSE 'MD15_COUPLING_SUPPORTED' END AS verdict FROM o, f, m, d, z)
SELECT verdict, CASE verdict WHEN 'MD15_COUPLING_SUPPORTED' THEN 'LIMITED_CAUSAL_EVIDENCE' WHEN 'MX09_ISOLATED_PROCESSES_BETTER' THEN 'MODERATE_TRIANGULATED_CAUSAL_EVIDENCE' WHEN 'CENTRAL_COORDINATION_NOT_COUPLING' THEN 'ASSOCIATION_ONLY' ELSE 'DESCRIPTIVE_EVIDENCE_ONLY' END AS ceiling,
n_admitted, excluded, prior, families, domains, components, prior <= 0.9 * n_admitted AS discriminating FROM v""")
def coupling_verdict(spark, sf_dir):
    return graph.assess_coupling(ties(spark, sf_dir), domains(spark, sf_dir), "2000-01-01")


# ------------------------------------------------------------------ results

RESULTS = """res AS (SELECT o_orderkey AS result_id, o_custkey AS proposition_id, o_orderpriority AS construct, CASE o_orderstatus WHEN 'F' THEN 'SUPPORTS' WHEN 'O' THEN 'WEAKENS' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'FALSIFIES' ELSE 'MIXED' END END AS direction FROM orders)"""


def results(spark, sf_dir):
    direction = F.when(c("o_orderstatus") == "F", "SUPPORTS").when(c("o_orderstatus") == "O", "WEAKENS").when(c("o_orderkey") % 2 == 0, "FALSIFIES").otherwise("MIXED")
    name = F.when(c("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority")))
    same = [F.lit("all").alias(x) for x in ("population", "period", "jurisdiction", "estimand")]
    return t(spark, sf_dir, "orders").select(c("o_orderkey").alias("result_id"), c("o_custkey").alias("proposition_id"), name.alias("construct"), *same, direction.alias("direction"))


@query(f"""WITH {RESULTS} SELECT x.result_id, y.result_id AS other_id FROM res x JOIN res y ON x.proposition_id = y.proposition_id AND x.construct = y.construct AND x.result_id < y.result_id
AND ((x.direction = 'SUPPORTS' AND y.direction IN ('WEAKENS', 'FALSIFIES')) OR (x.direction IN ('WEAKENS', 'FALSIFIES') AND y.direction = 'SUPPORTS'))""")
def contradictions(spark, sf_dir):
    return synthesis.contradictions(results(spark, sf_dir))


SYNTHESIS = """c AS (SELECT o_orderpriority AS run_id, o_orderkey AS ordinal, ['INTRINSIC_RECOGNITION', 'ASCERTAINMENT_SERVICE', 'MIXTURE_HETEROGENEITY', 'NULL_OR_ALTERNATIVE'][o_orderkey % 4 + 1] AS model, CASE WHEN o_orderkey % 5 = 0 THEN ['result:' || o_orderkey] WHEN o_orderkey % 3 = 0 THEN ['f' || (o_custkey % 40), 'g' || (o_custkey % 7)] ELSE ['f' || (o_custkey % 40)] END AS fams,
 (o_orderkey % 201 - 100) / 100.0::DOUBLE AS impact, 0.5::DOUBLE + (o_orderkey % 3) * 0.25::DOUBLE AS weight FROM orders),
p AS (SELECT run_id, ordinal, model, impact, weight / len(fams) AS share, unnest(fams) AS family FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id, model, family ORDER BY abs(impact * share) DESC, ordinal) AS k FROM p),
i AS (SELECT run_id, model, count(*) AS families, sum(impact * share) / sum(share) AS x FROM f WHERE k = 1 GROUP BY 1, 2),
every AS (SELECT DISTINCT run_id, unnest(['INTRINSIC_RECOGNITION', 'MULTIFACTORIAL_DEVELOPMENTAL_INSTITUTIONAL', 'ASCERTAINMENT_SERVICE', 'MIXTURE_HETEROGENEITY', 'NULL_OR_ALTERNATIVE']) AS model FROM c),
v AS (SELECT run_id, model, coalesce(families, 0) AS families, round(coalesce(x, 0), 6) AS index FROM every LEFT JOIN i USING (run_id, model)),
l AS (SELECT *, index >= max(index) OVER (PARTITION BY run_id) - 0.05::DOUBLE AS leading FROM v)"""


@query(f"WITH {SYNTHESIS} SELECT * FROM l")
def comparative_synthesis(spark, sf_dir):
    """Orders as results of the run that their priority names."""
    k = c("o_orderkey")
    model = F.get(F.array(*[F.lit(x) for x in ("INTRINSIC_RECOGNITION", "ASCERTAINMENT_SERVICE", "MIXTURE_HETEROGENEITY", "NULL_OR_ALTERNATIVE")]), (k % 4).cast("int"))
    f, g = F.concat(F.lit("f"), text_of(c("o_custkey") % 40)), F.concat(F.lit("g"), text_of(c("o_custkey") % 7))
    fams = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array(f, g)).otherwise(F.array(f))
    rows = t(spark, sf_dir, "orders").select(c("o_orderpriority").alias("run_id"), k.alias("result_id"), k.alias("ordinal"), (0.5 + (k % 3) * 0.25).alias("weight"), fams.alias("families"), F.create_map(model, (k % 201 - 100) / 100).alias("impacts"))
    return synthesis.indices(rows)


@query(f"""WITH {SYNTHESIS} SELECT run_id, string_agg(model, '|' ORDER BY model) FILTER (l."leading") AS "leading", 'COMPARATIVE_SUPPORT_INDEX_IS_NOT_A_TRUTH_PROBABILITY|MODEL_AGREEMENT_HAS_ZERO_EVIDENTIAL_WEIGHT' || CASE WHEN run_id < '3' THEN '|UNRESOLVED_SUBSTANTIVE_CONTRADICTION' ELSE '' END
|| CASE WHEN max(abs(index)) < 0.05 THEN '|EVIDENCE_DOES_NOT_DISCRIMINATE_BETWEEN_MODELS' ELSE '' END AS warnings FROM l GROUP BY 1""")
def synthesis_warnings(spark, sf_dir):
    found = comparative_synthesis(spark, sf_dir)
    told = found.select("run_id", F.when(c("run_id") < "3", 2).otherwise(0).alias("contradictions")).distinct()
    return synthesis.synthesis_warnings(found, told).select("run_id", F.array_join("leading", "|").alias("leading"), F.array_join("warnings", "|").alias("warnings"))


@query(f"""SELECT o_orderpriority AS run_id, {", ".join(f"min((o_orderkey * {i + 3} % 97) / 97.0::DOUBLE) AS {n}" for i, n in enumerate(N.CERTAINTY))} FROM orders GROUP BY 1""")
def run_certainty(spark, sf_dir):
    dims = [((c("o_orderkey") * (i + 3) % 97) / 97).alias(n) for i, n in enumerate(N.CERTAINTY)]
    return synthesis.least_certainty(t(spark, sf_dir, "orders").select(c("o_orderpriority").alias("run_id"), *dims), N.CERTAINTY)


# ------------------------------------------------------------------ journals

JOURNAL = """b AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS sequence, 'T' || turn AS ts, coalesce(role, '') AS event, '{"sha":"' || sha256(coalesce(text, '')) || '"}' AS payload FROM conversations),
j AS (SELECT conv_id, sequence, ts, event, payload, repeat('0', 64) AS previous_hash, sha256('{"event_type":"' || event || '","payload":' || payload || ',"previous_hash":"' || repeat('0', 64) || '","sequence":' || sequence || ',"timestamp":"' || ts || '"}') AS entry_hash FROM b WHERE sequence = 1
 UNION ALL SELECT b.conv_id, b.sequence, b.ts, b.event, b.payload, j.entry_hash, sha256('{"event_type":"' || b.event || '","payload":' || b.payload || ',"previous_hash":"' || j.entry_hash || '","sequence":' || b.sequence || ',"timestamp":"' || b.ts || '"}') FROM j JOIN b ON b.conv_id = j.conv_id AND b.sequence = j.sequence + 1)"""


def journal(spark, sf_dir):
    """Conversations as journals, their turns as entries."""
    payload = F.concat(F.lit('{"sha":"'), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit('"}'))
    rows = t(spark, sf_dir, "conversations").select("conv_id", c("turn").alias("ordinal"), F.concat(F.lit("T"), text_of(c("turn"))).alias("timestamp"), F.coalesce("role", F.lit("")).alias("event_type"), payload.alias("payload"))
    return synthesis.append(rows, "conv_id")


@query(f"WITH RECURSIVE {JOURNAL} SELECT conv_id, sequence, previous_hash, entry_hash FROM j")
def journal_append(spark, sf_dir):
    return journal(spark, sf_dir).select("conv_id", "sequence", "previous_hash", "entry_hash")


@query(f"""WITH RECURSIVE {JOURNAL}, n AS (SELECT conv_id, max(sequence) AS last FROM j GROUP BY 1),
k AS (SELECT conv_id, last, CASE WHEN conv_id % 4 = 1 AND last >= 2 THEN 2 WHEN conv_id % 4 = 2 AND last >= 2 THEN 1 WHEN conv_id % 4 = 3 THEN last END AS bad, CASE WHEN conv_id % 4 = 2 AND last >= 2 THEN last - 1 ELSE last END AS entries FROM n)
SELECT conv_id, entries, bad IS NULL AS verified, CASE WHEN conv_id % 4 = 2 AND last >= 2 THEN 2 ELSE bad END::INT AS first_bad FROM k""")
def journal_chain_verify(spark, sf_dir):
    """Of four journals, one is left alone, one has its second entry's payload changed, one lost its first entry, one its last entry's hash."""
    rows, k = journal(spark, sf_dir), c("conv_id") % 4
    last = rows.groupBy("conv_id").agg(F.max("sequence").alias("last"))
    hurt = rows.join(last, "conv_id").filter(~((k == 2) & (c("sequence") == 1) & (c("last") >= 2)))
    payload = F.when((k == 1) & (c("sequence") == 2), F.lit("{}")).otherwise(c("payload"))
    own = F.when((k == 3) & (c("sequence") == c("last")), F.lit("0")).otherwise(c("entry_hash"))
    return synthesis.verify(hurt.withColumns({"payload": payload, "entry_hash": own}), "conv_id")


# ------------------------------------------------------------------ feasibility

NEEDS = """w AS (SELECT * FROM (VALUES ('W1', 'OPEN_API; LICENSED', true, false, []), ('W2', 'LICENSED', false, false, ['ADOPTION_OUTCOME_PER_NODE']), ('W3', 'PRIMARY_RESEARCH', false, true, []), ('W4', 'PUBLIC_WEB, PRIMARY_RESEARCH', true, true, ['AWARENESS_OR_MEDIA_ATTENTION'])) v(id, access, is_open, hand, carried)),
p AS (SELECT c_custkey AS proposition_id, c_mktsegment AS model_family, [['W1'], ['W1', 'W4'], ['W2', 'W1'], ['W3', 'W2'], ['W9'], []][c_custkey % 6 + 1] AS ids, CASE WHEN c_custkey % 7 = 0 THEN ['AWARENESS_OR_MEDIA_ATTENTION', 'ADOPTION_OUTCOME_PER_NODE'] ELSE [] END AS named, c_custkey % 11 = 0 AS individual FROM customer),
a AS (SELECT proposition_id, unnest(ids) AS id FROM p), m AS (SELECT proposition_id, string_agg(id, ';' ORDER BY id) FILTER (NOT coalesce(is_open, false) AND coalesce(hand, false)) AS hand, string_agg(id, ';' ORDER BY id) FILTER (NOT coalesce(is_open, false) AND NOT coalesce(hand, false)) AS blocked, flatten(list(coalesce(carried, []))) AS carried FROM a LEFT JOIN w USING (id) GROUP BY 1),
q AS (SELECT proposition_id, model_family, hand, blocked, individual, list_filter(named, lambda x: NOT list_contains(coalesce(carried, []), x)) AS missing FROM p LEFT JOIN m USING (proposition_id)),
z AS (SELECT proposition_id, model_family, CASE WHEN hand IS NOT NULL THEN 'NEEDS_PRIMARY_COLLECTION' WHEN blocked IS NOT NULL THEN 'NEEDS_RESTRICTED_ACCESS' WHEN individual THEN 'NEEDS_INDIVIDUAL_LEVEL' WHEN len(missing) > 0 THEN 'NEEDS_PREDICTOR_SOURCE' ELSE 'OPEN_TESTABLE' END AS reachability, coalesce(blocked, hand, '') AS blocking, array_to_string(missing, ';') AS missing_predictors FROM q)"""


@query(f"WITH {NEEDS} SELECT * FROM z")
def feasibility_census(spark, sf_dir):
    """Customers as propositions over four workstreams and one that is not registered."""
    k = c("c_custkey")
    asked = F.get(F.array(*[F.lit(x) for x in ("W1", "W1; W4", "W2,W1", "W3;W2", " W9 ", "")]), (k % 6).cast("int"))
    said = F.when(k % 7 == 0, "Awareness predicts adoption").otherwise("It grows")
    when = F.when(k % 11 == 0, "longitudinal; exposure must precede outcome").otherwise("none")
    streams = spark.createDataFrame([("W1", "OPEN_API; LICENSED", "counts"), ("W2", "LICENSED", "Uptake by site"), ("W3", "PRIMARY_RESEARCH", "none"), ("W4", "PUBLIC_WEB, PRIMARY_RESEARCH", "news corpora")], "workstream_id string, access string, data string")
    return feasibility.census(t(spark, sf_dir, "customer").select(k.alias("proposition_id"), c("c_mktsegment").alias("model_family"), asked.alias("required"), said.alias("prediction"), when.alias("temporal")), streams)


@query(f"WITH {NEEDS} SELECT reachability, count(*) AS n FROM z GROUP BY 1")
def feasibility_counts(spark, sf_dir):
    return feasibility.counts(feasibility_census(spark, sf_dir))


@query(f"WITH {NEEDS}, b AS (SELECT model_family, count(*) FILTER (reachability = 'OPEN_TESTABLE') AS testable, count(*) AS propositions FROM z GROUP BY 1) SELECT *, testable > 0.5 * sum(testable) OVER () AS dominates FROM b")
def feasibility_asymmetry(spark, sf_dir):
    return feasibility.asymmetry(feasibility_census(spark, sf_dir))


@query("""WITH w AS (SELECT n_nationkey AS workstream_id, unnest(['S' || (n_nationkey % 5), 'S' || (n_nationkey % 7)]) AS s FROM nation), d AS (SELECT DISTINCT * FROM w)
SELECT workstream_id, string_agg(s, ';' ORDER BY s) AS declared, coalesce(string_agg(s, ';' ORDER BY s) FILTER (s IN ('S0', 'S1', 'S2')), '') AS with_connector, coalesce(string_agg(s, ';' ORDER BY s) FILTER (s IN ('S1', 'S6')), '') AS with_records, coalesce(string_agg(s, ';' ORDER BY s) FILTER (s NOT IN ('S0', 'S1', 'S2')), '') AS unknown FROM d GROUP BY 1""")
def source_coverage(spark, sf_dir):
    k = c("n_nationkey")
    streams = t(spark, sf_dir, "nation").select(k.alias("workstream_id"), F.concat(F.lit("S"), text_of(k % 5), F.lit("; S"), text_of(k % 7)).alias("source_ids"))
    known = spark.createDataFrame([("S0",), ("S1",), ("S2",), ("UNREGISTERED:S3",)], "source_id string")
    return feasibility.source_coverage(streams, known, spark.createDataFrame([("S1",), ("S6",)], "source_id string"))


# ------------------------------------------------------------------ series and corpora


@query(f"""WITH {PANEL}, s AS (SELECT provider AS name, CASE WHEN provider % 4 = 1 THEN 7.0::DOUBLE WHEN provider % 4 = 2 THEN coalesce(value, 0) WHEN provider % 4 = 3 THEN value ELSE coalesce(value, 1) END AS value, provider % 4 = 2 AS same FROM panel)
SELECT name, count(*) AS n, CASE WHEN count(value) < count(*) THEN 'missing value present' WHEN min(value) = max(value) THEN 'constant value 7.0 in all ' || count(*) || ' periods - index, not trend' WHEN bool_and(same) THEN 'count == denominator in every period - index, not trend' END AS reason FROM s GROUP BY 1""")
def index_not_trend(spark, sf_dir):
    """Providers as series: of four, one is constant, one has its denominator as count, one keeps its missing cells."""
    k = c("provider") % 4
    value = F.when(k == 1, 7.0).when(k == 2, F.coalesce("value", F.lit(0.0))).when(k == 3, c("value")).otherwise(F.coalesce("value", F.lit(1.0)))
    rows = provider_panel(spark, sf_dir).select(c("provider").alias("name"), value.alias("value"), F.lit(3).alias("count"), F.when(k == 2, 3).alias("denominator"))
    return panel.index_reasons(rows)


EVIDENCE = """ev AS (SELECT doc_id, doc_id % 9 > 0 AS admitted, coalesce(source, '') || (doc_id % 50) AS family, CASE WHEN doc_id % 13 = 0 THEN 'CORRECTION_RETRACTION' ELSE 'SUPPORT' END AS lane, CASE WHEN doc_id % 3 = 0 THEN 'Registration' WHEN doc_id % 3 = 1 THEN 'publication' END AS kind, lang AS orientation, doc_id % 2 = 0 AS published, doc_id % 10 = 3 AS linked, doc_id % 31 = 0 AS retracted, doc_id % 37 = 0 AS updated FROM documents)"""


def corpus(spark, sf_dir):
    k = c("doc_id")
    return t(spark, sf_dir, "documents").select(
        (k % 9 > 0).alias("admitted"), F.concat(F.coalesce("source", F.lit("")), text_of(k % 50)).alias("family"), F.when(k % 13 == 0, "CORRECTION_RETRACTION").otherwise("SUPPORT").alias("lane"), F.when(k % 3 == 0, "Registration").when(k % 3 == 1, "publication").alias("kind"),
        c("lang").alias("orientation"), (k % 2 == 0).alias("published"), F.when(k % 10 == 3, "NCT1").alias("linked"), (k % 31 == 0).alias("retracted"), F.when(k % 37 == 0, "10.1/x").alias("updates"),
    )


@query(f"""WITH {EVIDENCE} SELECT (SELECT count(*) FROM ev) AS raw_records, count(*) AS admitted_records, count(DISTINCT family) AS independent_families, count(*) FILTER (kind = 'Registration') AS registrations, count(*) FILTER (coalesce(kind, '') <> 'Registration') AS publications,
count(*) FILTER (coalesce(kind, '') <> 'Registration' AND linked) AS linked_publications, count(*) FILTER (lane = 'CORRECTION_RETRACTION' OR retracted OR updated) AS corrections FROM ev WHERE admitted""")
def kernel_metrics(spark, sf_dir):
    return series.corpus_metrics(corpus(spark, sf_dir))


@query(f"WITH {EVIDENCE} SELECT coalesce(orientation, 'NOT_ASSESSABLE') AS orientation, count(*) AS n, count(*) FILTER (published) AS done, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (published)::DOUBLE / count(*), 6) END AS rate FROM ev WHERE admitted AND kind = 'Registration' GROUP BY 1")
def publication_rates(spark, sf_dir):
    return series.publication_rates(corpus(spark, sf_dir))
