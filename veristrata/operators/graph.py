"""Components, families of studies, resolution of bodies and coupling over edge tables."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as T


#: Links that a task takes together when it replaces them by a forest.
AT_ONCE = 2_000_000
_written: list[tuple[SparkSession, str]] = []


def _delete() -> None:
    for spark, path in _written:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended already
            return


atexit.register(_delete)


def staged(df: DataFrame) -> DataFrame:
    """df as a table written to the folder that the session shares: its lineage is cut, and lost executors do no harm.

    The folder is the checkpoint folder that the session names, else the warehouse, or on one machine a folder of its own.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local["):
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.veristrata"
    if not where:
        import tempfile

        where = getattr(spark, "_veristrata_core", None) or tempfile.mkdtemp(prefix="veristrata-")
        spark._veristrata_core = where
    path = f"{where.rstrip('/')}/veristrata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forest(edges: DataFrame) -> DataFrame:
    """(a, b) pairs with the same components: within each task, links (node, least node it reaches there)."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            both = pa.Table.from_batches(held)
            coded = pa.chunked_array([*both["a"].chunks, *both["b"].chunks]).combine_chunks().dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at, names = place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))
            root = _roots(at[: len(at) // 2], at[len(at) // 2 :], len(order))
            own = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), names.take(pa.array(root[own]))], ["a", "b"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= AT_ONCE:
                yield from done()
                held, size = [], 0
        if size:
            yield from done()

    return edges.select("a", "b").filter("a <> b").mapInArrow(run, f"a {kind}, b {kind}")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links a[i]-b[i] between 0..n-1: the least index of each one's component."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over (a, b); a node without an edge is its own root.

    The graph is contracted round by round. A task first replaces its links by stars with the same
    components. Then each linked node takes its least neighbour as its parent and that
    one's parents twice over, and links between different parents are the next graph. Least is
    by name and in every second round by a hash of the round, so on average at most half of the
    nodes are left after it, whatever their names, and the rounds grow with the logarithm of
    their number. Minima are taken map-side and joins can split a hub's rows. Each round is
    written; the driver only learns if links are left.
    """
    links = staged(forest(edges))
    labels, turn = None, 0
    while links.limit(1).count():
        rank = lambda c, salt=turn: F.struct((F.xxhash64(F.col(c), F.lit(salt)) if salt % 2 else F.col(c)).alias("h"), F.col(c).alias("n"))
        near = links.union(links.select("b", "a")).groupBy("a").agg(F.min(rank("b")).alias("near"))
        up = staged(near.select(F.col("a").alias("node"), F.least("near", rank("a"))["n"].alias("up")))
        for _ in range(2):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up").select("node", F.col("top").alias("up"))
        up = staged(up)
        both = links.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        links = staged(forest(both.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()))
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            labels = staged(labels.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        turn += 1
    if labels is None:
        return nodes.select("node", F.col("node").alias("root"))
    least = staged(labels.groupBy("root").agg(F.min("node").alias("least")))
    named = labels.join(least, "root").select(F.col("node").alias("own"), "least")
    return staged(nodes.join(named, F.col("node") == F.col("own"), "left").select("node", F.coalesce("least", "node").alias("root")))


def exact_key_edges(rows: DataFrame, node: str, key: str) -> DataFrame:
    """Links of every node to the least node with the same key: a star, not all pairs."""
    keyed = rows.filter(F.col(key).isNotNull()).select(F.col(node).alias("a"), F.col(key).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.min("a").alias("b")), "k").select("a", "b")


def with_size(labels: DataFrame) -> DataFrame:
    return labels.join(labels.groupBy("root").agg(F.count("*").alias("size")), "root").select("node", "root", "size")


def families(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """node, root and family size: rows that share any of the keys, transitively."""
    edges = None
    for k in keys:
        found = exact_key_edges(rows, node, k)
        edges = found if edges is None else edges.union(found)
    return with_size(components(edges, rows.select(F.col(node).alias("node")).distinct()))


# ---------------------------------------------------------------- families of studies

SIGNALS = ["SAME_DEDUP_KEY", "SHARED_TRIAL_REGISTRATION", "SHARED_DATASET_ACCESSION", "SHARED_NAMED_COHORT"]


def study_families(records: DataFrame, lexicon: list[str] = (), shared: int = 2, jaccard: float = 0.6) -> DataFrame:
    """(evidence_id, title, content, dedup_key, authors) to (evidence_id, family, size, basis).

    Records are one family if they share a key, a registration, an accession or a named cohort, or
    if their author sets overlap in at least `shared` names and `jaccard`; transitively. Records
    that only hold others stay alone. basis: the sorted signals that link any of the family's records.
    """
    text = F.concat_ws(" ", "title", "content")
    held = records.select("evidence_id", T.is_container(F.col("title"), F.col("content")).alias("container"), F.col("dedup_key"), text.alias("text"), "title", "content", T.author_keys(F.coalesce("authors", F.array().cast("array<string>"))).alias("names"))
    held = staged(held)
    items = held.filter("not container")
    keys = {
        "SAME_DEDUP_KEY": F.array("dedup_key"),
        "SHARED_TRIAL_REGISTRATION": T.registrations(F.col("text")),
        "SHARED_DATASET_ACCESSION": I.accessions(F.col("text")),
        "SHARED_NAMED_COHORT": I.cohorts(F.col("title"), F.col("content"), list(lexicon)),
    }
    told = items.select("evidence_id", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), k.alias("keys")) for s, k in keys.items()])).alias("s"))
    told = told.select("evidence_id", "s.signal", F.explode("s.keys").alias("key"))
    stars = told.join(told.groupBy("signal", "key").agg(F.min("evidence_id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n"), ["signal", "key"]).select(F.col("evidence_id").alias("a"), "b", "signal")
    links = staged(stars.union(_author_links(items, shared, jaccard)).filter("a <> b").distinct())
    parts = components(links.select("a", "b"), items.select(F.col("evidence_id").alias("node")))
    ends = links.select(F.col("a").alias("node"), "signal").union(links.select(F.col("b").alias("node"), "signal"))
    basis = parts.join(ends, "node").groupBy("root").agg(F.array_sort(F.collect_set("signal")).alias("basis"))
    members = parts.groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("members"))
    named = members.join(basis, "root", "left").select("root", T.family_key(F.col("members")).alias("family"), F.size("members").alias("size"), F.coalesce("basis", F.array(F.lit("SINGLETON_NO_SIGNAL"))).alias("basis"))
    found = parts.join(named, "root").select(F.col("node").alias("evidence_id"), "family", "size", F.array_join("basis", "|").alias("basis"))
    alone = held.filter("container").select("evidence_id", T.family_key(F.array("evidence_id")).alias("family"), F.lit(1).alias("size"), F.lit("CONTAINER_RECORD_NOT_A_STUDY").alias("basis"))
    return found.union(alone)


def _author_links(items: DataFrame, shared: int, jaccard: float) -> DataFrame:
    """Links of records with overlapping author sets. Equal sets are one; different ones meet on two names at once, so a name that many have brings no pairs by itself."""
    sets = items.filter(F.size("names") >= shared).groupBy("names").agg(F.min("evidence_id").alias("node"))
    equal = items.join(sets, "names").select(F.col("evidence_id").alias("a"), F.col("node").alias("b"))
    first = F.transform("names", lambda x, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda y: F.concat(x, F.lit("&"), y)))
    by_pair = sets.select("node", "names", F.explode(F.flatten(first)).alias("pair"))
    other = by_pair.select(F.col("node").alias("node_b"), F.col("names").alias("names_b"), "pair")
    met = by_pair.join(other, "pair").filter("node < node_b").dropDuplicates(["node", "node_b"])
    both = F.size(F.array_intersect("names", "names_b"))
    near = met.filter((both >= shared) & (both / F.size(F.array_union("names", "names_b")) >= jaccard))
    return equal.union(near.select("node", "node_b")).select("a", "b", F.lit("AUTHOR_NETWORK_OVERLAP").alias("signal"))


# ---------------------------------------------------------------- bodies

STRONG, CORROBORATED, NAME = "STRONG_IDENTIFIER", "CORROBORATED_NAME", "NAME_ONLY"


def counterparties(relations: DataFrame) -> DataFrame:
    """(node, other): the bodies that a body has relations with."""
    return relations.select(F.col("a").alias("node"), F.col("b").alias("other")).union(relations.select("b", "a")).distinct()


def resolve_bodies(entities: DataFrame, relations: DataFrame, least: str = NAME) -> DataFrame:
    """(node, name, jurisdiction, identifiers) and (a, b) to (node, root, size) of bodies found more than once.

    A shared strong identifier always links. Down to NAME_ONLY a shared name in one jurisdiction
    does; at CORROBORATED_NAME it must share a weak identifier or a counterparty as well.
    """
    e = entities.select("node", F.concat_ws("|", T.normalise_name(F.col("name")), F.lower("jurisdiction")).alias("place"), I.strong_identifiers(F.col("identifiers")).alias("strong"), I.weak_identifiers(F.col("identifiers")).alias("weak"))
    edges = exact_key_edges(e.select("node", F.explode("strong").alias("k")), "node", "k")
    if least == NAME:
        edges = edges.union(exact_key_edges(e, "node", "place"))
    if least == CORROBORATED:
        weak = e.select("node", F.explode("weak").alias("w"), "place").select("node", F.concat_ws("|", F.lit("w"), "place", "w").alias("k"))
        party = e.join(counterparties(relations), "node").select("node", F.concat_ws("|", F.lit("p"), "place", "other").alias("k"))
        edges = edges.union(exact_key_edges(weak.union(party), "node", "k"))
    return with_size(components(edges, entities.select("node").distinct())).filter("size > 1")


def merge_tiers(resolved: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(root, size, tier): STRONG if one identifier is all members', CORROBORATED if any two share a weak one or a counterparty."""
    e = entities.select("node", I.strong_identifiers(F.col("identifiers")).alias("strong"), I.weak_identifiers(F.col("identifiers")).alias("weak"))
    m = resolved.join(e, "node")
    strong = m.select("root", "size", "node", F.explode("strong").alias("k")).groupBy("root", "size", "k").agg(F.countDistinct("node").alias("n")).filter("n = size").select("root", F.lit(True).alias("strong")).distinct()
    signs = m.select("root", "node", F.explode("weak").alias("k")).union(m.select("root", "node").join(counterparties(relations), "node").select("root", "node", F.concat(F.lit("party|"), F.col("other"))))
    near = signs.groupBy("root", "k").agg(F.countDistinct("node").alias("n")).filter("n > 1").select("root", F.lit(True).alias("near")).distinct()
    tier = F.when(F.col("strong"), STRONG).when(F.col("near"), CORROBORATED).otherwise(NAME)
    return m.select("root", "size").distinct().join(strong, "root", "left").join(near, "root", "left").select("root", "size", tier.alias("tier"))


# ---------------------------------------------------------------- coupling


def prior_pairs(relations: DataFrame, outcome: str) -> DataFrame:
    """(a, b, kind): admitted pairs dated before the outcome; a later relation of a pair overwrites its kind."""
    prior = relations.filter(F.col("admitted") & (F.col("valid_from") < F.to_date(F.lit(outcome))))
    pairs = prior.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", "ordinal")
    return staged(pairs.groupBy("a", "b").agg(F.max_by("kind", "ordinal").alias("kind")))


def component_detail(pairs: DataFrame, domains: DataFrame) -> DataFrame:
    """(root, nodes, domains, edges, kinds, diffusing): a component carries influence if it ties more than two bodies of
    more than one known domain by more than one kind of relation."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    labels = components(pairs.select("a", "b"), nodes)
    by_node = labels.join(domains, "node", "left").groupBy("root").agg(F.count("*").alias("nodes"), F.countDistinct(F.when(F.col("domain") != "UNKNOWN", F.col("domain"))).alias("domains"))
    by_edge = pairs.join(labels, F.col("a") == F.col("node")).groupBy("root").agg(F.count("*").alias("edges"), F.countDistinct("kind").alias("kinds"))
    diffusing = (F.col("nodes") > 2) & (F.col("domains") > 1) & (F.col("kinds") > 1)
    return by_node.join(by_edge, "root").select("root", "nodes", "domains", "edges", "kinds", diffusing.alias("diffusing"))


def coupling(relations: DataFrame, domains: DataFrame, outcome: str) -> DataFrame:
    return component_detail(prior_pairs(relations, outcome), domains)


VERDICTS = [
    ("INSUFFICIENT_ADMITTED_RELATIONS", "DESCRIPTIVE_EVIDENCE_ONLY"),
    ("INSUFFICIENT_INDEPENDENT_SOURCES", "DESCRIPTIVE_EVIDENCE_ONLY"),
    ("CENTRAL_COORDINATION_NOT_COUPLING", "ASSOCIATION_ONLY"),
    ("MX09_ISOLATED_PROCESSES_BETTER", "MODERATE_TRIANGULATED_CAUSAL_EVIDENCE"),
    ("MD15_COUPLING_SUPPORTED", "LIMITED_CAUSAL_EVIDENCE"),
]


def assess_coupling(relations: DataFrame, domains: DataFrame, outcome: str, canonical: DataFrame | None = None) -> DataFrame:
    """One row: the verdict on all relations (a, b, kind, family, valid_from, admitted, ordinal) and what it rests on.

    `canonical` (node, root) replaces bodies by the one that they were resolved to.
    """
    if canonical is not None:
        for end in ("a", "b"):
            to = canonical.select(F.col("node").alias(end), F.col("root").alias("to"))
            relations = relations.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    admitted = staged(relations.filter("admitted"))
    prior = admitted.filter(F.col("valid_from") < F.to_date(F.lit(outcome)))
    counts = relations.agg(F.count_if(~F.col("admitted")).alias("excluded")).join(admitted.agg(F.count("*").alias("n_admitted"))).join(prior.agg(F.count("*").alias("prior"), F.countDistinct("family").alias("families")))
    ends = prior.select(F.col("a").alias("node")).union(prior.select("b"))
    most = ends.groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    spanned = ends.distinct().join(domains, "node").agg(F.countDistinct(F.when(F.col("domain") != "UNKNOWN", F.col("domain"))).alias("domains"))
    found = component_detail(prior_pairs(relations, outcome), domains).agg(F.count("*").alias("components"), F.coalesce(F.bool_or("diffusing"), F.lit(False)).alias("diffusing"))
    one = counts.join(most).join(spanned).join(found)  # one row each
    pick = F.when(F.col("prior") < 2, 0).when(F.col("families") < 2, 1).when(F.col("most") == F.col("prior"), 2).when((F.col("domains") < 2) | ~F.col("diffusing"), 3).otherwise(4)
    told: Column = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("ceiling")) for v, c in VERDICTS])
    got = one.withColumn("v", F.get(told, pick))
    discriminating = F.col("prior") <= 0.9 * F.col("n_admitted")
    return got.select("v.verdict", "v.ceiling", "n_admitted", "excluded", "prior", "families", "domains", "components", discriminating.alias("discriminating"))


def top_components(found: DataFrame, k: int = 5) -> DataFrame:
    """The k largest components; ties by root."""
    return found.orderBy(F.desc("nodes"), "root").limit(k)


def bridges(edges: DataFrame) -> DataFrame:
    """(person, body): persons tied to two or more bodies, with how many."""
    return edges.groupBy("person").agg(F.countDistinct("body").alias("bodies")).filter("bodies >= 2")
