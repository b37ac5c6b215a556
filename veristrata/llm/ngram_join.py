"""Near-duplicate documents: a Jaccard join of word 5-grams by MinHash banding.

1. Rows get a number and texts that are equal become one node with a number of copies.
2. Each node's MinHash signature is cut into bands; bands and rows are chosen so that a pair
   at the threshold meets in some band with the target recall.
3. Nodes are shuffled on band hashes; a bucket of many is cut into blocks and each pair of
   blocks is a group of its own. A pair belongs to the first band in which it meets, so it
   is looked at once. A first pass over signatures leaves only nodes that have such a
   partner; a second pass brings their full n-gram sets and computes the exact Jaccard
   similarity of the pairs, as a product of incidence matrices.
4. A group returns each node's links and least linked node, never the pairs; components of
   these links are the classes.

Words are split at ASCII white space and compared as they are. A text of one to four words
is one n-gram. Defined results: a null text is an empty one; texts without a word link with
nothing, not even each other; equal texts with words link; n_links counts the other rows
that a row links with directly; class_id is the smallest doc_id of the class (null if all
are null) and one row of the class, the first by doc_id, is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, column, grouped, mix64, small, small_batches, stage, text_bytes
from .components import components, local_roots

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.99999, 160
#: Nodes of a block of a bucket, and columns of an incidence matrix at a time.
BLOCK, COLUMNS = 256, 4096
#: Bytes of text that are hashed at once.
TEXT_BYTES = 1 << 20


def banding(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair at the threshold is still met with the target recall."""
    need = lambda r: max(1, ceil(log(1 - recall) / log(1 - threshold**r))) if threshold < 1 else 1
    rows = max(r for r in range(1, most + 1) if r == 1 or r * need(r) <= most)
    return need(rows), rows


class Grams:
    """Hashes of all word n-grams of many texts at once."""

    def __init__(self, words: int) -> None:
        self.n, self.hash = words, WordHasher()
        self.by = np.random.default_rng(77).integers(1, 1 << 62, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram hashes and where each text's start (and the end)."""
        word, at = self.hash(*text_bytes(texts))
        n = np.diff(at)
        counts = np.where(n >= self.n, n - self.n + 1, (n > 0).astype(np.int64))
        start = np.concatenate([[0], np.cumsum(counts)])
        first = np.repeat(at[:-1] - start[:-1], counts) + np.arange(start[-1])
        padded = np.concatenate([word, np.zeros(self.n, np.uint64)])
        have = np.repeat(np.minimum(n, self.n), counts)
        out = have.astype(np.uint64)
        for k in range(self.n):
            out += np.where(have > k, padded[first + k] * self.by[k], np.uint64(0))
        return mix64(out), start


class MinHash:
    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(9)
        self.bands, self.rows = bands, rows
        self.flip = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.by = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of band hashes for each text that has n-grams."""
        starts = at[:-1][np.diff(at) > 0]
        out = np.empty((len(starts), self.bands), np.uint64)
        if not len(starts):
            return out.view(np.int64)
        for b in range(self.bands):
            total = np.full(len(starts), np.uint64(b + 1))
            for r in range(b * self.rows, (b + 1) * self.rows):
                total = mix64(total + np.minimum.reduceat((grams ^ self.flip[r]) * self.by[r], starts))
            out[:, b] = total
        return out.view(np.int64)


def _met(sig: np.ndarray, own: np.ndarray, bucket: int) -> np.ndarray:
    """Which pairs (upper triangle) of a group meet first in this bucket's band; across two blocks only pairs of both."""
    band = int(np.argmax(sig[0] == bucket))
    met = np.triu(np.ones((len(sig),) * 2, bool), 1)
    if own[0] != own[-1] or (own != own[0]).any():
        met &= own[:, None] != own[None, :]
    for b in range(band):
        met &= sig[:, b][:, None] != sig[:, b][None, :]
    return met


def _common(grams: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each pair of sets shares."""
    if len(grams) == 2:
        n = len(np.intersect1d(grams[0], grams[1], assume_unique=True))
        return np.array([[len(grams[0]), n], [n, len(grams[1])]])
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, col, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(grams),) * 2, np.float64)
    many = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, many, COLUMNS):
        lo, hi = np.searchsorted(col, [a, a + COLUMNS])
        x = np.zeros((len(grams), min(COLUMNS, many - a)), np.float32)
        x[row[lo:hi], col[lo:hi] - a] = 1
        total += x @ x.T
    return total


def link(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The columns of docs, and a struct column `link_` of n_links, class_id, kept; it takes the place of one called so."""
    names = [c for c in docs.columns if c != "link_"]
    return linked(docs.select(*[f"`{c}`" for c in names]), words, threshold, recall).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "link_")


def linked(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The columns of docs as c0, c1, ..., and `link_`."""
    bands, rows = banding(threshold, recall)
    grams, signs = Grams(words), MinHash(bands, rows)
    names = docs.columns
    numbered = stage(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("uid")))
    col = lambda c: F.col(f"c{names.index(c)}")
    texts = numbered.select("uid", col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", TEXT_BYTES):
            found, at = grams(column(batch, "text"))
            has = np.flatnonzero(np.diff(at))
            if len(has):
                sig = signs(found, at)
                one = batch.take(pa.array(has))
                yield pa.RecordBatch.from_arrays([column(one, "uid"), column(one, "doc_id"), column(one, "key"), pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, bands, dtype=np.int32)), pa.array(sig.ravel()))], ["uid", "doc_id", "key", "sig"])

    signed = stage(texts.withColumn("key", F.md5(F.col("text").cast("binary"))).mapInArrow(sign, "uid bigint, doc_id bigint, key string, sig array<bigint>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")).alias("first")
    nodes = stage(signed.groupBy("key").agg(F.min("uid").alias("node"), F.count("*").alias("copies"), first, F.min("sig").alias("sig")))

    spread = nodes.select("node", F.explode("sig").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # Signatures join again only where a bucket is shared: most buckets hold one node.
    met = stage(spread.join(shared, "bucket").select("node", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    members = met.join(nodes.select("node", "sig"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    paired = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "sig")

    def partnered(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        sig = _signatures(group, bands)
        met = _met(sig, group["own"].to_numpy(), group["bucket"][0].as_py())
        has = np.flatnonzero(met.any(0) | met.any(1))
        return group.drop_columns(["sig"]).take(pa.array(has)).combine_chunks().to_batches()[0] if len(has) else None

    keys = ["bucket", "i", "j"]
    active = stage(grouped(paired, keys, partnered, "bucket bigint, i int, j int, own int, node bigint"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", TEXT_BYTES):
            found, at = grams(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "uid"), pa.array([np.unique(found[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "grams"])

    asked = stage(active.select(F.col("node").alias("uid")).distinct())
    full = stage(texts.join(small(asked), "uid", "left_semi").select("uid", "text").mapInArrow(sets, "node bigint, grams binary"))
    facts = full.join(nodes.select("node", "copies", "sig"), "node")

    def verify(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        met = _met(_signatures(group, bands), group["own"].to_numpy(), group["bucket"][0].as_py())
        held = [np.frombuffer(g, np.uint64) for g in group["grams"].to_pylist()]
        sizes = np.array([len(g) for g in held])
        both = _common(held)
        a, b = np.nonzero(met & (both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9))
        if not len(a):
            return None
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        root = node[local_roots(a, b, len(node))]
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], ["node", "links", "root"])

    found = stage(grouped(active.join(facts, "node").select(*keys, "own", "node", "sig", "copies", "grams"), keys, verify, "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = stage(nodes.select("key", "node", "copies", "first").join(links, "node", "left").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")))
    heads = stage(named.groupBy("root").agg(F.min("first").alias("head")))
    done = stage(named.join(heads, "root").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "head"))
    # Only rows that link or are not kept need looking up; all others are classes of their own.
    told = stage(signed.select("uid", "key").join(done.filter("n_links > 0"), "key").select(F.col("uid").alias("of"), "n_links", "head"))
    out = numbered.join(small(told), F.col("uid") == F.col("of"), "left")
    alone = F.col("of").isNull()
    verdict = F.struct(
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, col("doc_id")).otherwise(F.col("head.doc_id")).cast("long").alias("class_id"),
        (alone | (F.col("uid") == F.col("head.uid"))).alias("kept"),
    )
    return out.select(*[f"c{i}" for i in range(len(names))], verdict.alias("link_"))


def _signatures(group: pa.Table, bands: int) -> np.ndarray:
    return group["sig"].combine_chunks().flatten().to_numpy().reshape(-1, bands)


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of docs."""
    return linked(docs).filter("link_.kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


#: The same in DuckDB, by all pairs of documents that share an n-gram; doc_ids must differ.
JOIN_SQL = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g FROM docs),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS both_have FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes sx ON sx.r = x JOIN sizes sy ON sy.r = y WHERE both_have * 5 >= (sx.n + sy.n - both_have) * 4),
reached(r, least) USING KEY (r) AS (
  SELECT r, doc_id FROM docs
  UNION SELECT links.y, min(reached.least) FROM reached JOIN links ON links.x = reached.r JOIN recurring.reached AS held ON held.r = links.y WHERE reached.least < held.least GROUP BY links.y),
counts AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, least AS class_id, coalesce(n, 0)::BIGINT AS n_links, doc_id IS NOT DISTINCT FROM least AS kept FROM docs JOIN reached USING (r) LEFT JOIN counts USING (r)
"""
