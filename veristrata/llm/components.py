"""Connected components of links that stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stage

#: Links that a task takes together when it replaces them by a forest with the same components.
AT_ONCE = 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs to (node, root): the smallest node reachable; nodes without a link to another are left out.

    The graph is contracted round by round. A task first replaces its links by stars with the same
    components. Then every node takes its neighbour of least rank, if that is less than its own,
    as its parent, and its parent's parent twice over; links between different parents make the
    next round's graph. Ranks are the numbers themselves, which contract whole stars at once, and
    hashes in every second round: whatever order the numbers have, on average at most half of the
    linked nodes are left after such a round, so the rounds grow with the logarithm of the number of nodes. Minima are taken map-side first, and joins
    are not followed by work that needs a key's rows together, so a hub's rows can be split.
    Each round is written to the shared folder; the driver only learns if links are left.
    """
    links = stage(forest(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))
    labels, turn = None, 0
    while links.limit(1).count():
        rank = lambda c, salt=turn: F.struct((F.xxhash64(F.col(c), F.lit(salt)) if salt % 2 else F.col(c)).alias("h"), F.col(c).alias("n"))
        both = links.union(links.select("b", "a"))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        up = stage(near.select(F.col("a").alias("node"), F.least("near", rank("a"))["n"].alias("up")))
        for _ in range(2):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up").select("node", F.col("top").alias("up"))
        up = stage(up)
        left = links.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        links = stage(forest(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            labels = stage(labels.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        turn += 1
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = stage(labels.groupBy("root").agg(F.min("node").alias("least")))
    return stage(labels.join(least, "root").select("node", F.col("least").alias("root")))


def forest(edges: DataFrame) -> DataFrame:
    """(a, b) pairs with the same components: within each task, links (node, least node it reaches there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            nodes, at = np.unique(np.concatenate([x for pair in zip(*held, strict=True) for x in pair]), return_inverse=True)
            half = len(at) // 2
            root = local_roots(at[:half], at[half:], len(nodes))
            own = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["a", "b"])

        for batch in batches:
            held.append((column(batch, "a").to_numpy(zero_copy_only=False), column(batch, "b").to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size >= AT_ONCE:
                yield from done()
                held, size = [], 0
        if size:
            yield from done()

    return edges.filter("a <> b").mapInArrow(run, "a bigint, b bigint")


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links a[i]-b[i] between 0..n-1: the least index of each one's component."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # Roots hook on the least root they are linked to; then each tree is flattened.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root
