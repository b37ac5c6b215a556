"""Packing token ids into rows of fixed length by best-fit decreasing.

Documents are encoded by the tokenizer's library, each with an end token, and cut into segments of at most `length`
ids, so nothing is lost. Segments are dealt at random (by hash) to shards of a bounded
number of segments; within a shard the longest segment goes first, each into the fullest
row that still holds it. That row is found in a segment tree over the room left, in
log(length) steps. Rows that are full from the start need no search.

Each packed row has its ids as little-endian unsigned 32-bit integers padded to `length`,
the cumulative segment lengths (the row's attention boundaries), and where positions start
again at 0. Defined results: a null or empty text is a segment of its end token alone;
repeated rows are packed each on their own, dealt to shards like any others; an empty table
gives no rows; other columns than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import column, grouped, small_batches, stage

#: Segments that a shard holds on average: what a task sorts and keeps.
SHARD_SEGMENTS = 8192
#: Ids a row, the id that ends a document and fills a row's rest.
LENGTH, END_ID = 2048, 50256
#: White space that the library's matcher might not get through.
LONG_SPACE = re.compile(r"\s{1000}").search


class RoomTree:
    """How many open rows have each amount of room, as a tree of sums over 0..length."""

    def __init__(self, length: int) -> None:
        self.size = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room that is `least` or more, and its room."""
        i = least + self.size
        if not self.count[i]:
            while True:
                if i & 1 == 0 and self.count[i + 1]:
                    i += 1
                    break
                i >>= 1
                if i <= 1:
                    return None
            while i < self.size:
                i *= 2
                if not self.count[i]:
                    i += 1
        room = i - self.size
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: np.ndarray, length: int) -> np.ndarray:
    """The row of each segment: best-fit decreasing, ties by order."""
    out, tree, rows = np.zeros(len(lengths), np.int64), RoomTree(length), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n) if n < length else None
        row, room = found or (rows, length)
        rows += found is None
        out[i] = row
        if room > n:
            tree.add(room - n, row)
    return out


class Library:
    """The tokenizer's library, within one Python worker; the own codec where its matcher runs out of stack."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, name: str) -> None:
        import tiktoken

        self.ranks, self.pattern, self.name = ranks, pattern, name
        self.fast = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> np.ndarray:
        if LONG_SPACE(text):
            return np.frombuffer(bpe.codec(lambda: self.ranks, self.pattern, self.name).encode([text])[0], "<u4")
        return np.array(self.fast(text), "<u4")


def library(ranks: dict[bytes, int], pattern: str, name: str) -> Library:
    home = sys.modules.setdefault("_veristrata_libraries", types.ModuleType("_veristrata_libraries"))
    if not hasattr(home, name):
        setattr(home, name, Library(ranks, pattern, name))
    return getattr(home, name)


def segments(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID) -> tuple[DataFrame, np.dtype]:
    """(doc_id, part, n, ids): each document's ids with the end token, cut into parts of at most `length`; and the ids' type, the least that holds them."""
    ranks = bpe.read_ranks(path)
    kind = np.dtype("<u2" if max(end_id, *ranks.values()) < 1 << 16 else "<u4")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = "p" + hashlib.md5((path + pattern).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library(shared.value, pattern, name)
        for batch in small_batches(batches, "text", 1 << 20):
            own, part, n, ids = [], [], [], []
            for i, t in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                whole = np.append(encode(t or ""), end_id).astype(kind)
                for k, a in enumerate(range(0, len(whole), length)):
                    cut = whole[a : a + length]
                    own.append(i)
                    part.append(k)
                    n.append(len(cut))
                    ids.append(cut.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(part, pa.int32()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "part", "n", "ids"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, "doc_id bigint, part int, n int, ids binary"), kind


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """One row per packed row: shard, row, n_tokens, doc_ids, parts, cu_seqlens, position_resets, ids."""
    cut, kind = segments(docs, path, pattern, length, end_id)
    cut = stage(cut.withColumn("uid", F.monotonically_increasing_id()))
    shards = max(1, -(-cut.count() // shard_segments))
    # By the number in the staged table, so that rows of one doc_id are dealt like any others.
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).drop("uid")

    def run(group: pa.Table) -> pa.RecordBatch:
        get = lambda c: group[c].combine_chunks()
        ids, doc, part, n = get("ids"), get("doc_id").to_pylist(), get("part").to_numpy(), get("n").to_numpy()
        # A fixed order, however the shuffle delivered the rows: by document, part and ids.
        order = np.array(sorted(range(len(doc)), key=lambda i: (doc[i] is None, doc[i] or 0, part[i], ids[i].as_py())), np.int64)
        row = best_fit(n[order], length)
        by_row = order[np.argsort(row, kind="stable")]
        sizes = np.bincount(row)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "doc_ids", "parts", "cu_seqlens", "position_resets", "ids")}
        for members in np.split(by_row, np.cumsum(sizes)[:-1]):
            ends = np.cumsum(n[members])
            out["n_tokens"].append(int(ends[-1]))
            out["doc_ids"].append([doc[i] for i in members])
            out["parts"].append(part[members].tolist())
            out["cu_seqlens"].append([0, *ends.tolist()])
            out["position_resets"].append([0, *ends[:-1].tolist()])
            filled = np.full(length, end_id, "<u4")
            filled[: ends[-1]] = np.frombuffer(b"".join(ids[int(i)].as_py() for i in members), kind)
            out["ids"].append(filled.tobytes())
        many = len(sizes)
        kinds = {"n_tokens": pa.int32(), "doc_ids": pa.list_(pa.int64()), "parts": pa.list_(pa.int32()), "cu_seqlens": pa.list_(pa.int32()), "position_resets": pa.list_(pa.int32()), "ids": pa.binary()}
        columns = [pa.array(np.full(many, group["shard"][0].as_py(), np.int32)), pa.array(np.arange(many, dtype=np.int32))]
        return pa.RecordBatch.from_arrays(columns + [pa.array(out[k], t) for k, t in kinds.items()], ["shard", "row", *kinds])

    schema = "shard int, row int, n_tokens int, doc_ids array<bigint>, parts array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary"
    return grouped(dealt, ["shard"], run, schema, parts=shards)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, in files of whole shards."""
    packed.write.mode("overwrite").parquet(path)


def read_matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The id matrix of a batch of packed rows, without copying an id."""
    ids: Iterator[bytes] = (x.as_py() for x in column(batch, "ids"))
    return np.stack([np.frombuffer(x, "<u4") for x in ids])
