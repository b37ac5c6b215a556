"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Encoding. The text is cut at single spaces into chunks that the split pattern treats alone,
each new chunk is split by the pattern into pieces, and the new pieces of a batch go to one
recursive query as lists of tokens: their token-position rows join the merge table, each piece's
leftmost pair of minimum rank is contracted, and so on until no pair is left. Pieces over LONG_PIECE bytes
would take one step of the query for each merge, so they are merged by the same rule with a
heap instead. Chunks and pieces that were seen before are kept until the task ends, up to a
bound; texts are then looked up and joined.

Decoding. Token-position rows join the vocabulary, where a character below 256 stands for each
byte, and an ordered aggregation joins a query's rows, which are then cut where sequences end.

Defined results: null and empty texts have no tokens and decode to nothing; ids out of the
vocabulary are an error; other columns are ignored or, with `keep`, passed through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
import types
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column, give_back, small_batches

#: Bytes of a piece from which on the heap merges it, and entries that a worker keeps.
LONG_PIECE = 256
KEPT = 200_000
#: Bytes of text that a worker takes at once (a longer text comes alone), and pieces that one encoding query takes.
AT_ONCE, PIECES_AT_ONCE = 1 << 19, 15_000
#: Tokens whose bytes one decoding query joins.
DECODE_AT_ONCE = 1 << 18

#: White space before a space: there the pattern's matches do not start at each space.
RUN_OF_SPACES = re.compile(r"\s ").search

# The least rank and, among its places, the leftmost are the minimum of one number: a place is under 1024.
ENCODE = """
WITH RECURSIVE state AS (
  SELECT piece, ids FROM pieces
 UNION ALL
  SELECT s.piece, s.ids[:b.best % 1024 - 1] || [(b.best // 1024)::INT] || s.ids[b.best % 1024 + 2:]
  FROM state s JOIN (
    SELECT p.piece, min(m.merged::BIGINT * 1024 + p.i) AS best
    FROM (SELECT piece, unnest(ids) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids) + 1)) AS i FROM state) p
    JOIN merges m ON m.l = p.l AND m.r = p.r
    GROUP BY p.piece) b ON b.piece = s.piece)
SELECT piece, arg_min(ids, len(ids)) AS ids FROM state GROUP BY piece ORDER BY piece
"""
DECODE = """
SELECT string_agg(v.text, '' ORDER BY t.position) AS text
FROM tokens t JOIN vocabulary v ON v.id = t.token
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pattern_for(pattern: str) -> re.Pattern:
    r"""The split pattern for Python's re, with \p{L}, \p{N} and \s written out as sets of characters."""

    def ranges(wanted) -> str:
        out, start = [], None
        for c in range(sys.maxunicode + 2):
            if c <= sys.maxunicode and wanted(chr(c)):
                start = c if start is None else start
            elif start is not None:
                out.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
                start = None
        return "".join(out)

    letters = ranges(lambda c: unicodedata.category(c)[0] == "L")
    numbers = ranges(lambda c: unicodedata.category(c)[0] == "N")
    spaces = ranges(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
    inside = re.sub(r"\\p\{L\}|\\p\{N\}|\\s|\\S", lambda m: {"\\p{L}": letters, "\\p{N}": numbers, "\\s": spaces}[m[0]], "".join(re.findall(r"\[\^([^\]]*)\]", pattern)))
    out = re.sub(r"\[\^[^\]]*\]", lambda _: f"[^{inside}]", pattern)
    return re.compile(re.sub(r"\\p\{L\}|\\p\{N\}|\\s|\\S", lambda m: {"\\p{L}": f"[{letters}]", "\\p{N}": f"[{numbers}]", "\\s": f"[{spaces}]", "\\S": f"[^{spaces}]"}[m[0]] if len(m[0]) > 1 else m[0], out))


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token, with that token."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    return pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())})


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction of one long piece in n log n steps."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    live = [True] * n

    def rank(i: int) -> int | None:
        j = after[i]
        return ranks.get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, 2) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, size = heapq.heappop(heap)
        if not live[i] or after[i] >= n or end[after[i]] - i != size:
            continue
        j = after[i]
        live[j] = False
        end[i], after[i] = end[j], after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (x := rank(k)) is not None:
                heapq.heappush(heap, (x, k, end[after[k]] - k))
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


class Kept:
    """What a worker remembers, in two generations: entries in use pass to the new one, the others go."""

    def __init__(self, most: int) -> None:
        self.most, self.now, self.before = most, {}, {}

    def unmet(self, keys: Sequence[Sequence]) -> list:
        """Keys not known; the caller adds them to `now`, where all other keys are then found."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        new = set().union(*keys).difference(self.now)
        known = new & self.before.keys()
        for k in known:
            self.now[k] = self.before[k]
        return list(new - known)


class Codec:
    """Encodes and decodes within one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb

        self.ranks, self.find = ranks, pattern_for(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": False})
        merges = merge_table(ranks)  # noqa: F841  read by DuckDB
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        vocabulary = pa.table({"id": pa.array(self.bytes_of, pa.int32()), "text": [b.decode("latin-1") for b in self.bytes_of.values()]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.db.execute("SET enable_progress_bar = false")
        self.forget()
        self.size = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.size[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        give_back()  # what the tables above were made from

    def forget(self, kept: int = KEPT) -> None:
        """Empties what is kept: ids of the chunks met, as they are and by what follows a leading space; and of pieces."""
        self.raw, self.spaced, self.pieces = Kept(kept // 4), Kept(kept), Kept(kept // 2)

    def contract(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        asked = []
        for k, whole in enumerate(map(self.ranks.get, pieces)):
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(pieces[k]) > LONG_PIECE:
                out[k] = np.array(merge_long(pieces[k], self.ranks), "<u4").tobytes()
            else:
                asked.append(k)
        for at in range(0, len(asked), PIECES_AT_ONCE):
            part = asked[at : at + PIECES_AT_ONCE]
            given = [pieces[k] for k in part]
            ends = np.append(0, np.cumsum(list(map(len, given)))).astype(np.int32)
            tokens = self.byte[np.frombuffer(b"".join(given), np.uint8)]
            self.db.register("pieces", pa.table({"piece": pa.array(np.arange(len(part), dtype=np.int32)), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))}))
            ids = self.db.sql(ENCODE).to_arrow_table()["ids"].combine_chunks()
            self.db.unregister("pieces")
            ends, values = (ids.offsets.to_numpy() * 4).tolist(), ids.values.to_numpy().astype("<u4").tobytes()
            for k, a, b in zip(part, ends[:-1], ends[1:], strict=True):
                out[k] = values[a:b]
        return out

    def chunks_of(self, text: str) -> list[str]:
        """Parts of the text that the pattern splits alike alone: each starts with a space whose neighbours are no spaces."""
        parts = text.split(" ")
        # A part that is empty or ends in white space runs into the next one.
        starts = [0, *(i for i, p in enumerate(parts[:-1], 1) if p and not p[-1].isspace())]
        if not parts[0] and len(parts) > 1:
            starts[0] = 1  # the text begins with a space, which the next part brings along
        out = [" ".join(parts[a:b]) for a, b in zip(starts, [*starts[1:], len(parts)], strict=True)]
        return [c if a == 0 else " " + c for a, c in zip(starts, out, strict=True) if a or c]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out, chunks, plain = [b""] * len(texts), {}, []
        for k, t in enumerate(texts):
            if t and RUN_OF_SPACES(t):
                chunks[k] = self.chunks_of(t)
            elif t:
                plain.append(k)
        # In other texts each space begins a chunk; the distinct ones of the batch are looked up.
        parts = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
        begins, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        places, begun = coded.indices.to_numpy().astype(np.int64), begins[:-1]
        firsts = coded.dictionary.take(pa.array(places[begun])).to_numpy(zero_copy_only=False).tolist()
        met = np.ones(len(places), bool)
        met[begun] = False
        met = np.flatnonzero(np.bincount(places[met], minlength=len(coded.dictionary)))
        words = coded.dictionary.take(pa.array(met)).to_numpy(zero_copy_only=False).tolist()  # quicker than to_pylist
        new_raw = self.raw.unmet([*chunks.values(), [c for c in firsts if c]])
        new_spaced = self.spaced.unmet([words])
        if new_raw or new_spaced:
            find = self.find
            split_raw, split_spaced = [find(c) for c in new_raw], [find(" " + c) for c in new_spaced]
            # A chunk that is one piece is kept as a chunk alone.
            asked = self.pieces.unmet([ps for split in (split_raw, split_spaced) for ps in split if len(ps) > 1])
            alone = list({ps[0] for split in (split_raw, split_spaced) for ps in split if len(ps) == 1}.difference(self.pieces.now, asked))
            got = self.contract([p.encode() for p in asked + alone])
            self.pieces.now.update(zip(asked, got))
            ids_of = self.pieces.now | dict(zip(alone, got[len(asked) :], strict=True))
            get = ids_of.__getitem__
            for kept, new, split in ((self.raw, new_raw, split_raw), (self.spaced, new_spaced, split_spaced)):
                kept.now.update(zip(new, [get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps)) for ps in split], strict=True))
        raw, spaced = self.raw.now.__getitem__, self.spaced.now.__getitem__
        for k, cs in chunks.items():
            out[k] = b"".join(map(raw, cs))
        if plain:
            place = np.zeros(len(coded.dictionary), np.int64)
            place[met] = np.arange(len(met))
            places = place[places]
            places[begun] = len(met) + np.arange(len(plain))
            found = pa.array([*map(spaced, words), *(raw(c) if c else b"" for c in firsts)], pa.large_binary()).take(pa.array(places))
            ends, whole = np.frombuffer(found.buffers()[1], np.int64)[begins].tolist(), found.buffers()[2].to_pybytes()
            for k, a, b in zip(plain, ends[:-1], ends[1:], strict=True):
                out[k] = whole[a:b]
        return out

    def decode(self, ids: Sequence[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids: token-position rows join the vocabulary, and an ordered aggregation joins their bytes."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        rows = pa.table({"position": pa.array(np.arange(len(flat), dtype=np.int32)), "token": pa.array(flat)})
        parts = []
        for at in range(0, rows.num_rows, DECODE_AT_ONCE):
            self.db.register("tokens", rows.slice(at, DECODE_AT_ONCE))
            parts += [x.encode("latin-1") for (x,) in self.db.sql(DECODE).fetchall() if x]
            self.db.unregister("tokens")
        whole = b"".join(parts)
        ends = np.append(0, np.cumsum(self.size[flat]))[np.cumsum([len(x) // 4 for x in ids])].tolist() if ids else []
        if ends and ends[-1] != len(whole):
            raise ValueError("ids out of the vocabulary")
        return [whole[a:b] for a, b in zip([0, *ends], ends)]


def codec(ranks: Callable[[], dict[bytes, int]], pattern: str, name: str) -> Codec:
    """One codec for each vocabulary and worker; a worker serves many tasks. ranks is called for a new one only."""
    home = sys.modules.setdefault("_veristrata_codecs", types.ModuleType("_veristrata_codecs"))
    found = getattr(home, name, None)
    if found is None:
        found = Codec(ranks(), pattern)
        setattr(home, name, found)
    return found


def encode(docs: DataFrame, path: str, pattern: str, keep: Sequence[str] = ("doc_id",), decoded: bool = False, kept: int = KEPT, at_once: int = AT_ONCE) -> DataFrame:
    """The columns `keep`, ids (binary, 32 bits each) and, if asked for, the bytes that they decode to.

    Entries kept and bytes at once are what a worker's memory goes by, besides its batch; fewer of them take more time, and the
    ids are the same."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    name = "v" + hashlib.md5((path + pattern).encode()).hexdigest()
    fields = docs.select(*[f"`{c}`" for c in keep]).schema
    text = f"k{list(keep).index('text')}" if "text" in keep else "text_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(lambda: ranks.value, pattern, name)
        work.forget(kept)
        batch = ids = columns = None
        try:
            for batch in small_batches(batches, text, at_once):
                ids = work.encode(column(batch, text).to_pylist())
                columns = [batch.column(i) for i in range(len(keep))] + [pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(work.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [f"k{i}" for i in range(len(keep))] + ["ids_", "decoded_"][: 1 + decoded])
        finally:
            # The worker outlives the task, and other work may follow in it.
            batch = ids = columns = None  # noqa: F841
            work.forget()
            give_back()

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *([] if "text" in keep else [F.col("text").alias(text)]))
    schema = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField(n, T.BinaryType()) for n in ["ids_", "decoded_"][: 1 + decoded]])
    done = given.mapInArrow(run, schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("ids_").alias("ids"), *([F.col("decoded_").alias("decoded")] if decoded else []))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows (doc_id, ids) to (doc_id, decoded): the bytes of every row."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    name = "v" + hashlib.md5((path + pattern).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x or b"" for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(codec(lambda: ranks.value, pattern, name).decode(ids), pa.binary())], ["doc_id", "decoded"])

    from pyspark.sql import types as T

    return rows.select("doc_id", "ids").mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("decoded", T.BinaryType())]))
