"""Shared pieces: staged tables, checked broadcasts, grouped Arrow maps, word hashing."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, wherever an operator counts words: the ASCII white space splits.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a table's values that may be broadcast.
BROADCAST_BYTES = 16_000_000

_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set: the warehouse, or on one machine a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local["):
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.veristrata"
    if not where:
        import tempfile

        where = getattr(spark, "_veristrata_dir", None) or tempfile.mkdtemp(prefix="veristrata-")
        spark._veristrata_dir = where
    return where


def _delete_staged() -> None:
    for spark, path in _staged:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended already
            return


atexit.register(_delete_staged)


def stage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veristrata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (a staged table) marked for broadcast if all its values take few bytes; else unmarked, for a shuffled join."""

    def size(c: str, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        return F.lit(8)

    each = sum((size(f.name, f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= most else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body has lambdas."""
    return F.transform(F.array(value), body)[0]


def bucket_of(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % modulus


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, parts: int | None = None) -> DataFrame:
    """fn over the rows of each key, which must be bounded in number.

    The rows come sorted by key and as Arrow, so a task holds one group at a time and a
    small group costs no pandas frame.
    """
    if parts is None:
        spread = df.repartition(*keys)
    elif len(keys) == 1:  # keys 0, 1, ... go to a partition each
        spread = df.repartitionById(parts, F.col(keys[0]).cast("int"))
    else:
        spread = df.repartition(parts, *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None

        def done() -> Iterator[pa.RecordBatch]:
            if held and (out := fn(pa.Table.from_batches(held))) is not None and out.num_rows:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                v = column(batch, k).to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(column(batch, k)[a].as_py() for k in keys)
                if key != last:
                    yield from done()
                    held, last = [], key
                held.append(batch.slice(a, b - a))
        yield from done()
        held.clear()
        give_back()

    return spread.sortWithinPartitions(*keys).mapInArrow(run, schema)


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system, as far as its allocators can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def small_batches(batches: Iterator[pa.RecordBatch], name: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about `most` bytes of the text column; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = text_offsets(column(batch, name))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def text_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts as one array, and where each text starts in it (and the end). Null: empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    at = text_offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class WordHasher:
    """64-bit hashes of all words of many texts at once, by prefix sums over their bytes."""

    def __init__(self) -> None:
        self.value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up, self.down = _powers(1 << 16)

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes in order, and for each text where its words start (and the end)."""
        if len(raw) == 0:
            return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
        if len(raw) + 1 > len(self.up):
            self.up, self.down = _powers(len(raw) + 1)
        word = ~_SPACE[raw]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = at[(at > 0) & (at < len(raw))]
        first[inner] = word[inner]
        last = np.zeros(len(raw), bool)
        last[:-1] = word[:-1] & (~word[1:] | first[1:])
        last[-1] = word[-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[: len(raw)], dtype=np.uint64, out=total[1:])
        got = (total[end] - total[start]) * self.down[start]
        return mix64(got + (end - start).astype(np.uint64)), np.searchsorted(start, at)
