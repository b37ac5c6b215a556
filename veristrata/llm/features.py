"""Text statistics for the classifiers, over whole batches of texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, mix64, small, small_batches, stage, text_bytes

#: Bits of the hash that samples are drawn by; bytes of text that are hashed at once.
HASH_BITS, TEXT_BYTES = 60, 1 << 20
_LETTER_RUNS = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    return _LETTER_RUNS.findall(text.lower())


class NgramHasher:
    """Counts of hashed byte n-grams of lower-cased texts, white space and digits made equal, as shares of the text."""

    def __init__(self, sizes: Sequence[int] = (2, 3, 4), buckets: int = 4096) -> None:
        self.sizes, self.buckets = tuple(sizes), buckets
        self.same = np.arange(256, dtype=np.uint64)
        self.same[[9, 10, 11, 12, 13]] = 32
        self.same[48:58] = 48
        self.same[33:48] = self.same[58:65] = self.same[91:97] = self.same[123:127] = 33

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.buckets), np.float32)
        longest = max(self.sizes)
        for i, text in enumerate(texts):
            raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
            for a in range(0, len(raw), TEXT_BYTES):
                # A part also has the bytes that its last n-grams end with.
                codes = self.same[raw[a : a + TEXT_BYTES + longest - 1]]
                for n in self.sizes:
                    many = min(len(codes) - n + 1, TEXT_BYTES)
                    if many > 0:
                        key = codes[:many].copy()
                        for k in range(1, n):
                            key |= codes[k : many + k] << np.uint64(8 * k)
                        out[i] += np.bincount((mix64(key + np.uint64(n << 40)) % np.uint64(self.buckets)).astype(np.int64), minlength=self.buckets)
            out[i] /= len(raw)
        return np.sqrt(out, out=out)


def sample(docs: DataFrame, label: Column, most: int, seed: str, known: DataFrame | None = None) -> DataFrame:
    """At most `most` documents of each label, all where there are no more: (label_, h_, text_), staged.

    Documents are those of the least hashes of doc_id and text, so rows equal in both count and
    are taken once, however many there are, and every run takes the same. A count of a label's
    different hashes bounds those of which the last one taken is looked for. `known` (doc_id, label) gives the
    labels where docs has none; `label` is its column then. A null label is not learnt.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 64 - HASH_BITS).alias("h_")
    own = [F.col("doc_id").alias("id_"), F.col("text").alias("text_"), h]
    if known is None:
        rows, tell = docs.select(*own, label.alias("label_")), lambda r: r
    else:
        names = known.select(F.col("doc_id").alias("of_"), label.alias("label_"))
        rows, tell = docs.select(*own), lambda r: r.join(names, F.col("id_") == F.col("of_"))
    found = stage(tell(rows.drop("text_").distinct()).filter("label_ is not null").select("label_", "h_").distinct())
    # A share that a few more than `most` hashes are under, and among those the last one taken.
    some = float(most + 8 * most**0.5 + 8)
    rough = found.groupBy("label_").agg((F.least(F.lit(1.0), F.lit(some) / F.count("*")) * float(1 << HASH_BITS)).cast("long").alias("rough_"))
    under = found.join(small(stage(rough.withColumnRenamed("label_", "for_"))), F.col("label_") == F.col("for_")).filter("h_ <= rough_")
    lowest = F.sort_array(F.collect_list("h_"))
    bound = stage(under.groupBy(F.col("label_").alias("for_")).agg(F.get(lowest, F.least(F.lit(most), F.size(lowest)) - 1).alias("bound_")))
    greatest = bound.agg(F.max("bound_")).first()[0] or 0
    # Texts meet the labels only under the greatest bound: they are few, whatever the tables' sizes.
    few = tell(rows.filter(F.col("h_") <= greatest)).join(small(bound), F.col("label_") == F.col("for_")).filter("h_ <= bound_")
    return stage(few.groupBy("label_", "h_").agg(F.first("text_").alias("text_")))


def learn(chosen: DataFrame, features) -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of a sample: computed on the executors, collected as bytes. The sample bounds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text_"):
            x = features([t or "" for t in column(batch, "text_").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary()), column(batch, "label_")], ["x", "label"])

    schema = T.StructType([T.StructField("x", T.BinaryType()), T.StructField("label", chosen.schema["label_"].dataType)])
    got = chosen.select("text_", "label_").mapInArrow(run, schema).toArrow()
    x = [r.as_py() for r in got["x"]]
    order = sorted(range(len(x)), key=x.__getitem__)  # one order, however the tasks end
    y = got["label"].to_pylist()
    if not x:
        return np.zeros((0, 0), np.float32), np.zeros(0, object)
    return np.stack([np.frombuffer(x[i], np.float32) for i in order]), np.array([y[i] for i in order], object)


def score(docs: DataFrame, model, out: str, keep: Sequence[str], where: str | None = None) -> DataFrame:
    """docs' columns `keep` and what model(texts) gives: a list of columns as in the schema text `out`.

    A kept column that is called like a result gets an underscore. With `where`, a condition on the
    results, only the rows that meet it come back, with the kept columns alone, as they are called.
    """
    fields = docs.select(*[f"`{c}`" for c in keep]).schema

    # A text that is kept anyway goes to the workers once.
    text = f"k{list(keep).index('text')}" if "text" in keep else "text_"
    names = [f.split(" ")[0] for f in out.split(", ")]
    kinds = {"double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[f.split(" ")[1]] for f in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            got = model(column(batch, text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(g, t) for g, t in zip(got, types, strict=True)], [f"k{i}" for i in range(len(keep))] + names)

    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *([] if "text" in keep else [F.col("text").alias(text)]))
    schema = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)] + list(T._parse_datatype_string(out)))
    done = given.mapInArrow(run, schema)
    if where:
        return done.filter(where).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
    return done.select(*[F.col(f"k{i}").alias(c + "_" * (c.lower() in names)) for i, c in enumerate(keep)], *names)


def text_matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.string()))
