"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash. A source whose target is k whole passes and a rest takes
every document k times, and once more those whose hash is under the source's threshold.
The threshold is found without sorting documents: words are summed by source and hash
bucket, only the bucket that holds the budget's end is split further, until that bucket
holds a single hash. Rows that share it (they are equal in doc_id and text) are told apart by
a second hash, of their number in the staged table, and a second threshold is found among
them in the same way. Everything is DataFrame functions.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; of rows equal in doc_id and text at the threshold as many are taken as come nearest
to the target; a source without words has target 0; an empty table gives an empty result. The input's other
columns are ignored unless asked for with `keep`.

The only window over sources is over one row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, stage

HASH_BITS = 60
#: Bits that one histogram resolves: at most 1024 rows a source.
STEP_BITS = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an MD5, which any SQL engine can compute."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the total shared by weight, up to `most` times a size.

    A source stops at its limit b = most * size / weight in units of the common level. The
    level at which the shares add up to the total is found among the limits in order, with
    running sums over one row for each source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_limit = Window.orderBy("at", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = sources.withColumn("weight", F.get(cycle, (F.row_number().over(ordered) - 1) % len(weights))).withColumn("at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    levels = (
        ranked.withColumn("stopped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(every)["level"])
    )
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.col("weight") * F.coalesce(F.col("level"), F.col("at")))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, keep: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, and the columns in `keep` under `names`."""
    extra = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]
    facts = [F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("h")]
    sized = stage(docs.select(*facts, F.monotonically_increasing_id().alias("uid"), *extra))
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0)
    bound = stage(plan.withColumn("passes", passes.cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumns({"below": F.lit(0).cast("long"), "nearer": F.lit(False)}))
    bound = _threshold(sized.withColumn("key", F.col("h")), bound, F.col("rest") > 0).withColumnRenamed("key_at", "h_at")
    # Among the rows of that hash, by a hash of their own; most often there is one such row.
    at = bound.select(F.col("source").alias("of"), "h_at")
    equal = sized.join(small(at), F.col("source").eqNullSafe(F.col("of")) & (F.col("h") == F.col("h_at")))
    tie = F.shiftrightunsigned(F.xxhash64("uid"), 64 - HASH_BITS)
    bound = _threshold(equal.select("source", "size", tie.alias("key")), bound, F.col("h_at") >= 0)
    last = F.col("key_at") - F.when(F.col("nearer"), 0).otherwise(1)
    told = bound.select(F.col("source").alias("of"), "source_size", "target", "passes", "h_at", last.alias("tie_at"))
    joined = sized.join(small(told), F.col("source").eqNullSafe(F.col("of")), "left")
    more = (F.col("h") < F.col("h_at")) | ((F.col("h") == F.col("h_at")) & (tie <= F.col("tie_at")))
    copies = F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")
    given = [F.col(f"kept_{i}").alias(n) for i, n in enumerate(names or keep)]
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"), *given)


def _threshold(rows: DataFrame, bound: DataFrame, asked: Column) -> DataFrame:
    """bound with the key (60 bits) at which the sums over rows (source, size, key) in its order reach `rest`, as `key_at`.

    -1 where nothing is asked for. `below` becomes the words before that key; `nearer` tells
    if the sum with its rows is nearer to the rest than without. A rest beyond all rows ends at the last.
    """
    bound = bound.withColumns({"prefix": F.lit(0).cast("long"), "open": asked, "key_at": F.lit(-1).cast("long")})
    bits = HASH_BITS
    while bits > 0 and bound.filter("open").limit(1).count():
        bits, bound = _refine(rows, bound, bits)
    return bound.drop("prefix", "open")


def _refine(rows: DataFrame, bound: DataFrame, bits: int) -> tuple[int, DataFrame]:
    """Splits each source's boundary bucket into 2**STEP_BITS and finds the one that holds the budget's end."""
    left = max(0, bits - STEP_BITS)
    at = bound.filter("open").select(F.col("source").alias("of_"), F.col("prefix").alias("p"), "below", "rest")
    inside = rows.join(small(at), F.col("source").eqNullSafe(F.col("of_")) & (F.shiftright("key", bits) == F.col("p")))
    sums = inside.groupBy("of_", F.shiftright("key", left).alias("bucket"), "below", "rest").agg(F.sum("size").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    running = Window.partitionBy("of_").orderBy("bucket")
    reached = sums.withColumn("to", F.col("below") + F.sum("n").over(running))
    # The first bucket that reaches the rest, or else the last one.
    whole = F.struct("bucket", F.col("to"), "n", "lo", "hi")
    ends = F.coalesce(F.min(F.when(F.col("to") >= F.col("rest"), whole)), F.max(whole)).alias("end")
    found = reached.groupBy("of_").agg(ends)
    before = F.col("end.to") - F.col("end.n")
    single = F.col("end.lo") == F.col("end.hi")
    nearer = F.abs(F.col("end.to") - F.col("rest")) <= F.abs(F.col("rest") - before)
    was = lambda c, new: F.when(F.col("open"), F.coalesce(new, F.col(c))).otherwise(F.col(c)).alias(c)
    kept = [c for c in bound.columns if c not in ("prefix", "below", "open", "key_at", "nearer")]
    done = bound.join(small(stage(found)), F.col("source").eqNullSafe(F.col("of_")), "left").select(
        *kept,
        was("prefix", F.col("end.bucket")).cast("long").alias("prefix"),
        was("below", before).cast("long").alias("below"),
        was("nearer", nearer).alias("nearer"),
        (F.col("open") & F.coalesce(~single, F.lit(False))).alias("open"),
        F.when(F.col("open") & single, F.col("end.lo")).otherwise(F.col("key_at")).cast("long").alias("key_at"),
    )
    return left, stage(done)


#: The same in DuckDB: here each source's documents are sorted by hash.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
limits AS (SELECT *, 3.0::DOUBLE * source_size / weight AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)) /
            (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM limits
  WINDOW b AS (ORDER BY cap, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, source_size,
         least(3.0::DOUBLE * source_size, weight * coalesce((SELECT arg_min(level, cap) FROM levels WHERE level <= cap), cap)) AS target
  FROM levels),
split AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS passes FROM plan),
rests AS (SELECT *, target - passes * source_size AS rest FROM split),
hashes AS (SELECT source, h, sum(size)::BIGINT AS n, min(size) AS each FROM sized GROUP BY source, h),
running AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM hashes),
ends AS (
  SELECT r.source, rest, coalesce(arg_min({'h': h, 'upto': upto, 'n': n, 'each': each}, h) FILTER (upto >= rest), arg_max({'h': h, 'upto': upto, 'n': n, 'each': each}, h)) AS e
  FROM running r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source WHERE rest > 0 GROUP BY r.source, rest),
-- Of the equal rows at the boundary as many as come nearest, half a row counting as one.
thresholds AS (SELECT source, e.h AS h_at, CASE WHEN e.each > 0 THEN floor((rest - (e.upto - e.n)) / e.each + 0.5) ELSE 0 END AS equals FROM ends),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS k FROM sized),
counted AS (
  SELECT doc_id, size, source_size, target,
         passes + CASE WHEN h < coalesce(h_at, -1) OR (h = h_at AND k <= equals) THEN 1 ELSE 0 END AS copies
  FROM placed JOIN rests ON placed.source IS NOT DISTINCT FROM rests.source
  LEFT JOIN thresholds ON placed.source IS NOT DISTINCT FROM thresholds.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM counted
"""
