"""Quality rules: a table of thresholds compiled into one projection.

RULES names a statistic, the least and the greatest value that a document may have. The
statistics are lengths and ratios of symbols, stop words and lines, all of the whole text
and all built-in functions, so one pass over the table decides every document and nothing
is shuffled.

Defined results: a null or empty text has no words and fails the base rules; ratios of
nothing count as 0; repeated rows are judged alike; columns of any other name pass through
`judge` untouched, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE_WORDS = 50
BASE_REPEATS = 50

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
a and are as at be by for from in is it of on or that the this to was were with
au aux avec ce dans de des du elle en est et il la le les ne pas par pour que qui se sur un une
als am auf das dem den der die ein eine er für im in ist mit nicht sie sich und von zu
al con del el en es la las lo los no para por que se su un una y
""".split()

#: (statistic, least, greatest); None: no limit.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 1.5, 25.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_share", 0.015, None),
    ("dup_line_share", None, 0.5),
)


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that the array holds at least twice.

    Windows are compared by 64-bit hash. Without an equal pair nothing more is done; else
    (hash, position) pairs are sorted and the positions of equal neighbours give the words.
    """
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def positions(pairs: Column) -> Column:
        same = lambda j, e: F.coalesce(F.get(pairs, j)["h"] == e["h"], F.lit(False))
        hits = F.filter(F.transform(pairs, lambda e, i: F.when(same(i - 1, e) | same(i + 1, e), e["p"])), lambda p: p.isNotNull())
        return let(F.sort_array(hits), covered)

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, positions))

    return let(windows, count)


def statistics(text: Column) -> Column:
    """A struct of all counts of one text."""

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
        return F.struct(
            let(F.regexp_extract_all(t, F.lit(WORD), 0), of_words).alias("words"),
            let(lines, of_lines).alias("lines"),
            F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        )

    return let(F.coalesce(text, F.lit("")), of_text)


def judge(docs: DataFrame, rules: Sequence[tuple[str, float | None, float | None]] = RULES, into: str = "quality") -> DataFrame:
    """docs with one more struct column: the counts, base_failed and kept.

    A column already called `into` is replaced.
    """

    def verdict(s: Column) -> Column:
        words, lines = s["words"], s["lines"]
        share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        value = {
            "mean_word_chars": share(s["word_chars"], words["n_words"]),
            "symbols_per_word": share(s["n_symbols"], words["n_words"]),
            "stop_word_share": share(words["n_stop_words"], words["n_words"]),
            "dup_line_share": share(lines["n_dup_lines"], lines["n_lines"]),
        }
        passed = F.lit(True)
        for name, least, most in rules:
            passed = passed & (value[name] >= least if least is not None else F.lit(True)) & (value[name] <= most if most is not None else F.lit(True))
        failed = (words["n_words"] < BASE_WORDS) | (100 * words["n_repeat_words"] > BASE_REPEATS * words["n_words"])
        return F.struct(
            words["n_words"].alias("n_words"),
            s["word_chars"].alias("word_chars"),
            s["n_symbols"].alias("n_symbols"),
            lines["n_dup_lines"].alias("n_dup_lines"),
            words["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & passed).alias("kept"),
        )

    return docs.withColumn(into, let(statistics(F.col("text")), verdict))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    columns = docs.columns
    verdict = "_quality"
    while verdict in columns:
        verdict += "_"
    return judge(docs, into=verdict).filter(F.col(verdict)["kept"]).select(*[F.col(f"`{c}`") for c in columns])


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
RULES_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, row_number() OVER () AS r, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
covered AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY r),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop
  FROM words LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, (n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATS} * n_words) AS base_failed,
         coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS a, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS b,
         coalesce(n_stop::DOUBLE / nullif(n_words, 0), 0) AS c, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS d
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND a >= 1.5::DOUBLE AND a <= 25::DOUBLE AND b <= 0.25::DOUBLE AND c >= 0.015::DOUBLE AND d <= 0.5::DOUBLE) AS kept
FROM judged
"""
