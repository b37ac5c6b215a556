"""Dates as publishers write them. What cannot be read stays missing; what could be read two ways is refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import stripped

ISO_REST = r"(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?"


def dated(text: Column, pattern: str, order: str = "ymd") -> Column:
    """The date of a text that matches a pattern of three numbers, in the order given; null for no such day."""
    part = {c: F.regexp_extract(text, pattern, i + 1) for i, c in enumerate(order)}
    return F.concat_ws("-", part["y"], F.lpad(part["m"], 2, "0"), F.lpad(part["d"], 2, "0")).try_cast("date")


YMD, DMY, DASHED_DMY, SLASHED_YMD = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$", r"^(\d{4})/(\d{1,2})/(\d{1,2})$"


def grant_date(value: Column) -> Column:
    """Four ways to write a day, the day before the month; what follows a T or a space is ignored."""
    head = F.split_part(F.split_part(stripped(value), F.lit("T"), F.lit(1)), F.lit(" "), F.lit(1))
    return F.coalesce(dated(head, YMD), dated(head, DMY, "dmy"), dated(head, DASHED_DMY, "dmy"), dated(head, SLASHED_YMD))


def contract_date(value: Column) -> Column:
    """The day of an ISO date or time; a time's offset does not move it."""
    return dated(value, r"^(\d{4})-(\d{2})-(\d{2})" + ISO_REST + "$")


def iso_date(value: Column) -> Column:
    """The day of an ISO date or time, or of a text that begins with one."""
    return dated(stripped(value), r"^(\d{4})-(\d{2})-(\d{2})")


def register_date(value: Column) -> Column:
    """The day that a text begins with."""
    return iso_date(value)


def epoch_date(millis: Column) -> Column:
    """The UTC day of milliseconds since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86_400_000).cast("int"))


def registration_date(value: Column) -> Column:
    """A day, a month or a year (their first day), or an ISO time."""
    text = stripped(value)
    month = F.concat(F.regexp_extract(text, r"^(\d{4})-\d{1,2}$", 1), F.lit("-"), F.lpad(F.regexp_extract(text, r"^\d{4}-(\d{1,2})$", 1), 2, "0"), F.lit("-01")).try_cast("date")
    year = F.concat(F.regexp_extract(text, r"^(\d{4})$", 1), F.lit("-01-01")).try_cast("date")
    return F.coalesce(dated(text, YMD), month, year, contract_date(text))


def anchor_date(year: Column) -> Column:
    """The first day of the year an act was passed in."""
    return F.when(year > 0, F.make_date(year, F.lit(1), F.lit(1)))


def title_years(title: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\b(19\d{2}|20\d{2})\b"), 1), lambda y: y.cast("int"))


def year_conflict(title: Column, candidate: Column) -> Column:
    """The latest year in a title if none is within a year of the date; null where they agree or nothing can be told."""
    years = title_years(title)
    near = F.exists(years, lambda y: F.abs(y - F.year(candidate)) <= 1)
    return F.when(candidate.isNotNull() & (F.size(years) > 0) & ~near, F.array_max(years))


def period_end(value: Column) -> Column:
    """(day, problem): a period's end, refused where the day could be a month."""
    text = stripped(value)
    day = F.coalesce(dated(text, DMY, "dmy"), dated(text, YMD))
    problem = F.when(day.isNull(), "UNPARSEABLE_END").when(F.day(day) < 13, "AMBIGUOUS_END")
    return F.struct(F.when(problem.isNull(), day).alias("day"), problem.alias("problem"))


def monthly_window(start: Column, end: Column) -> Column:
    """(month, problem): YYYY-MM of a row whose start lies in its end's month, however the start is written; null for longer windows."""
    last, text = period_end(end), stripped(start)
    same = F.lit(False)
    for day in (dated(text, DMY, "dmy"), dated(text, DMY, "mdy"), dated(text, YMD)):
        same = same | F.coalesce(F.trunc(day, "month") == F.trunc(last["day"], "month"), F.lit(False))
    return F.struct(F.when(same, F.date_format(last["day"], "yyyy-MM")).alias("month"), last["problem"].alias("problem"))


def month_range(first: Column, last: Column) -> Column:
    """Every month from YYYY-MM to YYYY-MM; a reversed range is an error of the query."""
    day = lambda c: F.concat(c, F.lit("-01")).cast("date")
    months = F.transform(F.sequence(day(first), F.greatest(day(first), day(last)), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    return F.when(last < first, F.raise_error(F.concat(last, F.lit(" precedes "), first))).otherwise(months)


def interval_problem(source: Column, target: Column, start: Column, end: Column) -> Column:
    """Why a relation cannot be: it ends before it begins, or it ties a body to itself; null if it can."""
    return F.when(F.coalesce(end < start, F.lit(False)), "VALID_TO_PRECEDES_VALID_FROM").when(source == target, "SELF_LOOP")


def tie_interval(start: Column, end: Column) -> Column:
    """(valid_from, valid_to, current, inverted): an interval that the register gives the wrong way round is emitted undated."""
    inverted = F.coalesce(end < start, F.lit(False))
    return F.struct(F.when(~inverted, start).alias("valid_from"), F.when(~inverted, end).alias("valid_to"), (end.isNull() & ~inverted).alias("current"), inverted.alias("inverted"))
