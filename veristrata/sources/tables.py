"""Published tables as they are landed: indicators, cubes, populations, monthly archives, calendars. Missing cells stay missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import identifiers as I
from ..functions import numbers as N
from ..functions.identifiers import stripped

INDICATOR_COLUMNS = {"area_code": "Area Code", "sex": "Sex", "age": "Age", "category_type": "Category Type", "category": "Category", "sortable": "Time period Sortable", "label": "Time period"}
ARCHIVE_COLUMNS = ["REPORTING_PERIOD_START", "REPORTING_PERIOD_END", "BREAKDOWN", "PRIMARY_LEVEL", "SECONDARY_LEVEL", "MEASURE_ID", "MEASURE_NAME", "MEASURE_VALUE"]
# Names of the whole in a population table.
ALL_SEXES, ALL_AGES, OLDEST = "all", "total", "90+"


def indicator_observations(rows: DataFrame) -> DataFrame:
    """A published indicator table (all text) as typed rows without exact repeats, and how many years each label pools."""
    text = lambda c: F.coalesce(stripped(F.col(f"`{c}`")), F.lit(""))
    cell = lambda c: N.indicator_cell(F.col(f"`{c}`"))
    typed = rows.select(F.col("`Indicator ID`").cast("int").alias("indicator_id"), *[text(c).alias(n) for n, c in INDICATOR_COLUMNS.items()], cell("Value").alias("value"), cell("Count").alias("count"), cell("Denominator").alias("denominator"))
    return typed.withColumn("span", N.span_years(F.col("label"))).dropDuplicates([*INDICATOR_COLUMNS, "value"])


def stratum_series(rows: DataFrame, area: str, sex: str, age: str | None = None) -> DataFrame:
    """One stratum's rows by period, and `problem` where a period has several or several ages would mix."""
    own = rows.filter((F.col("area_code") == area) & (F.col("sex") == sex) & (F.col("category_type") == ""))
    if age is not None:
        own = own.filter(F.col("age") == age)
    period = F.coalesce(F.nullif("sortable", F.lit("")), F.col("label"))
    by = own.groupBy(period.alias("period")).agg(F.first("label").alias("label"), F.first("value").alias("value"), F.max("span").alias("span"), F.count("*").alias("n"), F.countDistinct("age").alias("ages"))
    problem = F.when(F.col("ages") > 1, "SEVERAL_AGES").when(F.col("n") > 1, "REPEATED_PERIOD")
    return by.select("period", "label", "value", "span", problem.alias("problem"))


def observed(series: DataFrame, allow_pooled: bool = False) -> DataFrame:
    """One row: whether a series (period, value, span) can be calibrated against, or why not."""
    got = series.agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.coalesce(F.max("span"), F.lit(1)).alias("span"))
    reason = F.when(F.col("n") == 0, "EMPTY").when(F.col("valued") < F.col("n"), "MISSING_PERIODS").when((F.col("span") > 1) & F.lit(not allow_pooled), "POOLED_PERIODS").when(F.col("n") < 3, "TOO_FEW_POINTS")
    return got.select("n", reason.isNull().alias("usable"), reason.alias("reason"))


def cube_cell(item: Column) -> Column:
    """An observation (JSON) of a cube: the value only with a normal status."""
    o = F.from_json(item, "geography struct<geogcode:string,description:string>, time struct<value:string,description:string>, measures struct<description:string>, obs_value struct<value:string>, obs_status struct<value:string,description:string>")
    value = N.cube_cell(o["obs_value"]["value"])
    return F.struct(o["geography"]["geogcode"].alias("geography"), o["time"]["value"].alias("period"), o["measures"]["description"].alias("measure"), F.when(o["obs_status"]["value"] == "A", value).alias("value"), o["obs_status"]["description"].alias("status"))


def slice_problem(required: Column, pinned: Column, truncated: Column) -> Column:
    """Why a slice of a cube would not mean what it seems to: dimensions left open, unknown ones, or a truncated answer."""
    lower = F.transform(pinned, F.lower)
    left, unknown = F.array_sort(F.array_except(required, lower)), F.array_sort(F.array_except(lower, required))
    return F.when(F.size(left) > 0, F.concat(F.lit("UNPINNED:"), F.array_join(left, ","))).when(F.size(unknown) > 0, F.concat(F.lit("UNKNOWN:"), F.array_join(unknown, ","))).when(F.lower(truncated) == "true", "TRUNCATED")


def cell_kind(codes: Column) -> Column:
    """What a cross-table's cell is, by the codes of all its dimensions."""
    roles = F.transform(codes, I.code_role)
    return F.when(F.forall(roles, lambda r: r == "total"), "grand_total").when(F.exists(roles, lambda r: r == "total"), "margin").when(F.exists(roles, lambda r: r == "aggregate"), "aggregate_cell").otherwise("cross_cell")


def population(rows: DataFrame, geography: str, sex: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """(geography, sex, age, year, value: text) to population by year.

    Published aggregates are only read where nothing is asked for; "90+" only where the range reaches it.
    """
    text = lambda c: F.lower(stripped(F.col(c)))
    age = text("age")
    if low is None and high is None:
        fits = age == ALL_AGES
    else:
        years = age.try_cast("int")
        fits = F.when(age == OLDEST, F.lit((high is None or high >= 90) and (low is None or low <= 90))).otherwise((years >= (low if low is not None else 0)) & (years <= (high if high is not None else 1000)))
    own = rows.filter((text("geography") == geography.lower()) & (text("sex") == (sex or ALL_SEXES).lower()) & F.coalesce(fits, F.lit(False)))
    year, value = stripped(F.col("year")).try_cast("int"), F.floor(F.coalesce(F.nullif("value", F.lit("")), F.lit("0")).try_cast("double")).cast("long")
    return own.select(year.alias("year"), value.alias("value")).dropna().groupBy("year").agg(F.sum("value").alias("population"), F.count("*").alias("rows_matched"))


def archive_cells(rows: DataFrame, measures: list[str] | None = None, breakdowns: list[str] | None = None) -> DataFrame:
    """A monthly archive (all text) as cells: windows of one month only, values parsed, `problem` where an end cannot be dated.

    A missing column is an error before anything is read.
    """
    missing = sorted(set(ARCHIVE_COLUMNS) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    t = {c: F.coalesce(stripped(F.col(c)), F.lit("")) for c in ARCHIVE_COLUMNS}
    own = rows
    if measures:
        own = own.filter(t["MEASURE_ID"].isin([m.strip() for m in measures]))
    if breakdowns:
        own = own.filter(t["BREAKDOWN"].isin([b.strip() for b in breakdowns]))
    window = D.monthly_window(F.col("REPORTING_PERIOD_START"), F.col("REPORTING_PERIOD_END"))
    cells = own.select(t["MEASURE_ID"].alias("measure_id"), t["MEASURE_NAME"].alias("measure_name"), t["BREAKDOWN"].alias("breakdown"), t["PRIMARY_LEVEL"].alias("primary_level"), t["SECONDARY_LEVEL"].alias("secondary_level"), window.alias("w"), N.published_cell(F.col("MEASURE_VALUE")).alias("value"), N.is_suppressed(F.col("MEASURE_VALUE")).alias("suppressed"))
    return cells.filter("w.month is not null or w.problem is not null").select("measure_id", "measure_name", "breakdown", "primary_level", "secondary_level", F.col("w.month").alias("month"), F.col("w.problem").alias("problem"), "value", "suppressed")


def available_measures(cells: DataFrame, breakdown: str) -> DataFrame:
    return cells.filter(F.col("breakdown") == breakdown).groupBy("measure_id").agg(F.array_join(F.array_sort(F.collect_set("measure_name")), "|").alias("names"))


def spine(counts: DataFrame, first: str, last: str, every: str = "day") -> DataFrame:
    """(period, count, monitored) on a whole calendar: a period that is absent or not monitored is missing, never 0."""
    days = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval 1 {every}"))).alias("period"))
    kept = F.when(F.col("monitored") > 0, F.col("count"))
    return F.broadcast(days).join(counts, "period", "left").select("period", kept.alias("count"), kept.isNull().alias("missing"))  # a calendar


def organisations(rows: DataFrame, name: str | None = None, role: str | None = None, status: str | None = None, post_code: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a directory under a filter, which must be given; limit 1 to 1000."""
    asked = {"name": name, "primary_role_id": role, "status": status, "post_code": post_code}
    if not any(asked.values()):
        raise ValueError("an unfiltered directory is not asked for")
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    for column, value in asked.items():
        if value:
            rows = rows.filter(F.contains(F.lower(column), F.lit(value.lower())) if column == "name" else F.col(column) == value)
    return rows.orderBy("org_id").offset(offset).limit(limit)


def propositions(rows: DataFrame) -> DataFrame:
    """A registry of propositions with its list of workstreams split."""
    items = F.filter(F.transform(F.split("required_workstreams", ";"), stripped), lambda x: x != "")
    return rows.withColumn("required_workstreams", items)
