"""Rules over small tables of cases: each row of `part` takes a case by its key, and the SQL states what the rule must give.

The results are written out by hand, not computed, so the SQL knows nothing of the
expressions. Every branch of a rule has a case of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Q, SQL, t

#: name -> (inputs' types, rows of inputs, results' types, rows of results, rule)
CASES: dict[str, tuple[str, list[tuple], str, list[tuple], Callable[[], Sequence[Column]]]] = {}
SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def literal(value: Any, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {SQL_TYPES[kind]})"
    if isinstance(value, bool):
        return str(value).lower()
    text = str(value).replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"CAST('{text}' AS {SQL_TYPES[kind]})"


def columns(schema: str) -> list[tuple[str, str]]:
    """(name, type) of a schema text whose types hold no blanks."""
    return [tuple(x.strip().split(" ", 1)) for x in _split(schema)]


def _split(schema: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]


def cases(given: str, rows: list[tuple[tuple, tuple]], wanted: str) -> Callable:
    """Registers a rule (a function to columns, in the order of `wanted`) with its cases (inputs, results)."""

    def add(rule: Callable[[], Sequence[Column]]) -> Callable:
        name = rule.__name__
        CASES[name] = (given, [i for i, _ in rows], wanted, [o for _, o in rows], rule)
        types = columns(wanted)
        values = ", ".join("(" + ", ".join([str(k), *[literal(v, kind) for v, (_, kind) in zip(out, types, strict=True)]]) + ")" for k, (_, out) in enumerate(rows))
        names = ", ".join(n for n, _ in types)
        SQL[name] = f"SELECT p_partkey, {names} FROM part JOIN (VALUES {values}) v(k_, {names}) ON p_partkey % {len(rows)} = k_"

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = spark.createDataFrame([(k, *i) for k, (i, _) in enumerate(rows)], f"case_ long, {given}")
            keyed = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(rows)).alias("case_"))
            made = [c.alias(n) for c, (n, _) in zip(rule(), types, strict=True)]
            return keyed.join(F.broadcast(found), "case_").select("p_partkey", *made)  # a few dozen rows

        query.__name__ = name
        Q[name] = query
        return rule

    return add
