"""What the query modules share: tables, registration, and rule tables as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry():
    """(queries, oracles, register): register(name, sql) decorates a query."""
    queries, oracles = {}, {}

    def register(name: str, sql: str | None = None):
        def put(f):
            queries[name] = f
            if sql is not None:
                oracles[name] = sql
            return f

        return put

    return queries, oracles, register


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _test_sql(rule, fields: dict[str, str], guards: dict[str, str]) -> str:
    """A rule's condition. RE2 has no look-ahead, so a rule with one is stated without it: only for texts that never need it."""
    field, pattern, _, guard = rule
    return f"regexp_matches({fields[field]}, {quoted(re.sub(r'\(\?![^)]*\)', '', pattern))}){f' AND ({guards[guard]})' if guard else ''}"


def rules_sql(rules, fields: dict[str, str], guards: dict[str, str]) -> str:
    """A rule table as a sum of cases."""
    return " + ".join(f"CASE WHEN {_test_sql(rule, fields, guards)} THEN {rule[2]} ELSE 0 END" for rule in rules)


def labels_sql(rules, fields: dict[str, str], guards: dict[str, str], label, positive: bool, more: tuple[str, ...] = ()) -> str:
    """The labels of a rule table's rules that hold and give, or take, points, and further cases."""
    cases = [f"CASE WHEN {_test_sql(rule, fields, guards)} THEN {quoted(label(rule))} END" for rule in rules if (rule[2] >= 0) == positive]
    return f"list_filter([{', '.join((*cases, *more))}], lambda x: x IS NOT NULL)"


def count_sql(c: str, patterns) -> str:
    """How many of the patterns occur."""
    return "(" + " + ".join(f"regexp_matches({c}, {quoted(p)})::INTEGER" for p in patterns) + ")"
