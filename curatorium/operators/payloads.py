"""Records of unknown shape: answers of services and of language models as JSON, read as variants."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatorium.functions import text
from curatorium.operators.stages import once

LIST_KEYS, ONE_KEYS = ("result", "results", "items", "data", "subsidies"), ("result", "data")
ID_KEYS = ("id", "subsidy_id", "subsidyId", "grant_id", "grantId", "management_number")
#: A field's own name and those that it is sent under instead.
ALIASES = {
    "application_period_text": ("application_period", "applicationPeriod"), "region_text": ("region",), "amount_text": ("max_amount", "amount"), "subsidy_rate_text": ("subsidy_rate",), "target_expenses_arr": ("target_expenses",), "target_entities_arr": ("target_entities",),
}
LISTED = ("target_expenses_arr", "target_entities_arr")
MAX_DEPTH, MAX_TEXT, MAX_MEMBERS = 5, 3000, 30
BINARY = re.compile("base64|data|binary|content_bytes|file_body|body_base64", re.I)


def parsed(c: Column) -> Column:
    """A variant of JSON text, with or without a code fence; else of the part between its outermost braces; else null."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "(?i)^```(?:json)?", ""), "```\\z", ""))
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(raw), F.when(inner != "", F.try_parse_json(inner)))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def results(v: Column) -> Column:
    """The records of an answer as an array of variants: the first list under one of the usual keys, or one object; none in an answer of another shape."""
    under = lambda key: F.try_variant_get(v, f"$.{key}", "variant")
    lists = [F.when(_is(under(k), "ARRAY"), F.try_variant_get(v, f"$.{k}", "array<variant>")) for k in LIST_KEYS]
    ones = [F.when(_is(under(k), "OBJECT"), F.array(under(k))) for k in ONE_KEYS]
    return F.coalesce(*lists, *ones, F.array().cast("array<variant>"))


def field(v: Column, *names: str) -> Column:
    """The first of the names whose value is neither null nor empty, as text."""
    return text.first_present(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])


def members(v: Column, *names: str) -> Column:
    """A list under the first of the names that has one, from an array or from a text with signs between its members; empty where none has."""
    found = []
    for n in names:
        whole, value = F.try_variant_get(v, f"$.{n}", "array<string>"), F.try_variant_get(v, f"$.{n}", "variant")
        found += [F.when(_is(value, "ARRAY"), whole), F.when(_is(value, "STRING"), F.split(F.try_variant_get(v, f"$.{n}", "string"), "[、,\n]"))]
    tidy = lambda a: F.filter(F.transform(a, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.coalesce(*[F.when(F.size(tidy(f)) > 0, tidy(f)) for f in found], F.array().cast("array<string>"))


def record_id(v: Column) -> Column:
    return field(v, *ID_KEYS)


def canonical(v: Column) -> Column:
    """struct of a record's fields under their own names, whichever of their names they were sent under."""
    return F.struct(*[(members if name in LISTED else field)(v, name, *others).alias(name) for name, others in ALIASES.items()])


def _bounded(value, depth: int = 0):
    if depth > MAX_DEPTH:
        return "[omitted: depth limit]"
    if isinstance(value, str):
        return value if len(value) <= MAX_TEXT else value[:MAX_TEXT] + "...[omitted]"
    if isinstance(value, list):
        return [_bounded(x, depth + 1) for x in value[:MAX_MEMBERS]]
    if isinstance(value, dict):
        return {k: "[omitted: binary/base64]" if BINARY.search(k) else _bounded(x, depth + 1) for k, x in value.items()}
    return value


@F.pandas_udf(T.StringType())
def bounded(s: pd.Series) -> pd.Series:
    """JSON text cut down for an audit log: deeper levels, longer texts and further members left out, binary fields named only. Text that is no JSON, or is nested beyond reading, gives null. No expression of Spark recurses, hence Python."""

    def one(x):
        try:
            return json.dumps(_bounded(json.loads(x)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return s.map(one, na_action="ignore")


def records(rows: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(good, bad) of answers in the column raw. good: a row for each record with an id, with the other columns of rows, place, id and the canonical fields. bad: the answers without any, with the reason and the answer's text, for a side table."""
    others = [c for c in rows.columns if c != raw]
    held = once(rows, {"_payload": parsed(F.col(raw))})
    held = once(held, {"_records": F.filter(results(F.col("_payload")), lambda v: record_id(v).isNotNull())})
    reason = F.when(F.trim(F.coalesce(F.col(raw), F.lit(""))) == "", "empty").when(F.col("_payload").isNull(), "not JSON").when(F.size(results(F.col("_payload"))) == 0, "no record").otherwise("no id")
    bad = held.where(F.size("_records") == 0).select(*others, reason.alias("reason"), raw)
    good = held.select(*others, F.posexplode("_records").alias("place", "_v"))
    good = once(good, {"id": record_id(F.col("_v")), "_c": canonical(F.col("_v"))}).select(*others, "place", "id", "_c.*")
    return good, bad
