"""Rule tables compiled to expressions: additive scores with their reasons, and ordered decisions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from types import MappingProxyType

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str, int, str]


def named(rule: Rule, names: Mapping[str, str], labels: Mapping[tuple[str, str], str]) -> str:
    """The label of a rule: its own, or its field's name and its expression, with its points."""
    field, pattern, points, _ = rule
    plain = f"{names.get(field, field)}:{pattern.removeprefix('(?i)')}"
    return f"{labels.get((field, pattern), plain)} {points:+d}"


def conditions(rules: Iterable[Rule], fields: Mapping[str, Column], guards: Mapping[str, Column], names: Mapping[str, str] = MappingProxyType({}), labels: Mapping[tuple[str, str], str] = MappingProxyType({})) -> list[tuple[Column, int, str]]:
    """(condition, points, label) of each rule (field, expression, points, guard); names and labels say what the labels show for fields and for single rules."""
    out = []
    for rule in rules:
        field, pattern, points, guard = rule
        hit = F.coalesce(fields[field].rlike(pattern), F.lit(False))
        out.append((hit & guards[guard] if guard else hit, points, named(rule, names, labels)))
    return out


def score(found: list[tuple[Column, int, str]]) -> Column:
    """Sum of the points of the conditions that hold."""
    return F.aggregate(F.array(*[F.when(hit, F.lit(points)).otherwise(F.lit(0)) for hit, points, _ in found]), F.lit(0), lambda a, x: a + x)


def labels(found: list[tuple[Column, int, str]], positive: bool) -> Column:
    """Labels of the conditions that hold and give, or take, points."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(label)) for hit, points, label in found if (points >= 0) == positive]))


def decision(steps: Iterable[tuple[Column, str | Column]], otherwise: str | Column = "") -> Column:
    """The value of the first condition that holds."""
    out = F
    for hit, value in steps:
        out = out.when(hit, value)
    return out.otherwise(otherwise)
