"""Lookups between tables, existence flags, visibility, merges and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of records from the grants interface that an extraction never changes.
LOCKED = (
    "title", "organization", "region", "region_text", "prefecture", "municipality", "application_period", "application_period_text", "application_start_date",
    "application_end_date", "application_start_at", "application_end_at", "application_status", "official_url", "source_url", "source_type", "source_external_id",
    "crawl_status", "is_active", "fiscal_year",
)


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """parents with the number of their children; parents without any keep null."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left")


def visible(children: DataFrame, parents: DataFrame, key: str, where: Column) -> DataFrame:
    """Children of which some parent passes the condition."""
    return children.join(parents.where(where).select(key), key, "left_semi")


def uncovered(rows: DataFrame, covered: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows whose key no row of covered has; null keys of covered count for nothing."""
    return rows.join(covered.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").orderBy(*order).limit(k)


def with_flag(rows: DataFrame, known: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with whether their key exists in known; rows with a null key have false."""
    found = known.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(found, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def upserted(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert, with `action` (kept, updated or inserted): a full outer join, in which the incoming side wins where it has a row.

    Both sides have the same columns, and each key once.
    """
    others = [c for c in current.columns if c not in keys]
    a = current.select(*keys, F.struct(*others).alias("_a"))
    b = incoming.select(*keys, F.struct(*others).alias("_b"))
    both = a.join(b, keys, "full_outer")
    picked = [F.when(F.col("_b").isNotNull(), F.col(f"_b.{c}")).otherwise(F.col(f"_a.{c}")).alias(c) for c in others]
    action = F.when(F.col("_b").isNull(), "kept").when(F.col("_a").isNull(), "inserted").otherwise("updated")
    return both.select(*keys, *picked, action.alias("action"))


def merged(current: dict[str, Column], found: dict[str, Column], locked: Column, checks: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
    """Field by field: an extraction's value where it has one, unless the field is locked and filled, the value fails the field's check, or the stored one passes it.

    checks: field to (whether the found value is usable, whether the stored one is to stay).
    """
    out = {}
    for name, old in current.items():
        new = found.get(name)
        if new is None:
            out[name] = old
            continue
        keep = new.isNull() | (F.trim(new.cast("string")) == "")
        if name in LOCKED:
            keep = keep | (locked & old.isNotNull() & (old.cast("string") != ""))
        if name in checks:
            usable, stays = checks[name]
            keep = keep | ~F.coalesce(usable, F.lit(False)) | F.coalesce(stays, F.lit(False))
        out[name] = F.when(F.coalesce(keep, F.lit(True)), old).otherwise(new)
    return out


def exploded_workflows(details: DataFrame, workflows: str, overrides: list[str]) -> DataFrame:
    """One row for each workflow of a detail, or one without any; a workflow's own value of a field overrides the detail's."""
    rows = details.withColumn("_w", F.explode_outer(workflows))
    return rows.select(*[F.coalesce(F.col(f"_w.{c}"), F.col(c)).alias(c) if c in overrides else F.col(c) for c in details.columns if c != workflows])
