"""Readers and writers of the portal's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text, urls


def read_url_report(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a search-console export: quoted CSV whose URL column is found by its header; blank rows are dropped."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    plain = {c: "".join(c.replace("﻿", "").split()).lower() for c in rows.columns}
    name = next((c for c, p in plain.items() if p in lexicon.URL_HEADERS), None) or next((c for c, p in plain.items() if "url" in p or "ページ" in p), None)
    if name is None:
        raise ValueError(f"no URL column among {rows.columns}")
    return rows.select(F.trim(F.col(f"`{name}`")).alias("url")).where("url <> ''")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Crawl seeds from a JSON object of lists of addresses by name, with their defaults."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "urls"))
    return seeds(rows.select("name", F.explode("urls").alias("url")))


def seeds(rows: DataFrame) -> DataFrame:
    """(name, url) to typed seeds."""
    url = F.trim("url")
    kind = F.when(url.rlike(r"(?i)/(?:life|kurashi|sangyo|mokuteki)/"), "category_index").otherwise("municipal_index")
    host = urls.host(url)
    return rows.select(
        "name", url.alias("url"), kind.alias("type"), F.lit("愛媛県").alias("prefecture"), F.col("name").alias("municipality"), F.lit("official_municipality").alias("source_trust"), F.lit(True).alias("enabled"),
        F.lit(True).alias("crawl_links"), F.lit(2).alias("max_depth"), F.when(host != "", F.array(host)).otherwise(F.array().cast("array<string>")).alias("allowed_domains"), F.lit("child_detail_only").alias("official_url_policy"),
    ).where("url <> ''")


def sitemap_entry(location: Column, changed: Column) -> Column:
    """An entry of the sitemap; without a date it has no lastmod."""
    day = F.date_format(changed, "yyyy-MM-dd")
    return F.concat(F.lit("<url><loc>"), text.escaped_xml(location), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))


def indexable(rows: DataFrame, *fields: str) -> DataFrame:
    """Records without marks of tests or practice."""
    return rows.where(~F.concat_ws(" ", *fields).rlike("(?i)テスト|練習|サンプル|test"))


def write_sitemap(rows: DataFrame, path: str) -> None:
    """One entry a line, in order of the location, in as many files as there are partitions."""
    rows.select(sitemap_entry(F.col("location"), F.col("changed")).alias("value")).repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").text(path)


def write_route_map(ids: DataFrame, path: str) -> None:
    """Lines of a server map from each distinct numeric id to its page, by number."""
    rows = ids.select(F.col("id").cast("bigint").alias("id")).where("id is not null").distinct()
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    rows.select(F.format_string("/subsidy/%d /subsidy/%d.html;", "id", "id").alias("value")).write.mode("overwrite").text(path)


def write_details(rows: DataFrame, path: str, form: str = "json") -> None:
    """Report rows as JSON lines or as quoted CSV with a header."""
    if form == "csv":
        rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    else:
        rows.write.mode("overwrite").json(path)


def append_audit(rows: DataFrame, path: str, run_id: str) -> None:
    """Audit rows of a run, in a partition of its own, so that running it again replaces only its rows."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def summary_from_log(value: Column, patterns: list[str]) -> Column:
    """The first counter that a log text states in one of the forms."""
    return F.coalesce(*[F.regexp_extract(value, p, 1).try_cast("int") for p in patterns])
