"""Queries of the serving side: search, facets, orders, pages, suggestions, and lookups between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatorium.operators import quality, relations, search
from curatorium.plans.shared import registry, table

QUERIES, ORACLES, register = registry()


@register("keyword_search", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'thation') OR contains(lower(source), 'thation')")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.keyword_filter(docs, "Thation", F.col("text"), F.col("source")).select("doc_id", "source")


_COLOURS = ("red", "blue", "green", "hot", "small")


@register("facet_counts", f"""WITH d AS (SELECT unnest({list(_COLOURS)}) AS value),
c AS (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS value FROM part WHERE p_type = 'ECONOMY')
SELECT 'name' AS facet, d.value, count(c.value) AS n FROM d LEFT JOIN c ON d.value = c.value GROUP BY d.value
UNION ALL SELECT 'brand', p_brand, count(*) FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'blue') GROUP BY p_brand""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two facets, each under the other facets' choice: a fixed domain with zeros, and an open one."""
    parts = table(spark, sf_dir, "part")
    by_name = search.facet_counts(parts, F.split("p_name", " "), list(_COLOURS), F.col("p_type") == "ECONOMY")
    by_brand = search.facet_counts(parts, F.array("p_brand"), None, F.contains("p_name", F.lit("red")) | F.contains("p_name", F.lit("blue")))
    return by_name.withColumn("facet", F.lit("name")).unionByName(by_brand.withColumn("facet", F.lit("brand")))


@register("page_by_amount", """SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n BETWEEN 17 AND 24""")
def page_by_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return search.page_of(rows, 3, 8, *search.missing_last(F.col("c_acctbal"), True), F.col("c_custkey")).select("c_custkey", "c_acctbal")


@register("page_bounds", """WITH t AS (SELECT c_mktsegment, count(*) AS total FROM customer GROUP BY c_mktsegment)
SELECT c_mktsegment, total, CAST(ceil(total / 8.0) AS BIGINT) AS total_pages, CASE WHEN total = 0 THEN 0 ELSE 17 END AS start_count, least(24, total) AS end_count FROM t""")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("total"))
    return rows.withColumns(search.page_bounds(F.col("total"), F.lit(3), 8))


@register("first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@register("merge_sources", """WITH u AS (SELECT o_custkey AS k, o_orderkey AS id, 0 AS src, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1, o_totalprice FROM orders WHERE o_orderstatus <> 'F')
SELECT k, id, src, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, id) AS n FROM u) WHERE n = 1""")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources as one, the first source's row winning for each key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    one = orders.where("o_orderstatus = 'F'").withColumn("src", F.lit(0))
    two = orders.where("o_orderstatus <> 'F'").withColumn("src", F.lit(1))
    both = one.unionByName(two).groupBy("k").agg(F.min(F.struct("src", "id", "v")).alias("r"))
    return both.select("k", "r.id", "r.src", "r.v")


_FEATURES = [("metal", ["ECONOMY"], ["Brand#1", "Brand#2"], ["bolt", "gear"], 10), ("bright", ["PROMO", "ECONOMY"], ["Brand#3"], ["red", "blue"], 30), ("tiny", ["SMALL"], ["Brand#4"], ["small", "ring"], 20), ("big", ["LARGE"], [], ["widget"], 5)]
_FEATURE_SQL = " UNION ALL ".join(f"SELECT '{s}' AS slug, {p}::VARCHAR[] AS pt, {i}::VARCHAR[] AS it, {w}::VARCHAR[] AS kw, {n} AS priority" for s, p, i, w, n in _FEATURES)


@register("suggestions", f"""WITH f AS ({_FEATURE_SQL}), s AS (SELECT p_partkey, slug, priority, 4 * CAST(list_contains(pt, p_type) AS INT) + 5 * CAST(list_contains(it, p_brand) AS INT) + len(list_filter(kw, lambda w: contains(p_name, w))) AS score FROM part, f)
SELECT p_partkey, slug, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, priority DESC, slug) AS rank FROM s WHERE score >= 3) WHERE rank <= 3""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = spark.createDataFrame(_FEATURES, "slug string, purpose_tags array<string>, industry_tags array<string>, keywords array<string>, priority int")
    return search.suggestions(table(spark, sf_dir, "part"), features, "p_partkey", F.array("p_type"), F.array("p_brand"), F.col("p_name"))


@register("landing_counts", f"""WITH f AS ({_FEATURE_SQL}) SELECT slug, count(p_partkey) AS n FROM f LEFT JOIN part ON list_contains(pt, p_type) OR list_contains(it, p_brand) OR len(list_filter(kw, lambda w: contains(p_name, w))) > 0 GROUP BY slug""")
def landing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items of each landing page, pages without any included; the list of pages is written by hand."""
    features = spark.createDataFrame(_FEATURES, "slug string, pt array<string>, it array<string>, kw array<string>, priority int")
    pairs = table(spark, sf_dir, "part").crossJoin(F.broadcast(features))
    hit = F.array_contains("pt", F.col("p_type")) | F.array_contains("it", F.col("p_brand")) | F.exists("kw", lambda w: F.contains("p_name", w))
    return features.select("slug").join(pairs.where(hit).groupBy("slug").agg(F.count("*").alias("n")), "slug", "left").fillna(0, "n")


@register("inferred_tags", """WITH r AS (SELECT 'metal' AS tag, 1 AS place, ['bolt', 'gear', 'small'] AS kw UNION ALL SELECT 'colour', 2, ['red', 'blue', 'green'] UNION ALL SELECT 'warm', 3, ['hot', 'red']),
s AS (SELECT p_partkey, tag, place, len(list_filter(kw, lambda w: contains(p_name, w))) AS hits FROM part, r)
SELECT p_partkey, tag, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY hits DESC, place) AS rank FROM s WHERE hits > 0) WHERE rank <= 2""")
def inferred_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("metal", 1, ["bolt", "gear", "small"]), ("colour", 2, ["red", "blue", "green"]), ("warm", 3, ["hot", "red"])], "tag string, place int, keywords array<string>")
    return search.inferred_tags(table(spark, sf_dir, "part"), rules, "p_partkey", F.col("p_name"), 2)


@register("lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@register("child_counts", "SELECT c_custkey, n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON c_custkey = o_custkey")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.with_count(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "n_orders")


@register("ordered_bridge", """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_name, 'ID ' || l_partkey) AS title FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey WHERE l_returnflag = 'R'""")
def ordered_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge rows with their targets' titles; a target that is gone leaves its number."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return lines.join(parts, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("p_name", F.concat(F.lit("ID "), "l_partkey")).alias("title"))


@register("uncovered_top", """SELECT doc_id, score FROM (SELECT doc_id, CAST(trim(text) <> '' AS INT) + CAST(trim(lang) <> '' AS INT) + CAST(trim(source) <> '' AS INT) AS score FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) ORDER BY score DESC, doc_id LIMIT 10""")
def uncovered_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", quality.completeness(F.col("text"), F.col("lang"), F.col("source")).alias("score"))
    return relations.uncovered(docs, table(spark, sf_dir, "labels"), "doc_id", 10, F.col("score").desc(), F.col("doc_id"))


@register("visible_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    return relations.visible(lines, table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderstatus") == "F").withColumnRenamed("o_orderkey", "l_orderkey")


@register("existence_flags", """SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS has_a, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') AS is_building FROM orders""")
def existence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return relations.with_flag(relations.with_flag(orders, lines, ["o_orderkey"], "has_a"), building, ["o_custkey"], "is_building").drop("o_custkey")


@register("self_reference", """SELECT a.o_orderkey, a.o_orderkey // 2 AS target, a.o_orderkey // 2 <> a.o_orderkey AND b.o_orderkey IS NOT NULL AS valid, b.o_orderstatus AS target_status FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey // 2""")
def self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row's duplicate target exists and is another row, with the target's status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rows = orders.select("o_orderkey", F.floor(F.col("o_orderkey") / 2).alias("target"))
    targets = orders.select(F.col("o_orderkey").alias("target"), F.col("o_orderstatus").alias("target_status"), F.lit(True).alias("_is"))
    return rows.join(targets, "target", "left").select("o_orderkey", "target", ((F.col("target") != F.col("o_orderkey")) & F.coalesce("_is", F.lit(False))).alias("valid"), "target_status")


_UPSERT_SQL = """WITH a AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.name ELSE a.name END AS name, CASE WHEN b.id IS NOT NULL THEN b.bal ELSE a.bal END AS bal,
  CASE WHEN b.id IS NULL THEN 'kept' WHEN a.id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM a FULL JOIN b ON a.id = b.id"""


@register("upsert", _UPSERT_SQL)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    incoming = rows.where("id % 2 = 0").select("id", F.upper("name").alias("name"), (F.col("bal") + 1).alias("bal"))
    return relations.upserted(rows.where("id % 3 <> 0"), incoming, ["id"])


@register("run_counters", """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, max(value) AS top FROM events GROUP BY user_id""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = [F.count_if(F.col("event_type") == kind).alias(name) for kind, name in (("click", "clicks"), ("view", "views"), ("error", "errors"))]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), *counted, F.max("value").alias("top"))


@register("freshness", """WITH a AS (SELECT user_id, greatest(date_diff('day', max(CAST(ts AS DATE)), DATE '2024-03-15'), 0) AS days FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, days, CASE WHEN days > 60 THEN 'stale' WHEN days > 30 THEN 'aging' ELSE 'fresh' END AS status FROM a""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("last"))
    fresh = quality.freshness(F.array("last"), F.lit("2024-03-15").cast("date"))
    return rows.select("user_id", fresh["days"].alias("days"), fresh["status"].alias("status"))


@register("nearby_turns", """SELECT conv_id, turn, string_agg(t2, '|' ORDER BY turn2) AS context FROM (SELECT a.conv_id, a.turn, b.turn AS turn2, b.role || ':' || length(b.text) AS t2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 2 WHERE a.role = 'user') GROUP BY conv_id, turn""")
def nearby_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows around each match: one before and two after, by a range of turn numbers."""
    around = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-1, 2)
    rows = table(spark, sf_dir, "conversations").withColumn("one", F.concat_ws(":", "role", F.length("text").cast("string")))
    rows = rows.withColumn("context", F.array_join(F.collect_list("one").over(around), "|"))
    return rows.where("role = 'user'").select("conv_id", "turn", "context")
