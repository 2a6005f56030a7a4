"""Queries over runs: records of unknown shape, a crawl's order within budgets, and a run's counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.operators import crawl, payloads, statistics
from curatorium.operators.graph import written
from curatorium.plans.shared import quoted, registry, table

QUERIES, ORACLES, register = registry()

#: Answers as services and language models send them; # stands for an order's key.
_ANSWERS = (
    '{"result":[{"id":"#","amount":"5万円","region":"松山市","target_expenses":"設備費、広告費,旅費"}]}', '```json\n{"data":{"subsidyId":"#","applicationPeriod":"通年","target_entities":["法人"," 個人 ",""]}}\n```', 'ここに結果: {"items":[{"grant_id":#,"subsidy_rate":0.5},{"grantId":"x#"},{"name":"no id"}]} 以上',
    '{"result": [ {"id": "#"', '{"results":[]}', '{"subsidies":[{"management_number":"#","region_text":"","region":"b","max_amount":"","amount":"7","target_expenses_arr":["a","b"],"target_expenses":"c"}]}', None, "no JSON at all #", '{"result":{"id":"","subsidy_id":"#"}}', '{"data":[{"title":"only"}]}',
)
_RAW = f"replace(CASE o_orderkey % {len(_ANSWERS)} {' '.join(f'WHEN {k} THEN {quoted(a)}' for k, a in enumerate(_ANSWERS) if a)} END, '#', CAST(o_orderkey AS VARCHAR))"


def _sql_first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(r ->> '$.{n}', '')" for n in names) + ")"


def _sql_list(*names: str) -> str:
    tidy = lambda x: f"list_filter(list_transform({x}, lambda y: trim(coalesce(y, ''))), lambda y: y <> '')"
    found = []
    for n in names:
        found.append(f"CASE WHEN json_type(r, '$.{n}') = 'ARRAY' THEN {tidy(f'CAST(json_extract(r, $${n}$$) AS VARCHAR[])')} WHEN json_type(r, '$.{n}') = 'VARCHAR' THEN {tidy(f"regexp_split_to_array(r ->> '$.{n}', '[、,\\n]')")} END")
    return "coalesce(" + ", ".join(f"CASE WHEN len({f}) > 0 THEN {f} END" for f in found) + ", [])"


_PAYLOAD_SQL = rf"""
WITH a AS (SELECT o_orderkey AS k, {_RAW} AS raw FROM orders),
b AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '^```(?:json)?', ''), '```$', ''), chr(10) || ' ') AS bare FROM a),
c AS (SELECT *, CASE WHEN json_valid(bare) THEN bare WHEN json_valid(regexp_extract(bare, '(?s)\{{.*\}}')) THEN regexp_extract(bare, '(?s)\{{.*\}}') END AS j FROM b),
d AS (SELECT *, CASE {" ".join(f"WHEN json_type(j, '$.{key}') = 'ARRAY' THEN json_extract(j, '$.{key}[*]')" for key in payloads.LIST_KEYS)} {" ".join(f"WHEN json_type(j, '$.{key}') = 'OBJECT' THEN [json_extract(j, '$.{key}')]" for key in payloads.ONE_KEYS)} ELSE [] END AS rs FROM c),
e AS (SELECT *, list_filter(rs, lambda r: {_sql_first(*payloads.ID_KEYS)} IS NOT NULL) AS good FROM d),
f AS (SELECT k, unnest(good) AS r, unnest(range(len(good))) AS place FROM e)
SELECT k, CAST(place AS INTEGER) AS place, {_sql_first(*payloads.ID_KEYS)} AS id, {", ".join(f"{(_sql_list if n in payloads.LISTED else _sql_first)(n, *o)} AS {n}" for n, o in payloads.ALIASES.items())}, NULL AS reason FROM f
UNION ALL SELECT k, NULL, NULL, {", ".join("NULL" for _ in payloads.ALIASES)}, CASE WHEN raw IS NULL THEN 'empty' WHEN j IS NULL THEN 'not JSON' WHEN len(rs) = 0 THEN 'no record' ELSE 'no id' END FROM e WHERE len(good) = 0"""


@register("payload_records", _PAYLOAD_SQL)
def payload_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of answers of many shapes, and the answers without any with the reason."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_RAW.replace("VARCHAR", "STRING").replace("\n", "\\n")).alias("raw"))
    good, bad = payloads.records(rows)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.drop("raw"), allowMissingColumns=True)


_LEVEL = """{name}_all AS (SELECT l.target AS url, p.seed, p.url AS found_on, p.most, list_append(p.path, l.pos) AS path FROM l JOIN {parent} p ON l.source = p.url WHERE p.outcome = 'visited' AND p.most >= {d}),
{name}_new AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY path) AS n FROM {name}_all WHERE url NOT IN (SELECT url FROM {known})),
{name}_turn AS (SELECT *, url LIKE '%7' AS refused, sum(CASE WHEN url LIKE '%7' THEN 0 ELSE 1 END) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS turn FROM {name}_new WHERE n = 1),
{name} AS (SELECT url, seed, found_on, most, path, {d} AS depth, CASE WHEN refused THEN 'ends with 7' WHEN turn + (SELECT count(*) FROM {known} WHERE outcome = 'visited') <= 200 THEN 'visited' ELSE 'budget of the run' END AS outcome FROM {name}_turn)"""
_CRAWL_SQL = f"""
WITH l AS (SELECT source, target, min(pos) AS pos FROM (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_orderkey * 10 + l_linenumber AS pos FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, l_orderkey * 10 + l_linenumber FROM lineitem) GROUP BY source, target),
k0 AS (SELECT url, url AS seed, CAST(NULL AS VARCHAR) AS found_on, most, [CAST(place AS BIGINT)] AS path, 0 AS depth, CASE WHEN url LIKE '%7' THEN 'ends with 7' ELSE 'visited' END AS outcome FROM (VALUES ('s3', 0, 2), ('s7', 1, 2), ('s1', 2, 1)) AS s(url, place, most)),
{_LEVEL.format(name="k1", parent="k0", known="k0", d=1)}, k01 AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1), {_LEVEL.format(name="k2", parent="k1", known="k01", d=2)}
SELECT url, seed, found_on, CAST(depth AS INTEGER) AS depth, path, outcome FROM (SELECT * FROM k01 UNION ALL SELECT * FROM k2)"""


@register("crawl_order", _CRAWL_SQL)
def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts as pages that link one another: what a queue of 200 visits meets from three seeds, and in which order."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    links = rows.select(F.col("s").alias("source"), F.col("p").alias("target"), "pos").unionByName(rows.select(F.col("p").alias("source"), F.col("s").alias("target"), "pos"))
    seeds = spark.createDataFrame([("s3", 0, 2), ("s7", 1, 2), ("s1", 2, 1)], "url string, place int, max_depth int")
    return crawl.crawl(links.groupBy("source", "target").agg(F.min("pos").alias("pos")), seeds, F.when(F.col("url").endswith("7"), "ends with 7"), max_urls=200)


_ACTIONS = ("skip", "publish", "reject", "error", "insert", "update", "not_found", "exists", "review", "noise", "save", "would_publish")
_ACTION_SQL = f"list_extract([{', '.join(map(quoted, _ACTIONS))}], CAST(o_custkey % {len(_ACTIONS)} AS INTEGER) + 1)"
_COUNTERS_SQL = ", ".join(
    ["count(*) FILTER (action <> 'skip') AS attempted_urls", "count(*) FILTER (action = 'skip') AS skipped_urls", "count(*) FILTER (action IN ('error', 'not_found')) AS error_urls", *[f"count(*) FILTER (action = '{v}') AS {n}" for n, v in statistics.ACTIONS.items()],
     "CAST(sum(links) AS BIGINT) AS extracted_links", "CAST(sum(pdf) AS BIGINT) AS parsed_pdf"]
)
_LOG_SQL = f"WITH r AS (SELECT {_ACTION_SQL} AS action, o_orderkey % 7 AS links, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS pdf, 'https://seed.example.jp/' || o_orderkey % 9 AS seed_url FROM orders)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("o_custkey") % len(_ACTIONS) + 1).cast("int"))
    seed = F.concat(F.lit("https://seed.example.jp/"), (key % 9).cast("string"))
    return table(spark, sf_dir, "orders").select(action.alias("action"), (key % 7).alias("extracted_links"), (key % 5 == 0).cast("int").alias("parsed_pdf"), seed.alias("seed_url"), (key % 3).alias("depth"), F.concat(seed, F.lit("/")).alias("final_url"))


@register("run_statistics", f"{_LOG_SQL} SELECT 'run' AS scope, {_COUNTERS_SQL} FROM r UNION ALL SELECT seed_url, {_COUNTERS_SQL} FROM r GROUP BY seed_url")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a crawl's log, gathered while the log is written, and those of each seed from the written log."""
    rows = _log(spark, sf_dir)
    counters = statistics.crawl_counters(rows.columns)
    kept, seen = statistics.observed(rows, counters)
    log = written(kept)
    whole = spark.createDataFrame([("run", *[int(seen.get[n]) for n in counters])], "scope string, " + ", ".join(f"{n} bigint" for n in counters))
    seeds = statistics.per_seed(log).withColumnRenamed("seed_url", "scope")
    return whole.unionByName(seeds.select(*whole.columns))
