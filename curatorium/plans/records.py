"""Queries over records: amounts, dates, status, regions, identity, quality, merges. Japanese texts are made from the driver's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.functions import dates, lexicon, money, regions, status, text
from curatorium.operators import dedupe, quality, relations, simulator
from curatorium.plans.shared import registry, table

QUERIES, ORACLES, register = registry()

TODAY = "1998-01-15"


def _amount_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """上限 n万円 or n,000円, by the order's number, with its price in thousands."""
    orders = table(spark, sf_dir, "orders")
    n = F.floor(F.col("o_totalprice") / 1000)
    shape = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("補助上限額："), n, F.lit("万円以内"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("上限 "), n, F.lit(",000円（1件"), n, F.lit("千円）")))
    shape = shape.when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("月額"), n, F.lit("円"))).otherwise(F.concat(F.lit("補助率 2/3以内、"), n, F.lit("万5千円")))
    return orders.select("o_orderkey", n.alias("n"), shape.alias("t"))


@register("amount_variants", """WITH a AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS n, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey,
  CASE k WHEN 0 THEN n * 10000 WHEN 1 THEN n * 1000 WHEN 2 THEN n ELSE 0 END AS first_amount,
  CASE k WHEN 0 THEN n * 10000 WHEN 1 THEN n * 1000 WHEN 2 THEN n ELSE 5000 END AS largest,
  CASE k WHEN 0 THEN n * 10000 WHEN 1 THEN n * 1000 WHEN 2 THEN 0 ELSE 0 END AS labelled,
  CASE WHEN k = 2 THEN -1 WHEN k = 0 AND n > 0 THEN n * 10000 WHEN k = 1 AND n > 0 THEN n * 1000 WHEN k = 3 THEN n * 10000 + 5000 ELSE -1 END AS safe,
  CASE WHEN k = 3 THEN '2/3以内' ELSE '' END AS rate FROM a""")
def amount_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = _amount_text(spark, sf_dir)
    return rows.select("o_orderkey", money.first(t).cast("bigint").alias("first_amount"), money.largest(t).alias("largest"), money.labelled(t).alias("labelled"), F.coalesce(money.sanitised(F.lit(None).cast("int"), t)["amount"].cast("bigint"), F.lit(-1)).alias("safe"), money.rate(t).alias("rate"))


@register("amount_agreement", "SELECT o_orderkey, o_orderkey % 4 < 2 AND CAST(floor(o_totalprice / 1000) AS BIGINT) % 10 = 0 AS agrees FROM orders WHERE o_orderkey % 4 < 2")
def amount_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text states the amount of a fact, whatever the units: the fact is n千万円 written as thousands of 万円 when n ends in 0."""
    rows = _amount_text(spark, sf_dir).where("o_orderkey % 4 < 2")
    tenth = F.floor(F.col("n") / 10)
    fact = F.when(F.col("o_orderkey") % 4 == 0, F.concat(tenth * 100000, F.lit("円"))).otherwise(F.concat(tenth, F.lit("万円")))
    return rows.select("o_orderkey", quality.same_amount(F.col("t"), fact).alias("agrees"))


def _period_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period texts in era years: a range with the end's year left out, a deadline, an open end, or a range that is over by its words."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).withColumn("e", F.last_day(F.add_months("d", 1)))
    era = lambda d: F.concat(F.lit("平成"), F.year(d) - 1988, F.lit("年"), F.month(d), F.lit("月"), F.day(d), F.lit("日"))
    late = F.concat(F.year("e"), F.lit("年"), F.month("e"), F.lit("月"), F.day("e"), F.lit("日"))
    t = F.when(F.col("o_orderkey") % 4 == 0, F.concat(era(F.col("d")), F.lit("から"), late, F.lit("まで"))).when(F.col("o_orderkey") % 4 == 1, F.concat(late, F.lit("必着")))
    t = t.when(F.col("o_orderkey") % 4 == 2, F.concat(era(F.col("d")), F.lit("から予算に達するまで"))).otherwise(F.concat(late, F.lit("で受付終了")))
    return rows.withColumn("t", t)


_DATES_SQL = "WITH a AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS d, last_day(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE)) AS e FROM orders)"


@register("era_dates", f"{_DATES_SQL} SELECT o_orderkey, CASE k WHEN 0 THEN 2 ELSE 1 END AS n, CAST(CASE WHEN k = 2 THEN d ELSE e END AS VARCHAR) AS last FROM a WHERE year(d) >= 1990")
def era_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _period_text(spark, sf_dir).where(F.year("d") >= 1990).withColumn("found", dates.in_text(F.col("t"), F.lit(TODAY).cast("date")))
    return rows.select("o_orderkey", F.size("found").alias("n"), F.element_at("found", -1).cast("string").alias("last"))


@register("expiry", f"""{_DATES_SQL} SELECT o_orderkey, CASE WHEN k = 2 THEN d ELSE e END < DATE '{TODAY}' AS expired,
  CASE WHEN k = 2 THEN date_diff('day', DATE '1970-01-01', d) ELSE date_diff('day', DATE '1970-01-01', e) END * 86400000 AS sort_key FROM a WHERE year(d) >= 1990""")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    rows = _period_text(spark, sf_dir).where(F.year("d") >= 1990)
    return rows.select("o_orderkey", status.is_closed(F.lit(None).cast("date"), F.col("t"), F.lit("不明"), today).alias("expired"), status.sort_millis(F.lit(None).cast("date"), F.col("t"), today).alias("sort_key"))


_SHIFT = 30


@register("status_by_text", f"""{_DATES_SQL}, b AS (SELECT o_orderkey, k, CAST(d + INTERVAL {_SHIFT} YEAR AS DATE) AS d, last_day(CAST(CAST(d + INTERVAL {_SHIFT} YEAR AS DATE) + INTERVAL 1 MONTH AS DATE)) AS e FROM a)
SELECT o_orderkey, CASE WHEN k <> 2 AND e < DATE '2026-06-01' THEN '受付終了' WHEN k IN (0, 2) AND d > DATE '2026-06-01' THEN '予告' ELSE '公募中' END AS status FROM b""")
def status_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status from period texts, moved on by _SHIFT years, as of a fixed day."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 12 * _SHIFT).alias("d")).withColumn("e", F.last_day(F.add_months("d", 1)))
    era = F.concat(F.lit("令和"), F.year("d") - 2018, F.lit("年"), F.month("d"), F.lit("月"), F.day("d"), F.lit("日"))
    late = F.concat(F.year("e"), F.lit("年"), F.month("e"), F.lit("月"), F.day("e"), F.lit("日"))
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.concat(era, F.lit("から"), late, F.lit("まで"))).when(k == 1, F.concat(late, F.lit("必着"))).when(k == 2, F.concat(era, F.lit("から予算に達するまで"))).otherwise(F.concat(late, F.lit("締切")))
    none = F.lit(None).cast("string")
    return rows.select("o_orderkey", status.by_text(F.lit("不明"), t, none, none, F.lit("2026-06-01"))["status"].alias("status"))


@register("status_by_instants", f"""SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 30 DAY < TIMESTAMP '{TODAY}' THEN '受付終了' WHEN o_orderdate > TIMESTAMP '{TODAY}' THEN '予告' ELSE '公募中' END AS status FROM orders""")
def status_by_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.to_timestamp_ntz(F.col("o_orderdate").cast("string"))
    end = start + F.expr("INTERVAL 30 DAYS")
    return table(spark, sf_dir, "orders").select("o_orderkey", status.by_instants(start, end, F.lit(""), F.to_timestamp_ntz(F.lit(TODAY))).alias("status"))


@register("region_gate", """WITH a AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '全国' WHEN 1 THEN '愛媛県松山市' WHEN 2 THEN '全国' WHEN 3 THEN '香川県' ELSE '四国地方' END AS region, p_partkey % 5 AS k FROM part)
SELECT p_partkey, k IN (0, 1, 4) AS keep, CASE k WHEN 0 THEN '全国対象' WHEN 2 THEN '全国表記ありだが他県名を含む' WHEN 3 THEN '愛媛・四国・全国対象ではない' ELSE '愛媛・四国対象' END AS reason, CASE WHEN k = 1 THEN '松山市' ELSE '' END AS municipality FROM a""")
def region_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    region = F.when(k.isin(0, 2), "全国").when(k == 1, "愛媛県松山市").when(k == 3, "香川県").otherwise("四国地方")
    gate = regions.gate(region, F.when(k == 2, "東京都の補助金").otherwise(F.col("p_name")), F.lit(""), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", gate["keep"].alias("keep"), gate["reason"].alias("reason"), regions.first_contained(region, lexicon.MUNICIPALITIES).alias("municipality"))


@register("name_categories", """SELECT s_suppkey, list_sort(CASE WHEN len(list_filter(['1', '3', '7'], lambda x: contains(s_name, x))) > 0 THEN list_filter(['1', '3', '7'], lambda x: contains(s_name, x)) ELSE ['other'] END) AS categories FROM supplier""")
def name_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_sort(regions.categories(F.col("s_name"), ("1", "3", "7"), "other")).alias("categories"))


@register("record_keys", """SELECT p_partkey, replace(p_brand, ' ', '') || '::' || replace(p_name, ' ', '') || '::2026::' || CASE WHEN p_size > 25 THEN '2026-04-01~' ELSE '通年' END AS crawl_key,
  replace(p_brand, ' ', '') || '::' || replace(p_name, ' ', '') || '::2026::' || CASE WHEN p_size > 25 THEN '2026-04-01' ELSE '' END || '::' AS import_key FROM part""")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, none = F.when(F.col("p_size") > 25, "2026-04-01"), F.lit(None).cast("string")
    year = F.lit("2026")
    return table(spark, sf_dir, "part").select(
        "p_partkey", dedupe.crawl_key(F.col("p_brand"), F.col("p_name"), year, start, none, F.lit("通 年")).alias("crawl_key"), dedupe.import_key(F.col("p_brand"), F.col("p_name"), year, start, none).alias("import_key")
    )


@register("exact_duplicates", "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")


@register("fuzzy_groups")
def fuzzy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy duplicate groups of parts: titles made of brand, name and number, external ids shared by some."""
    parts = table(spark, sf_dir, "part")
    key, block = F.col("p_partkey"), F.floor(F.col("p_partkey") / 12)  # a programme and its copies
    rows = parts.select(
        key.alias("id"), key.alias("seq"), F.when(key % 4 == 0, F.concat(F.lit("x"), block)).alias("ext"), F.array(F.concat(F.lit("a.jp/"), block, F.lit("/"), F.floor(key % 12 / 3))).alias("urls"),
        dedupe.title_key(F.concat(F.format_string("%08d", block), "p_brand", F.lit(" "), "p_name", F.lit("補助金"))).alias("title"), dedupe.loose_key(F.col("p_brand")).alias("org"), dedupe.loose_key(F.col("p_type")).alias("region"),
    )
    return dedupe.fuzzy_groups(rows)


_FLAT = "regexp_replace(lower(trim(regexp_replace(text, '[\\s\u000b 　]+', ' ', 'g'))), '[\\s。、，．・：:；;「」『』（）()【】!?！？_/\\[\\]-]', '', 'g')"


@register("most_similar", f"""WITH a AS (SELECT doc_id AS id, {_FLAT} AS t FROM documents WHERE length(trim(regexp_replace(text, '[\\s\u000b 　]+', ' ', 'g'))) >= 1200),
s AS (SELECT DISTINCT id, substr(t, i, 14) AS piece FROM a, LATERAL (SELECT unnest(range(1, length(t) - 12, 2)) AS i)), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT x.id, y.id AS other_id, count(*) AS c FROM s x JOIN s y ON x.piece = y.piece AND x.id <> y.id GROUP BY x.id, y.id)
SELECT id, other_id, round(score, 9) AS score FROM (SELECT c.id, other_id, c / (n1.n + n2.n - c) AS score, row_number() OVER (PARTITION BY c.id ORDER BY c / (n1.n + n2.n - c) DESC, other_id) AS k FROM c JOIN n n1 ON c.id = n1.id JOIN n n2 ON c.other_id = n2.id) WHERE k = 1""")
def most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedupe.most_similar(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return rows.withColumn("score", F.round("score", 9))


_ISSUE_CASES = """CASE WHEN p_size % 3 = 0 THEN 'missing_purpose_tags' END, CASE WHEN p_size % 4 = 0 THEN 'missing_industry_tags' END, CASE WHEN p_size % 5 = 0 THEN 'missing_official_url' END,
  CASE WHEN p_size % 6 = 0 THEN 'missing_amount' END, CASE WHEN p_size % 7 = 0 THEN 'unclear_application_period' END, CASE WHEN p_size % 7 <> 0 AND p_size % 2 = 0 THEN 'deadline_passed' END,
  CASE WHEN p_size % 11 = 0 THEN 'duplicate_candidate' END, CASE WHEN p_size % 13 = 0 THEN 'admin_review_note' END"""


@register("quality_issues", f"""WITH a AS (SELECT p_partkey, list_filter([{_ISSUE_CASES}], lambda x: x IS NOT NULL) AS codes FROM part)
SELECT p_partkey, array_to_string(codes, ',') AS codes, CASE WHEN list_has_any(codes, ['missing_official_url', 'deadline_passed', 'duplicate_candidate']) THEN '要確認' WHEN len(codes) > 0 THEN '情報不足' ELSE '良好' END AS grade,
  len(list_filter(codes, lambda x: x NOT IN ('duplicate_candidate', 'admin_review_note'))) AS n_publish, list_has_any(codes, ['missing_purpose_tags', 'missing_industry_tags']) AS missing_tags FROM a""")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    tags = lambda m: F.when(n % m == 0, F.array().cast("array<string>")).otherwise(F.array("p_type"))
    period = F.when(n % 7 == 0, "公式ページをご確認ください").when(n % 2 == 0, "令和7年4月1日から2025年5月31日まで").otherwise("2027年3月31日まで")
    fields = {
        "purposes": tags(3), "industries": tags(4), "official_url": F.when(n % 5 == 0, " ").otherwise("https://a.jp/"), "amount_text": F.when(n % 6 == 0, "未記載").otherwise("50万円"), "period_text": period,
        "published": F.lit(True), "duplicate_of_id": F.when(n % 11 == 0, F.col("p_partkey")), "note": F.when(n % 13 == 0, "見直し"),
    }
    rows = table(spark, sf_dir, "part").select("p_partkey", quality.issues(fields, F.lit("2026-06-01").cast("date")).alias("codes"))
    codes = F.col("codes")
    return rows.select("p_partkey", F.array_join("codes", ",").alias("codes"), quality.grade(codes).alias("grade"), F.size(quality.publish_issues(codes)).alias("n_publish"), quality.passes(codes, "missing_tags").alias("missing_tags"))


@register("review_scores", """SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, 100 - 12 * (l_linenumber % 5)) AS coverage, greatest(0, CASE WHEN l_quantity > 20 THEN 100 ELSE 60 END - 20 * (l_linenumber % 3) - 35 * (l_linenumber % 2)) AS grounding,
  CASE WHEN l_quantity * 2 >= 90 THEN 'A' WHEN l_quantity * 2 >= 80 THEN 'B' WHEN l_quantity * 2 >= 60 THEN 'C' ELSE 'D' END AS letter FROM lineitem""")
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    missing = F.slice(F.array(*[F.lit(x) for x in "abcd"]), F.lit(1), n % 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", quality.coverage_score(missing).alias("coverage"), quality.grounding_score(n % 3, n % 2, F.col("l_quantity") > 20).alias("grounding"), quality.letter(F.col("l_quantity") * 2).alias("letter"))


_MERGE_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS title, CASE WHEN c_custkey % 3 = 0 THEN '50万円' WHEN c_custkey % 5 = 0 THEN '公募要領参照' ELSE c_mktsegment || '円' END AS amount_text FROM customer"""


@register("safe_merge", _MERGE_SQL)
def safe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results merged into records: locked titles stay, concrete amounts stay, empty results change nothing."""
    k = F.col("c_custkey")
    current = {"title": F.col("c_name"), "amount_text": F.when(k % 3 == 0, "50万円").otherwise("公募要領参照")}
    found = {"title": F.upper("c_name"), "amount_text": F.when(k % 5 == 0, "").otherwise(F.concat("c_mktsegment", F.lit("円")))}
    checks = {"amount_text": (F.lit(True), current["amount_text"].rlike("[0-9]"))}
    return table(spark, sf_dir, "customer").select("c_custkey", *[v.alias(c) for c, v in relations.merged(current, found, k % 2 == 0, checks).items()])


@register("exploded_workflows", """WITH w AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS own FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 40) ON o_orderkey = l_orderkey)
SELECT o_orderkey, o_orderpriority, coalesce(own, o_orderstatus) AS o_orderstatus, count(*) AS n FROM w GROUP BY ALL""")
def exploded_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details with lists of workflows to one row each, a workflow's own status winning."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("o_orderstatus")).alias("w"))
    details = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").join(lines.groupBy("o_orderkey").agg(F.collect_list("w").alias("workflows")), "o_orderkey", "left")
    return relations.exploded_workflows(details, "workflows", ["o_orderstatus"]).groupBy("o_orderkey", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


def _simulated_sql() -> str:
    def parts(prefix, soft, pc, reg, cost):
        return f"CAST(floor({soft}) AS BIGINT) AS {prefix}_soft, CAST(floor({soft} + {pc} + {reg}) AS BIGINT) AS {prefix}_total, greatest({cost} - floor({soft} + {pc} + {reg}), 0.0) AS {prefix}_self"

    two = "(CAST(2.0 AS DOUBLE) / 3)"
    normal = f"least(s * CASE WHEN k % 2 = 0 THEN {two} ELSE 0.5 END, CASE WHEN k % 3 = 0 THEN 4500000.0 ELSE 1499999.0 END)"
    small = f"CASE WHEN s <= 625000 THEN s * CAST(0.8 AS DOUBLE) ELSE 500000 + (s - 625000) * {two} END"
    other = f"CASE WHEN s <= 666666 THEN s * CAST(0.75 AS DOUBLE) ELSE 500000 + (s - 666666) * {two} END"
    invoice = f"least(CASE WHEN k % 2 = 0 THEN {small} ELSE {other} END, CASE WHEN k % 3 = 0 THEN 500000.0 ELSE 3500000.0 END)"
    electronic = f"least(s * CASE WHEN k % 2 = 0 THEN {two} ELSE 0.5 END, 3500000.0)"
    return f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey AS k, CAST(round(l_extendedprice) AS DOUBLE) * 50 AS s, CAST(l_quantity AS DOUBLE) * 10000 AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {parts('normal', normal, '0', '0', 's')}, {parts('invoice', invoice, 'least(p * 0.5, 100000.0)', 'least(p * 0.5, 200000.0)', 's + p + p')}, {parts('electronic', electronic, '0', '0', 's')} FROM a"""


@register("grant_simulator", _simulated_sql())
def grant_simulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, soft, gear = F.col("l_partkey"), F.round("l_extendedprice") * 50, F.col("l_quantity").cast("double") * 10000
    frames = {"normal": simulator.normal(soft, k % 3 == 0, k % 2 == 0), "invoice": simulator.invoice(soft, gear, gear, k % 2 == 0, k % 3 == 0), "electronic": simulator.electronic(soft, k % 2 == 0)}
    out = [v for name, f in frames.items() for v in (f["subsidy_soft"].alias(f"{name}_soft"), f["total_subsidy"].alias(f"{name}_total"), f["self_pay"].alias(f"{name}_self"))]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *out)


@register("text_lines", """WITH a AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents), b AS (SELECT doc_id, trim(line) AS line FROM a WHERE trim(line) <> '')
SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct, max(length(line)) AS longest FROM b GROUP BY doc_id""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    return rows.select("doc_id", F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_distinct"), F.array_max(F.transform("lines", F.length)).alias("longest"))


@register("truncated", "SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\u000b 　]+', ' ', 'g')) AS t FROM documents)")
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 60).alias("short"))
