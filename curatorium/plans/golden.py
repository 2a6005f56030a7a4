"""Queries over sample texts of the kinds that feeds and pages hold, dealt over the driver's rows, and lists of records; the SQL reads the same texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatorium.functions import expenses, lexicon, periods
from curatorium.operators import gates, imports, search, stages
from curatorium.plans.shared import quoted, registry, table

QUERIES, ORACLES, register = registry()

EXPENSES = (
    "機械装置費、工事費及び旅費", "・機械装置費、補助率 2/3<br>①委託費及び謝金", "対象経費：専門家謝金／旅費。", "上限50万円", "設備、設備費、機械装置費", "1.補助対象経費：工事費。", "3年以内、材料費以内", "印刷製本費または通信運搬費並びに消耗品費",
    "<p>広告宣伝費</p><p>広報費</p>", "※システム導入費，ソフトウェア費，クラウド利用料，研修費，翻訳費，通訳費，人件費，旅費，謝金", "申請期間 4月1日", "機器", "設備・機器", "", "その他知事が必要と認める経費", "委託費、委託費", "1/2", "税込 5千円未満切捨て", "原材料費 又は 借料", "■展示会出展費",
)
PERIODS = (
    "令和6年4月1日から令和6年6月28日まで", "2026年6月30日", "2026年4月1日～6月30日", "令和元年5月1日より", "平成31年4月1日～令和2年3月31日", "随時受付 2025年4月1日から", "予算がなくなり次第終了", "対象者：2026年4月1日に住所がある方", "2025年12月5日〜2026年1月9日",
    "申請期限 令和8年2月27日", "令和7年度", "", "2026年4月1日（水）から5月29日まで", "募集期間：2025年7月1日-2025年9月30日", "第1回 2025年5月9日、第2回 2025年10月10日", "令和7年4月1日から予算に達するまで", "平成元年4月1日", "受付は2026年1月5日より2月6日まで", "12月31日", "２０２６年３月３１日まで",
)


def _dealt(spark: SparkSession, sf_dir: str, texts: tuple[str, ...]) -> DataFrame:
    """Each part with one of the texts."""
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    parts = stages.dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", (F.col("p_partkey") % len(texts)).cast("int").alias("k"))
    return parts.join(F.broadcast(rows), "k")  # some twenty rows


def _values(texts: tuple[str, ...]) -> str:
    return ", ".join(f"({k}, {quoted(t)})" for k, t in enumerate(texts))


def _words(names) -> str:
    return "[" + ", ".join(quoted(n) for n in names) + "]"


_MARKS = (r"^[・\-—◆◇■□●○◎※＊*]+", r"^[0-9]+[.)．、]", "^[①-⑳]", "^(?:及び|または|又は|並びに)", "[。．]+$")


def _stripped(x: str) -> str:
    for mark in _MARKS:
        x = f"regexp_replace({x}, {quoted(mark)}, '')"
    x = f"trim({x})"
    for label in lexicon.EXPENSE_LABELS:
        x = f"regexp_replace({x}, '^{label}[：:・]?', '')"
    return f"trim({x})"


@register("expense_items", rf"""WITH g(k, t) AS (VALUES {_values(EXPENSES)}),
f AS (SELECT k, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM g),
p AS (SELECT k, unnest(string_split_regex(t, '[、，,／/]|及び|または|又は|並びに')) AS x, generate_subscripts(string_split_regex(t, '[、，,／/]|及び|または|又は|並びに'), 1) AS i FROM f),
c AS (SELECT k, i, {_stripped('x')} AS x FROM p),
direct AS (SELECT * FROM c WHERE length(x) BETWEEN 2 AND 60 AND NOT regexp_matches(x, {quoted(lexicon.MARKUP)}) AND NOT regexp_matches(x, {quoted(lexicon.NOT_EXPENSE)})
  AND NOT (regexp_matches(x, '以内|以下|以上|未満') AND len(list_filter({_words(lexicon.EXPENSES)}, lambda w: contains(x, w))) = 0)),
found AS (SELECT k, list_filter({_words(lexicon.EXPENSES)}, lambda w: contains(t, w)) AS w FROM f),
special AS (SELECT k, list_filter(w, lambda x: NOT ((x = '設備' AND len(list_filter(w, lambda y: contains(y, '設備') AND y <> '設備')) > 0) OR (x = '機器' AND len(list_filter(w, lambda y: contains(y, '機器') AND y <> '機器')) > 0)
  OR (x = '謝金' AND list_contains(w, '専門家謝金')) OR (x = '広報費' AND list_contains(w, '広告宣伝費')) OR (x IN ('設備費', '機器費') AND list_has_any(w, {_words(lexicon.MACHINES)}))))[1:8] AS w FROM found),
every AS (SELECT k, i, x FROM direct UNION ALL SELECT k, 1000 + generate_subscripts(w, 1), unnest(w) FROM special),
once AS (SELECT k, x, min(i) AS i FROM every GROUP BY k, x), told AS (SELECT k, array_to_string(list(x ORDER BY i)[1:8], '|') AS items FROM once GROUP BY k)
SELECT p_partkey, coalesce(items, '') AS items FROM part LEFT JOIN told ON k = p_partkey % {len(EXPENSES)}""")
def expense_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, EXPENSES).select("p_partkey", F.array_join(expenses.items(F.col("t")), "|").alias("items"))


_ERAS = "list_concat(list_transform(range(1, 41), lambda n: '令和' || n || '年'), list_transform(range(1, 41), lambda n: '平成' || n || '年'))"
_DAY = "concat(substr(m, 1, 4), '-', lpad(regexp_extract(m, '年([0-9]+)月', 1), 2, '0'), '-', lpad(regexp_extract(m, '月([0-9]+)', 1), 2, '0'))"
_RANGE = "(20[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日?(?:（[^）]+）)?(?:～|〜|-|から|より)(?:(20[0-9]{2})年)?([0-9]{1,2})月([0-9]{1,2})日?"


@register("period_ends", f"""WITH g(k, t) AS (VALUES {_values(PERIODS)}),
d AS (SELECT k, translate(replace(replace(t, '令和元年', '2019年'), '平成元年', '1989年'), '０１２３４５６７８９', '0123456789') AS t FROM g),
w AS (SELECT k, list_reduce(list_prepend(t, {_ERAS}), lambda a, e: replace(a, e, (CASE WHEN starts_with(e, '令和') THEN 2018 ELSE 1988 END + CAST(regexp_extract(e, '[0-9]+') AS INTEGER)) || '年')) AS t FROM d),
r AS (SELECT k, t, list_transform(regexp_extract_all(t, '20[0-9]{{2}}年[0-9]{{1,2}}月[0-9]{{1,2}}'), lambda m: {_DAY}) AS found, regexp_matches(t, {quoted(lexicon.PAGE_OPEN_ENDED)}) AS o, t = '' OR regexp_matches(t, {quoted(lexicon.NOT_PERIOD)}) AS bad,
  regexp_extract(t, '{_RANGE}', ['y', 'm', 'd', 'z', 'n', 'e']) AS x FROM w)
SELECT p_partkey, CASE WHEN bad THEN NULL WHEN o THEN found[1] WHEN x.y <> '' THEN concat(x.y, '-', lpad(x.m, 2, '0'), '-', lpad(x.d, 2, '0')) END AS starts,
  CASE WHEN bad OR o THEN NULL WHEN x.y <> '' THEN concat(CASE WHEN x.z <> '' THEN x.z ELSE x.y END, '-', lpad(x.n, 2, '0'), '-', lpad(x.e, 2, '0')) ELSE found[-1] END AS ends, o AND NOT bad AS open_ended
FROM part JOIN r ON k = p_partkey % {len(PERIODS)}""")
def period_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _dealt(spark, sf_dir, PERIODS).withColumn("p", periods.ends(F.col("t")))
    return found.select("p_partkey", F.col("p.start").alias("starts"), F.col("p.end").alias("ends"), F.col("p.open_ended").alias("open_ended"))


_LISTS = [(m, s) for m in ("all", "open", "closed") for s in ("newest", "deadline", "amount_desc", "amount_asc", "title")]
_ITEMS = "SELECT o_orderkey AS n, o_orderstatus = 'F' AS closed, epoch_ms(o_orderdate) AS newest, epoch_ms(o_orderdate) % 7777777 AS due, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS amount, o_orderpriority AS title FROM orders"
_BY = {"newest": "newest DESC", "deadline": "due", "amount_desc": "amount <= 0, amount DESC", "amount_asc": "amount <= 0, amount", "title": "title"}


def _list_sql(mode: str, sort: str) -> str:
    where = {"all": "", "open": " WHERE NOT closed", "closed": " WHERE closed"}[mode]
    by = ("closed, " if mode == "all" else "") + (_BY[sort] + (" DESC" if sort == "deadline" and mode == "closed" else "")) + ", n"
    return f"SELECT '{mode}' AS mode, '{sort}' AS sort, n, row_number() OVER (ORDER BY {by}) AS place FROM i{where} QUALIFY place BETWEEN 9 AND 16"


@register("list_pages", f"WITH i AS ({_ITEMS}) " + " UNION ALL ".join(_list_sql(m, s) for m, s in _LISTS))
def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the list in every mode and order."""
    time = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("n"), (F.col("o_orderstatus") == "F").alias("closed"), time.alias("newest"), (time % 7777777).alias("due"), F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("amount"), F.col("o_orderpriority").alias("title")
    )
    out = None
    for mode, sort in _LISTS:
        order = search.list_order(mode, sort, *map(F.col, ("closed", "newest", "due", "amount", "title", "n")))
        page = search.page_of(search.of_mode(rows, mode, F.col("closed")), 2, 8, *order)
        at = F.row_number().over(Window.orderBy(*order))  # of eight rows
        page = page.select(F.lit(mode).alias("mode"), F.lit(sort).alias("sort"), "n", (at + 8).cast("bigint").alias("place"))
        out = page if out is None else out.unionByName(page)
    return out


_PLACES, _NAMES = ("松山市", "今治市", "", "伊予市", "ア地区", "い地区"), ("サクラ補助金", "さる対策", "愛媛の助成", "apple", "Banana", "いぬ", "アイス", "10番", "補助金の一覧", "ガラス")
_ADMIN = {
    "published_at_desc": "coalesce(published, 0) DESC", "amount_desc": "coalesce(amount, 0) DESC", "deadline_asc": "deadline ASC NULLS LAST", "region_title_asc": "CASE WHEN region = '' THEN '不明' ELSE region END COLLATE ja, title COLLATE ja", "fetched_at_desc": "fetched DESC",
}
_ADMIN_SQL = f"""SELECT o_orderkey AS n, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS published, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 97 END AS deadline, o_custkey AS fetched,
  list_extract([{", ".join(map(quoted, _PLACES))}], CAST(o_orderkey % {len(_PLACES)} AS INTEGER) + 1) AS region, list_extract([{", ".join(map(quoted, _NAMES))}], CAST(o_custkey % {len(_NAMES)} AS INTEGER) + 1) AS title FROM orders"""


@register("admin_lists", f"WITH i AS ({_ADMIN_SQL}) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{sort}' AS sort, n, row_number() OVER (ORDER BY {keys}, n) AS place FROM i) WHERE place <= 40" for sort, keys in _ADMIN.items()))
def admin_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty of the editors' list in each of its orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("n"), F.when(k % 4 > 0, c).alias("published"), F.when(k % 3 > 0, F.col("o_totalprice")).alias("amount"), F.when(k % 5 > 0, c % 97).alias("deadline"), c.alias("fetched"), pick(_PLACES, k).alias("region"), pick(_NAMES, c).alias("title")
    )
    out = None
    for sort in search.ADMIN_SORTS:
        order = search.admin_order(sort, *map(F.col, ("published", "amount", "deadline", "region", "title", "fetched", "n")))
        first = rows.orderBy(*order).limit(40)
        first = first.select(F.lit(sort).alias("sort"), "n", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))  # of forty rows
        out = first if out is None else out.unionByName(first)
    return out


@register("feed_imports", f"""WITH f AS (SELECT o_orderkey, o_orderkey % 4 AS r, CAST(floor(o_totalprice / 1000) AS BIGINT) AS n, o_orderdate AS d FROM orders WHERE o_orderkey IS NOT NULL),
x AS (SELECT *, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['令和7年度', '令和8年度'] ELSE [''] END) AS y, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [1, 2] ELSE [1] END) AS i FROM f)
SELECT 'G' || o_orderkey || ':' || CASE WHEN y = '' THEN 'workflow-1' ELSE y END AS source_external_id, '設備導入 補助金' || CASE WHEN y = '' THEN '' ELSE '（' || y || '）' END AS title,
  CASE r WHEN 0 THEN '愛媛県 / 松山市内' WHEN 1 THEN '全国' ELSE '愛媛県' END AS region_text, CASE r WHEN 1 THEN '全国' ELSE '愛媛県' END AS prefecture, CASE WHEN r = 0 THEN '松山市' ELSE '' END AS municipality,
  CASE WHEN i = 2 THEN 1500000 ELSE n * 10000 END AS amount_max_yen, CASE WHEN r = 3 THEN '2分の1以内' ELSE '2/3' END AS subsidy_rate_text, strftime(d, '%Y-%m-%d') AS application_start_date,
  CASE WHEN d > TIMESTAMP '1998-01-15' THEN '{lexicon.ANNOUNCED}' WHEN d + INTERVAL 30 DAY < TIMESTAMP '1998-01-15' THEN '{lexicon.CLOSED_STATUS}' ELSE '{lexicon.OPEN}' END AS application_status FROM x""")
def feed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a feed's records: every second one has two rounds, the later with its own limit."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey is not null")
    r, n = F.col("o_orderkey") % 4, F.floor(F.col("o_totalprice") / 1000).cast("string")
    none = F.lit(None).cast("string")
    round_ = lambda year, limit: F.struct(none.alias("id"), F.lit(year).alias("fiscal_year_round"), *[(F.lit(limit) if c == "subsidy_max_limit" and limit else none).alias(c) for c in imports.OVERRIDDEN], none.alias("detail"))
    feed = orders.select(
        F.concat(F.lit("G"), F.col("o_orderkey")).alias("id"), F.lit("<b>設備導入</b>補助金").alias("title"), F.lit("産業振興課").alias("institution_name"),
        F.when(r == 0, "愛媛県").when(r == 1, "全国").otherwise(none).alias("target_area_search"), F.when(r == 0, "松山市内").otherwise(none).alias("target_area_detail"), F.lit("設備投資/DX").alias("use_purpose"), none.alias("industry"),
        F.lit("機械装置費、工事費").alias("target_expense"), F.when(r == 3, none).otherwise("2/3").alias("subsidy_rate"), F.concat(n, F.lit("万円")).alias("subsidy_max_limit"), F.lit("補助率：2分の1以内").alias("detail"),
        none.alias("subsidy_catch_phrase"), none.alias("target_number_of_employees"), none.alias("front_subsidy_detail_page_url"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("acceptance_start_datetime"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd HH:mm:ss").alias("acceptance_end_datetime"), none.alias("project_end_deadline"), none.alias("fiscal_year"), none.alias("search_area"),
        F.when(r >= 2, "愛媛県 補助金").otherwise("").alias("search_keyword"), F.when(F.col("o_orderkey") % 2 == 0, F.array(round_("令和7年度", None), round_("令和8年度", "150万円"))).alias("workflow"),
    )
    rows = imports.normalised(feed, F.to_timestamp(F.lit("1998-01-15 00:00:00")))
    return rows.select("source_external_id", "title", "region_text", "prefecture", "municipality", "amount_max_yen", "subsidy_rate_text", "application_start_date", "application_status")


_CRAWLED = PERIODS + EXPENSES
_TITLE = "設備・機器"


@register("crawl_periods", f"""WITH g(k, t) AS (VALUES {_values(_CRAWLED)}), x AS (SELECT k, trim(t) AS t FROM g),
j AS (SELECT k, t, t <> '' AND ((contains(t, '{_TITLE}') AND length(t) <= {len(_TITLE) + 20}) OR regexp_full_match(t, '申請期間|受付期間|募集期間|対象者|対象経費|補助率|上限金額') OR (length(t) <= 8 AND regexp_matches(t, '期間|対象|概要|詳細'))
  OR regexp_matches(t, {quoted(lexicon.CRAWL_NOT_PERIOD)}) OR regexp_full_match(t, '[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日(?:現在)?(?:更新|掲載)?|受付終了|募集終了|終了しました') OR regexp_matches(t, '(?:更新|掲載)$')
  OR (regexp_matches(t, '補助金|助成金|支援事業') AND NOT regexp_matches(t, '[0-9]{{4}}|令和|平成|月|日|随時|終了')) OR t = '不明' OR NOT regexp_matches(t, {quoted(lexicon.CRAWL_PERIOD)})) AS bad FROM x)
SELECT p_partkey, bad, CASE WHEN bad THEN '{lexicon.SEE_OFFICIAL}' ELSE t END AS shown FROM part JOIN j ON k = p_partkey % {len(_CRAWLED)}""")
def crawl_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, _CRAWLED)
    return rows.select("p_partkey", gates.is_bad_period(F.col("t"), F.lit(_TITLE)).alias("bad"), gates.safe_period(F.col("t"), F.lit(_TITLE))["after"].alias("shown"))


_HOSTS = tuple(h for h, _ in lexicon.MUNICIPALITY_HOSTS) + (lexicon.PREFECTURE_HOST, "note.com", "hojokin.example.com", "hojokin.example.go.jp", "example.com")


@register("source_gates", f"""WITH h(k, h) AS (VALUES {_values(_HOSTS)}), m(h, place) AS (VALUES {", ".join(f"('{h}', '{n}')" for h, n in lexicon.MUNICIPALITY_HOSTS)}, ('{lexicon.PREFECTURE_HOST}', '')),
u AS (SELECT p_partkey, 'https://www.' || h || '/p/' || p_partkey AS url FROM part JOIN h ON k = p_partkey % {len(_HOSTS)}),
f AS (SELECT *, len(list_filter({_words(lexicon.OFFICIAL_PARTS)}, lambda x: contains(url, x))) > 0 AS official, len(list_filter({_words(lexicon.PORTALS)}, lambda x: contains(url, x))) > 0 AS listed FROM u)
SELECT p_partkey, official, listed OR (contains(url, 'hojokin') AND NOT official) AS portal, place AS municipality, url || '/' AS slashed FROM f LEFT JOIN m ON m.h = regexp_extract(url, '^https://www\\.([^/]*)', 1)""")
def source_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://www."), F.col("t"), F.lit("/p/"), F.col("p_partkey").cast("string"))
    rows = _dealt(spark, sf_dir, _HOSTS).withColumn("url", url)
    u = F.col("url")
    return rows.select("p_partkey", gates.is_official(u).alias("official"), gates.is_portal(u).alias("portal"), gates.area_of(u)["municipality"].alias("municipality"), gates.with_slash(u).alias("slashed"))
