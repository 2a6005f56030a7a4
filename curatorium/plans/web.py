"""Queries over web pages: the URL report, normal forms, text and links, scores and classes, the crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text, urls
from curatorium.operators import pages, quality, rules, search, stages
from curatorium.plans.shared import count_sql, labels_sql, quoted, registry, rules_sql, table
from curatorium.sources import tables

QUERIES, ORACLES, register = registry()

_FLAGS = ("has_trailing_slash", "is_http", "is_www", "is_index_html", "has_double_slash", "has_query", "is_likely_missing", "is_static_asset")
_PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_ROUTES = " ".join(f"WHEN starts_with(low, '{prefix}') THEN '{name}'" for name, prefix in lexicon.ROUTES)
#: The pages' addresses and, since these follow none of the portal's routes, as many again of its forms as there are parts.
_FORMS = (
    ("https://www.portal.example.jp/subsidy/", ""), ("http://portal.example.jp/column/", "/"), ("https://portal.example.jp/area/", "/index.html"), ("https://portal.example.jp/assets/", ".js"), ("https://portal.example.jp/", ".PNG"),
    ("https://portal.example.jp/search?q=", ""), ("https://portal.example.jp//purpose/", "?a=1"), ("https://portal.example.jp/feature/does-not-exist-", ""), ("portal.example.jp/", ""), ("https://portal.example.jp/other", "/x"), ("https://portal.example.jp/#", ""),
)
_CASES = " ".join(f"WHEN {k} THEN {quoted(a)} || p_partkey || {quoted(b)}" for k, (a, b) in enumerate(_FORMS))
ADDRESSES_SQL = f"SELECT page_id, url FROM pages UNION ALL SELECT 1000000000 + p_partkey, CASE p_partkey % {len(_FORMS)} {_CASES} END FROM part"


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    made = F.element_at(F.array(*[F.concat(F.lit(a), key.cast("string"), F.lit(b)) for a, b in _FORMS]), (key % len(_FORMS) + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select((key + 1000000000).alias("page_id"), made.alias("url"))
    return table(spark, sf_dir, "pages").select("page_id", "url").unionByName(parts)


REPORT_SQL = f"""
WITH a AS (SELECT page_id, url, regexp_matches(url, {quoted(urls.VALID)}) AS ok, {_PATH} AS path, lower({_PATH}) AS low, {_HOST} AS host FROM ({ADDRESSES_SQL})),
b AS (SELECT *, starts_with(low, '/assets/') OR starts_with(low, '/static/') OR regexp_matches(low, '[^/]\\.(?:{"|".join(lexicon.ASSET_EXTENSIONS)})$') AS asset FROM a),
c AS (SELECT *, CASE WHEN NOT ok THEN 'invalid-url' WHEN asset THEN 'static-asset' WHEN low = '/' THEN 'top' {_ROUTES} ELSE 'unknown' END AS category, regexp_extract(low, '^/*([^/]+)', 1) AS segment FROM b)
SELECT page_id, url, category,
  CASE WHEN category IN ('invalid-url', 'static-asset') THEN category WHEN category = 'top' THEN '/'
       WHEN category IN ('subsidy', 'column', 'expert-articles', 'area', 'purpose', 'feature') THEN '/' || category || '/:slug'
       WHEN category <> 'unknown' THEN '/' || category WHEN segment = '' THEN '/' ELSE '/' || segment || '/...' END AS pattern,
  ok AND path <> '/' AND ends_with(path, '/') AS has_trailing_slash, ok AND starts_with(lower(url), 'http:') AS is_http, ok AND starts_with(host, 'www.') AS is_www,
  ok AND ends_with(low, '/index.html') AS is_index_html, ok AND contains(path, '//') AS has_double_slash, ok AND length(regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)) > 1 AS has_query,
  ok AND regexp_matches(lower(url), '{"|".join(lexicon.LIKELY_MISSING)}') AS is_likely_missing, ok AND asset AS is_static_asset
FROM c"""


def report(rows: DataFrame) -> DataFrame:
    return rows.withColumns(urls.report(F.col("url")))


@register("url_report", REPORT_SQL)
def url_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_addresses(spark, sf_dir))


@register("url_top_patterns", f"SELECT pattern, count(*) AS n FROM ({REPORT_SQL}) GROUP BY pattern ORDER BY n DESC, pattern LIMIT 10")
def url_top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_report(spark, sf_dir).groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "pattern").limit(10)


@register("url_summary", f"SELECT category, count(*) AS n, {', '.join(f'count(*) FILTER ({f}) AS {f}' for f in _FLAGS)} FROM ({REPORT_SQL}) GROUP BY category")
def url_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_report(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in _FLAGS])


def _normal_sql(column: str, profile: str) -> str:
    if profile == "dup":
        bare = f"regexp_replace(trim({column}), '(?i)^https?://|[?#].*$', '', 'g')"
        return f"regexp_replace(regexp_replace({bare}, '(?i)/(?:index|default)\\.(?:html|php|aspx|jsp)$', ''), '/$', '')"
    names = "|".join(lexicon.TRACKING[profile])
    out = f"regexp_replace(trim({column}), '#.*$', '')"
    out = f"regexp_replace({out}, '(?i)([?&])(?:{names})=[^&]*', '\\1', 'g')"
    out = f"regexp_replace(regexp_replace(regexp_replace({out}, '&{{2,}}', '&', 'g'), '\\?&', '?', 'g'), '[?&]+$', '')"
    return out if profile == "fetch" else f"regexp_replace({out}, '/$', '')"


@register("url_normalised", f"SELECT page_id, {', '.join(f'{_normal_sql("url", p)} AS {p}_form' for p in ('crawl', 'index', 'fetch', 'dup'))}, {_HOST} AS host FROM pages")
def url_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", *[urls.normalised(u, p).alias(f"{p}_form") for p in ("crawl", "index", "fetch", "dup")], urls.host(u).alias("host"))


@register("source_ids", f"SELECT page_id, 'official_site:' || substr(sha256({_normal_sql('url', 'crawl')}), 1, 32) AS source_id FROM pages")
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.source_id(F.col("url")).alias("source_id"))


_WHITE = "[\\s\u000b 　]"
_TEXT_SQL = "html"
for _p, _r in ((r"(?is)<(script|style)\b.*?</(?:script|style)>", " "), (r"(?i)<br\s*/?>|</(?:p|li|div|tr)>", "\n"), ("<[^>]*>", " ")):
    _TEXT_SQL = f"regexp_replace({_TEXT_SQL}, {quoted(_p)}, {quoted(_r)}, 'g')"
for _n, _s in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
    _TEXT_SQL = f"replace({_TEXT_SQL}, {quoted(_n)}, {quoted(_s)})"
_TEXT_SQL = f"trim(regexp_replace({_TEXT_SQL}, '{_WHITE}+', ' ', 'g'))"


@register("html_text", f"SELECT page_id, md5({_TEXT_SQL}) AS digest, length({_TEXT_SQL}) AS n_chars, length(regexp_replace({_TEXT_SQL}, '{_WHITE}', '', 'g')) AS n_dense FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", text.without_html(F.col("html")).alias("t"))
    return rows.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"), F.length(text.tight(F.col("t"))).cast("bigint").alias("n_dense"))


@register("page_anchors", """SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref="[^"]*"[^>]*>.*?</a>')) AS n_links,
  len(list_filter(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>.*?</a>', 1), lambda u: starts_with(u, '/'))) AS n_internal FROM pages""")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_pages = table(spark, sf_dir, "pages")
    links = pages.anchors(all_pages.select("page_id", "html")).groupBy(F.col("page").alias("page_id")).agg(F.count("*").alias("n_links"), F.count_if(F.col("url").startswith("/")).alias("n_internal"))
    return all_pages.select("page_id").join(links, "page_id", "left").fillna(0)


@register("internal_paths", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s+[^>]*href=["'']([^"'']+)["''][^>]*>', 1)) AS href FROM pages)
SELECT href AS path, count(*) AS n FROM a WHERE starts_with(href, '/') GROUP BY href""")
def internal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.explode(quality.internal_links(F.col("html"), "portal.example.jp")).alias("path"))
    return rows.groupBy("path").agg(F.count("*").alias("n"))


#: Japanese titles and link texts made from parts, for rules whose words the driver's texts never hold.
_WORDS = ("創業補助金", "助成金一覧", "医療費助成", "空き家改修支援事業", "入札情報", "認定申請の手引き", "児童手当", "商品券キャンペーン", "公募のご案内", "受付終了のお知らせ", "統計資料", "交付金の様式")
_PATHS = ("/hojokin/2026.html", "/josei/", "/shien/index.html", "/gikai/a.html", "/form/x.pdf", "/sangyou/youkou.pdf", "/kosodate/b.html", "/life/12/")
_HEADINGS = ("中小企業", "税", "観光", "子育て", "支援制度", "")


def _nth(words, column: str) -> str:
    return f"list_extract([{', '.join(map(quoted, words))}], CAST({column} AS INTEGER))"


def _made_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), i)
    p = stages.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    key = F.col("p_partkey")
    return p.select(
        (key % 50).alias("page"), key.alias("pos"), F.concat(F.lit("https://www.city.example.jp"), pick(_PATHS, (key % len(_PATHS) + 1).cast("int")), F.lit("?p="), key.cast("string")).alias("url"),
        pick(_WORDS, (key % len(_WORDS) + 1).cast("int")).alias("text"), pick(_HEADINGS, (key % len(_HEADINGS) + 1).cast("int")).alias("heading"), F.col("p_name").alias("context"), (key % 7 == 0).alias("nav"),
    )


_LINK_SQL = f"""
WITH a AS (SELECT p_partkey % 50 AS page, p_partkey AS pos, 'https://www.city.example.jp' || {_nth(_PATHS, f'p_partkey % {len(_PATHS)} + 1')} || '?p=' || p_partkey AS link,
  {_nth(_WORDS, f'p_partkey % {len(_WORDS)} + 1')} AS text, {_nth(_HEADINGS, f'p_partkey % {len(_HEADINGS)} + 1')} AS heading, p_name AS context, p_partkey % 7 = 0 AS nav FROM part),
b AS (SELECT *, {rules_sql(lexicon.LINK_RULES, {'text': 'text', 'heading': 'heading', 'url': 'link'}, {'weak': f"NOT regexp_matches(text, '{lexicon.ASSISTANCE}') OR regexp_matches(text, '事務補助|業務補助|作業補助')", 'no_interest': "NOT regexp_matches(text, '利子補給|補助')", 'pdf': "regexp_matches(link, '(?i)\\.pdf(?:\\z|\\?)')"})}
  + CASE WHEN nav THEN -5 ELSE 0 END AS raw, text || ' ' || heading || ' ' || link AS here FROM a),
c AS (SELECT *, regexp_matches(here, '{"|".join(lexicon.EXCLUDED_LINKS)}') AND NOT regexp_matches(here, '{lexicon.ASSISTANCE}') AS excluded,
  regexp_matches(concat_ws(chr(10), text, heading, context, link), '{lexicon.ASSISTANCE}|支援|公募|募集|交付') OR regexp_matches(link, '(?i)hojo|josei|shien') AS signal, regexp_matches(here, '{"|".join(lexicon.INCLUDED_LINKS)}') AS keyword FROM b)
SELECT page, pos, CASE WHEN excluded THEN least(raw, 0) ELSE raw END AS score, excluded FROM c WHERE keyword OR signal OR raw >= 5"""


@register("link_scores", _LINK_SQL)
def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.scored_links(_made_links(spark, sf_dir)).select("page", "pos", "score", "excluded")


_LINK_FIELDS = {"text": "text", "heading": "heading", "url": "link"}
_LINK_GUARDS = {
    "weak": f"NOT regexp_matches(text, '{lexicon.ASSISTANCE}') OR regexp_matches(text, '事務補助|業務補助|作業補助')", "no_interest": "NOT regexp_matches(text, '利子補給|補助')", "pdf": "regexp_matches(link, '(?i)\\.pdf(?:\\z|\\?)')",
}
_PORTAL = r"regexp_matches(link, '(?i)^https?://([^/?#]*\.)?jgrants-portal\.go\.jp(?:[:/?#]|$)')"


def _form_sql(url: str, title: str, body: str) -> str:
    name, head = f"({title} || chr(10) || {url})", f"left({body}, 1200)"
    guided = f"{count_sql(f'({name} || chr(10) || {head})', lexicon.GUIDELINES)} > 0"
    named, worded = f"{count_sql(name, lexicon.FORMS)} > 0", f"{count_sql(head, lexicon.FORMS)} > 0"
    return f"(({named} AND NOT {guided}) OR (({named} OR {worded}) AND NOT regexp_matches({title}, '{lexicon.ASSISTANCE}') AND NOT {guided} AND {count_sql(body, lexicon.DETAIL_SIGNALS)} = 0))"


_REASONS_SQL = _LINK_SQL.replace("SELECT page, pos, CASE", f"""SELECT page, pos, link, text, heading, context, nav, excluded,
  {labels_sql(lexicon.LINK_RULES, _LINK_FIELDS, _LINK_GUARDS, lambda r: rules.named(r, lexicon.LINK_FIELDS, lexicon.LINK_LABELS), True)} AS reasons,
  {labels_sql(lexicon.LINK_RULES, _LINK_FIELDS, _LINK_GUARDS, lambda r: rules.named(r, lexicon.LINK_FIELDS, lexicon.LINK_LABELS), False, ("CASE WHEN nav THEN 'common_navigation_area -5' END",))} AS penalties, CASE""")
_REASONS_SQL = f"""SELECT page, CAST(rank AS INTEGER) AS rank, link, score, reasons, penalties, score >= 8 AND NOT excluded AND NOT {_PORTAL} AND NOT {_form_sql("link", "text", "''")} AS should_crawl
FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, pos) AS rank FROM ({_REASONS_SQL})) WHERE rank <= 3"""


@register("link_reasons", _REASONS_SQL)
def link_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.scored_links(_made_links(spark, sf_dir))
    return search.top_per(rows, ["page"], 3, F.col("score").desc(), F.col("pos")).select("page", "rank", "link", "score", "reasons", "penalties", "should_crawl")


_EVERYTHING = "(title || chr(10) || url || chr(10) || left(body, {n}))"
_PAGE_FIELDS = {"title": "title", "url": "url", "all": _EVERYTHING.format(n=5000)}
_NOISE_CASES = (
    ("regexp_matches(title, 'モニター')", "モニター募集の可能性が高い"), ("regexp_matches(title, '名簿|登録を募集|利用者の募集|募集について') AND NOT worded", "募集案内で補助制度ではない可能性が高い"), ("regexp_matches(title, '認定申請|保証[45]号|セーフティネット保証|危機関連保証')", "認定・保証申請ページの可能性が高い"),
    ("regexp_matches(title, '商品券|キャンペーン') AND NOT worded", "商品券・キャンペーン案内の可能性が高い"), ("regexp_matches(title, '融資制度') AND NOT regexp_matches(title, '利子補給|補助金|助成金|支援金')", "融資制度のみの案内の可能性が高い"), ("regexp_matches(title, '導入計画') AND NOT worded", "導入計画のみの案内の可能性が高い"),
    ("regexp_matches(title, 'ビジョン|計画策定|策定しました|報告書') AND NOT worded", "計画・報告ページの可能性が高い"), ("regexp_matches(title, '手当') AND NOT regexp_matches(title, '補助金|助成金|支援金|給付金')", "手当制度の案内の可能性が高い"), ("regexp_matches(title, '(?:制度について|支援について|のご案内)$') AND NOT worded", "制度案内ページの可能性が高い"),
)
#: Ten links, one of them of a subsidy: neither the many-links rules nor the one for titles of lists can hold.
_TYPES_SQL = rf"""
WITH a AS (SELECT p_partkey AS pos, 'https://www.city.example.jp' || {_nth(_PATHS, f'p_partkey % {len(_PATHS)} + 1')} AS url, {_nth(_WORDS, f'p_partkey % {len(_WORDS)} + 1')} AS title, CASE WHEN p_partkey % 3 = 0 THEN '補助対象: ' || p_name || ' 申請期間と補助率' ELSE p_name END AS body FROM part),
b AS (SELECT *, {_EVERYTHING.format(n=2500)} AS everything, {_form_sql('url', 'title', 'body')} AS form, regexp_matches(url, '(?i)\.pdf(?:\?|$)') AS pdf, {count_sql('body', lexicon.DETAIL_SIGNALS)} AS signals, regexp_matches(title, '{lexicon.ASSISTANCE}') AS assists,
  regexp_matches(title || chr(10) || url, '{lexicon.SUBSIDY_WORDS}') AS worded, title <> '' AND regexp_matches(title, '{"|".join(lexicon.INDEX_TITLES)}') AS generic, lower(regexp_replace(url, '/$', '')) AS u FROM a),
c AS (SELECT *, regexp_matches(everything, '{lexicon.ASSISTANCE}') AS assisted, NOT (regexp_matches(u, '\.html?$') AND NOT regexp_matches(u, '/index\.html?$') AND NOT generic AND (assists OR signals >= 1))
  AND (generic OR regexp_matches(u, '/(?:index\.html?|hojokin|josei|sangyou|sangyo|shien|life/[0-9]+|theme[0-9]+)/?$|/page/theme[0-9]+\.html$')) AND signals < 4 AS listed FROM b),
d AS (SELECT *, CASE WHEN pdf AND NOT form AND {count_sql('everything', lexicon.GUIDELINES)} > 0 THEN 'pdf_guideline' WHEN pdf THEN 'application_form'
  WHEN listed THEN CASE WHEN regexp_matches(title || ' ' || url, '(?i)産業|商工|農業|観光|住宅|環境|kurashi|sangyo|life') THEN 'category_index' ELSE 'municipal_index' END
  WHEN form THEN 'application_form' WHEN regexp_matches(title || chr(10) || url, '{"|".join(lexicon.NOISE)}') AND NOT assisted THEN 'noise_page' WHEN regexp_matches(everything, '{lexicon.PERSONAL_ASSISTANCE}') AND assisted THEN 'personal_assistance'
  WHEN regexp_matches(url, '(?i)\.html?$') AND regexp_matches(url, '(?i)hojo|hojokin|josei|shien') AND (signals >= 1 OR assisted OR contains(everything, '支援')) THEN 'subsidy_detail' WHEN signals >= 2 AND assisted THEN 'subsidy_detail' ELSE 'unknown' END AS page_type FROM c)
SELECT pos, url, title, body, page_type, {rules_sql(lexicon.PAGE_RULES, _PAGE_FIELDS, {'weak': f"NOT regexp_matches({_EVERYTHING.format(n=5000)}, '{lexicon.ASSISTANCE}')", 'pdf': 'pdf'})}
  + CASE WHEN length(trim(body)) BETWEEN 1 AND 299 THEN -5 ELSE 0 END + CASE WHEN form THEN -5 ELSE 0 END + CASE WHEN page_type IN ('subsidy_detail', 'pdf_guideline') THEN 2 ELSE 0 END AS score,
  CASE {" ".join(f"WHEN {test} THEN {quoted(word)}" for test, word in _NOISE_CASES)} ELSE '' END AS noise FROM d"""


@register("page_types", _TYPES_SQL)
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and score of made pages: titles and addresses as in link_scores, a detail word in every third body."""
    rows = _made_links(spark, sf_dir)
    body = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("補助対象: "), F.col("context"), F.lit(" 申請期間と補助率"))).otherwise(F.col("context"))
    rows = stages.once(rows.select("pos", "url", F.col("text").alias("title"), "context"), {"url": F.regexp_replace("url", r"\?.*$", ""), "body": body}).drop("context")
    url, title, body = F.col("url"), F.col("title"), F.col("body")
    rows = stages.once(rows, {"page_type": pages.page_type(url, title, body, F.lit(10), F.lit(1), F.lit(False))})
    return stages.once(rows, {"score": pages.page_score(url, title, body, F.lit(10), F.col("page_type")), "noise": pages.noise_reason(title, F.lit(""), url)})


@register("crawl_frontier", """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS t FROM lineitem), a AS (SELECT 's1' AS url, 0 AS depth),
b AS (SELECT DISTINCT t AS url, 1 AS depth FROM e WHERE s = 's1'), c AS (SELECT DISTINCT s AS url, 2 AS depth FROM e WHERE t IN (SELECT url FROM b) AND s <> 's1')
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    links = rows.unionByName(rows.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return pages.frontier(links, spark.createDataFrame([("s1",)], "url string"), 2)


@register("sitemap_entries", """SELECT '<url><loc>' || replace(replace(url, '&', '&amp;'), '''', '&apos;') || '</loc><lastmod>2026-05-26</lastmod></url>' AS entry FROM pages WHERE NOT regexp_matches(url, '(?i)テスト|練習|サンプル|test')""")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.indexable(table(spark, sf_dir, "pages").select("url"), "url")
    return rows.select(tables.sitemap_entry(F.col("url"), F.lit("2026-05-26").cast("date")).alias("entry"))
