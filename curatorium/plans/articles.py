"""Queries over articles made from documents: their claims beside facts, and their reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.functions import lexicon
from curatorium.operators import claims, review, stages
from curatorium.plans import web
from curatorium.plans.shared import quoted, registry, table

QUERIES, ORACLES, register = registry()

_A = lexicon.ARTICLE
_TITLES = (
    "松山市店舗改装費補助金の確認", "愛媛県の廃棄物処理業者向け補助金｜令和8年度の補助率・上限額", "西条市工場立地奨励金の金額と締切", "FS調査の進め方", "県内の支援制度まとめ",
)
#: (block, official name, body, applicants, expenses, rate, cap, deadline, address); a null block gives none.
_BLOCKS = (
    (None, "", "", (), (), "", "", "", ""),
    ("ID:1 | タイトル:松山市店舗改装費補助金 | 機関:松山市産業課 | 対象:小規模事業者、個人事業主 | 経費:内装工事費・看板製作費 | 補助率:3分の1以内 | 上限:50万円 | 締切:2026年9月30日 | 公式URL:https://www.city.matsuyama.example/reno",
     "松山市店舗改装費補助金", "松山市産業課", ("小規模事業者", "個人事業主"), ("内装工事費", "看板製作費"), "3分の1以内", "50万円", "2026年9月30日", "https://www.city.matsuyama.example/reno"),
    ("ID:2 | タイトル:西条市工場立地奨励金 | 機関:西条市 | 対象:市内に工場を新設する法人 | 上限:投資額に応じて交付 | 締切:令和9年3月31日 | 公式URL:https://www.city.saijo.example/a | 概要:立地要件と算定方法を定める",
     "西条市工場立地奨励金", "西条市", ("市内に工場を新設する法人",), (), "", "投資額に応じて交付", "令和9年3月31日", "https://www.city.saijo.example/a"),
    ("ID:3 | タイトル:名前だけの制度 | 機関:愛媛県", "名前だけの制度", "愛媛県", (), (), "", "", "", ""),
)
_SENTENCES = (
    "補助率は3分の1以内です。", "補助上限は50万円です。", "補助上限は500,000円です。", "上限額は80万円です。", "申請締切は2026年9月30日です。", "受付期間は2027年1月からです。", "設備投資と研修費が対象です。", "中古品は対象外です。", "株式会社Cの例です。", "この補助金は必ずもらえます。",
)
_SAID = "愛媛県内の小規模事業者が対象者です。対象事業と対象経費、対象外経費、交付要件は公募要領で確認し、契約の前に実施機関の窓口へ相談してください。確認日は公式ページにあります。"
_LINKS = ('<a href="https://www.city.example.jp/x">公式</a><a href="/ehime-subsidy/">一覧</a>', '<a href="/subsidy-list">一覧</a><a href="https://www.city.example.jp/x">公式</a>', '<a href="https://ehime-hojokin.jp/search?keyword=a">検索</a>', "")
_TABLE = "<table><tr><th>項目</th><td>値</td></tr></table>"


def _nth(words, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("string") for w in words]), (place + 1).cast("int"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article around each document: its text between sentences that claim something, with tables, links, headings and lists that vary with doc_id."""
    k = F.col("doc_id")
    part = lambda by, n: F.floor(k / by) % n
    content = F.concat(
        F.lit("<p>"), F.coalesce("text", F.lit("")), F.lit("</p><p>"), _nth(_SENTENCES, part(1, 10)), _nth(_SENTENCES, part(10, 10)), _nth(_SENTENCES, part(100, 10)), F.lit("</p>"), F.repeat(F.lit(_TABLE), part(2, 3).cast("int")),
        _nth(_LINKS, part(3, 4)), F.repeat(F.lit("<h2>見出し</h2>"), part(1, 15).cast("int")), F.when(part(5, 3) > 0, _SAID).otherwise(""), F.when(part(7, 2) == 0, "<ul><li>項目</li></ul>").otherwise(""), F.when(part(1, 17) == 0, "qualityScore").otherwise(""),
    )
    kind = F.when(part(1, 3) == 0, "single_program").otherwise("column")
    return stages.dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", _nth(_TITLES, part(1, 5)).alias("title"), content.alias("content"), kind.alias("article_type"), _nth([b[0] for b in _BLOCKS], part(1, 4)).alias("subsidies_text"), (part(1, 2) == 0).alias("human_reviewed")
    )


def _pick(values, place: str) -> str:
    return f"list_extract([{', '.join('NULL' if v is None else quoted(v) for v in values)}], CAST({place} AS INTEGER) + 1)"


def _is(name: str, c: str) -> str:
    return f"regexp_matches({c}, {quoted(_A[name])})"


def _flat(c: str) -> str:
    return f"regexp_replace({c}, '{web._WHITE}', '', 'g')"


def _yen(c: str) -> str:
    factor = "CASE WHEN contains(y, '億円') THEN 100000000 WHEN contains(y, '万円') THEN 10000 WHEN contains(y, '千円') THEN 1000 ELSE 1 END"
    return rf"list_transform(regexp_extract_all(replace({c}, ',', ''), '[0-9]+(?:\.[0-9]+)?\s*(?:億円|万円|千円|円)'), lambda y: CAST(regexp_extract(y, '^([0-9.]+)', 1) AS DOUBLE) * {factor})"


_FIELDS = {"name": 1, "body_name": 2, "rate": 5, "cap": 6, "deadline": 7, "address": 8}
_READ_SQL = f"""
m AS (SELECT doc_id, {_pick(_TITLES, "doc_id % 5")} AS title, CASE WHEN doc_id % 3 = 0 THEN 'single_program' ELSE 'feature' END AS kind, {_pick([b[0] for b in _BLOCKS], "doc_id % 4")} AS block, doc_id % 2 = 0 AS human,
  {", ".join(f'{_pick([b[i] for b in _BLOCKS], "doc_id % 4")} AS {n}' for n, i in _FIELDS.items())}, {_pick([" ".join((*b[3], *b[4])) for b in _BLOCKS], "doc_id % 4")} AS listed, doc_id % 4 IN (1, 2) AS applicants, doc_id % 4 = 1 AS expenses,
  '<p>' || coalesce(text, '') || '</p><p>' || {_pick(_SENTENCES, "doc_id % 10")} || {_pick(_SENTENCES, "doc_id // 10 % 10")} || {_pick(_SENTENCES, "doc_id // 100 % 10")} || '</p>' || repeat({quoted(_TABLE)}, doc_id // 2 % 3) || {_pick(_LINKS, "doc_id // 3 % 4")}
  || repeat('<h2>見出し</h2>', doc_id % 15) || CASE WHEN doc_id // 5 % 3 > 0 THEN {quoted(_SAID)} ELSE '' END || CASE WHEN doc_id // 7 % 2 = 0 THEN '<ul><li>項目</li></ul>' ELSE '' END || CASE WHEN doc_id % 17 = 0 THEN 'qualityScore' ELSE '' END AS html FROM documents),
b AS (SELECT *, {web._TEXT_SQL} AS body, address <> '' AS official, coalesce(trim(replace(block, address, '')), '') AS said FROM m),
f AS (SELECT *, {_flat("body")} AS dense, concat_ws(' ', title, body, coalesce(block, '')) AS everything, concat_ws(' ', name, body_name, deadline, rate, cap, listed, CASE WHEN official THEN name || ' ' || address || '  ' || said ELSE '' END,
  CASE WHEN {_is("start", "coalesce(block, '')")} THEN '契約' ELSE '' END) AS evidence, CASE {" ".join(f"WHEN regexp_matches(concat_ws(' ', title, body, coalesce(block, '')), {quoted(p)}) THEN '{n}'" for n, p in lexicon.PROGRAM_KIND_WORDS)} ELSE 'other' END AS program FROM b),
n AS (SELECT *, list_distinct(list_transform(regexp_extract_all(body, {quoted(_A["number_claim"])}), lambda c: trim(c))) AS told FROM f),
c AS (SELECT *, list_filter(told, lambda c: NOT (contains({_flat("evidence")}, {_flat("c")}) OR (contains(c, '補助率') AND rate <> '' AND contains({_flat("c")}, rate))
  OR (regexp_matches(c, '上限') AND cap <> '' AND (contains({_flat("c")}, cap) OR list_has_any({_yen("c")}, {_yen("cap")})))
  OR (regexp_matches(c, '締切|公募期間|受付期間') AND deadline <> '' AND (contains({_flat("c")}, deadline) OR contains(deadline, regexp_replace({_flat("c")}, '.*?(20[0-9]{{2}}年[0-9]{{1,2}}月).*', '\\1'))))
  OR (deadline <> '' AND (contains({_flat("c")}, deadline) OR len(list_filter(regexp_extract_all({_flat("c")}, '20[0-9]{{2}}年[0-9]{{1,2}}月'), lambda x: contains(deadline, x))) > 0)) OR (rate <> '' AND cap <> '' AND contains({_flat("c")}, rate) AND contains({_flat("c")}, cap)))) AS unsupported,
  regexp_extract(body, {quoted(f"({_A['fiction']})")}, 1) AS fiction FROM n),
d AS (SELECT *, {_is("amount", "title")} AND (({_is("rate_title", "title")} AND rate = '') OR ({_is("cap_title", "title")} AND cap = '') OR ({_is("any_amount_title", "title")} AND cap = '')) AS unfunded,
  cap <> '' AND {_is("amount", "body")} AND {_is("money", "body")} AND NOT (contains(body, cap) OR list_has_any({_yen("body")}, {_yen("cap")})) AS contradicted, {_is("industry_claim", "body")} AND NOT {_is("industry_claim", "evidence")} AS no_industry,
  {_is("expense_claim", "body")} AND NOT {_is("expense_claim", "evidence")} AS no_expense, {_is("excluded_claim", "body")} AND NOT {_is("excluded_fact", "evidence")} AS no_excluded, fiction <> '' AND NOT contains(evidence, fiction) AS made_up FROM c),
e AS (SELECT *, len(unsupported) + unfunded::INTEGER + no_industry::INTEGER + no_expense::INTEGER + no_excluded::INTEGER + made_up::INTEGER AS n_unsupported, contradicted::INTEGER AS n_contradictory FROM d)"""


@register("article_claims", f"WITH {_READ_SQL} SELECT doc_id, len(told) - len(unsupported) AS n_supported, n_unsupported, n_contradictory, CAST(coalesce(list_sum(list_transform(told, lambda c: list_sum({_yen('c')}))), 0) AS DOUBLE) AS yen, list_sort(unsupported) AS unsupported FROM e")
def article_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of each article by status, the yen that they name, and the numbers that no fact bears out."""
    rows = review.claimed(_articles(spark, sf_dir)).select("doc_id", "_claims")
    each = claims.table(rows, "doc_id", claims="_claims")
    number = F.col("claim").rlike(_A["number_claim"])
    yen = F.aggregate("yen", F.lit(0.0), lambda a, x: a + x)
    return each.groupBy("doc_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("supported", "unsupported", "contradictory")], F.sum(F.when(number, yen).otherwise(0.0)).alias("yen"),
        F.sort_array(F.collect_list(F.when(number & (F.col("status") == "unsupported"), F.col("claim")))).alias("unsupported"),
    )


_PATH_OK = quoted(lexicon.PORTAL_PATHS)
#: (condition, cap or none) of every fault and warning; caps that go with neither.
_FAULTS = (
    ("long < 1500", 49), (f"{_is('amount', 'title')} AND NOT paid", 39), ("specific AND NOT (name <> '' AND body_name <> '' AND official)", 39), (f"{_is('single', 'body')} AND (name = '' OR NOT official)", 39), (f"{_is('year', 'title')} AND (NOT {_is('year', 'body')} OR NOT official)", 39),
    (f"{_is('deadline', 'title')} AND (NOT {_is('deadline_detail', 'body')} OR NOT official)", 39), (_is("risky", "body"), None), (_is("memo", "html"), 39), ("NOT route", 49), ("n_table = 0", 59), ("len(own) = 0", 59), ("astray", 59), ("NOT detailed", None),
    ("program = 'subsidy' AND NOT started", 69), (f"NOT {_is('local', 'body')}", None), ("specific AND NOT route", 39), ("specific AND NOT official", 39), ("offering AND wanting", 49), (f"{_is('study', 'title || chr(32) || body')} AND {_is('equipment', 'body')} AND NOT {_is('study_detail', 'body')}", 49),
    (f"({_is('definite', 'body')} OR ({_is('money', 'body')} AND {_is('year', 'body')})) AND NOT official", 39), ("n_unsupported > 0", 39), ("no_industry OR no_expense OR no_excluded OR len(list_filter(unsupported, lambda c: regexp_matches(c, '対象者|対象業種|対象経費|対象外経費'))) > 0 OR regexp_matches(fiction, '対象者|対象経費')", 39), ("n_contradictory > 0", 29),
)
_WARNINGS = (
    ("long BETWEEN 1500 AND 3999", 79), ("kind = 'feature' AND long < 6000", None), ("NOT official", 89), ("lacking > 0", None), ("route AND away = 0", None), ("n_table = 1", 79), ("n_h2 < 10", None), ("n_h2 > 12", 79), (f"NOT {_is('checklist', 'html')}", None), (f"NOT {_is('action', 'body')}", None),
)
_MORE_CAPS = (("NOT (excellent AND lacking = 0 AND grounded = 100)", 89), ("NOT human", 99))
_COUNT = lambda cases: " + ".join(f"({test})::INTEGER" for test, _ in cases)
_REVIEW_SQL = rf"""
WITH {_READ_SQL},
g AS (SELECT *, length(dense) AS long, regexp_extract_all(html, '(?i)<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>', 1) AS hrefs, len(regexp_extract_all(html, '<table>')) AS n_table, len(regexp_extract_all(html, '<h2>')) AS n_h2,
  {_is("amount", "title")} OR {_is("year", "title")} OR {_is("deadline", "title")} AS specific, {_is("contract", "body")} OR {_is("start", "body")} AS started,
  CASE WHEN program = 'subsidy' THEN {_is("target", "body")} AND {_is("expense", "body")} AND {_is("excluded", "body")} AND {_is("project", "body")} ELSE {_is("target", "body")} AND {_is("conditions", "body")} END AS detailed,
  rate <> '' OR cap <> '' AS funding FROM e),
h AS (SELECT *, list_filter(hrefs, lambda x: starts_with(x, '/') OR regexp_matches(x, '{lexicon.PORTAL_HOST}')) AS own, len(list_filter(hrefs, lambda x: regexp_matches(x, '(?i)^https?://') AND NOT regexp_matches(x, '{lexicon.PORTAL_HOST}'))) AS away,
  (NOT {_is("rate_title", "title")} OR rate <> '') AND (NOT {_is("cap_title", "title")} OR cap <> '') AND (NOT {_is("any_amount_title", "title")} OR cap <> '') AND {_is("amount", "body")} AND official
  AND ((({_is("rate_title", "title")} OR {_is("cap_title", "title")}) AND {_is("money", "body")}) OR ({_is("any_amount_title", "title")} AND ({_is("money", "body")} OR {_is("method", "body")}))) AS paid,
  list_distinct(list_filter([CASE WHEN NOT official THEN 'source' END, CASE WHEN kind = 'single_program' AND name = '' THEN 'name' END, CASE WHEN kind = 'single_program' AND body_name = '' THEN 'body' END, CASE WHEN kind = 'single_program' AND NOT applicants THEN 'applicants' END,
    CASE WHEN kind = 'single_program' AND program = 'subsidy' AND NOT expenses THEN 'expenses' END, CASE WHEN kind = 'single_program' AND program IN ('subsidy', 'loan', 'other') AND NOT funding THEN 'funding' END,
    CASE WHEN kind = 'single_program' AND program IN ('incentive', 'benefit', 'loan') AND NOT applicants THEN 'conditions' END, CASE WHEN kind = 'single_program' AND program = 'incentive' AND cap = '' THEN 'method' END,
    CASE WHEN kind = 'single_program' AND program = 'benefit' AND NOT funding THEN 'payment' END, CASE WHEN kind = 'single_program' AND program = 'other' AND NOT expenses THEN 'details' END,
    CASE WHEN {_is("amount", "title")} AND name = '' THEN 'name' END, CASE WHEN {_is("amount", "title")} AND body_name = '' THEN 'body' END, CASE WHEN {_is("amount", "title")} AND NOT funding THEN 'funding' END,
    CASE WHEN (kind = 'single_program' OR {_is("year", "title")} OR {_is("deadline", "title")}) AND deadline = '' THEN 'deadline' END], lambda x: x IS NOT NULL)) AS lacks FROM g),
i AS (SELECT *, len(lacks) AS lacking, away > 0 OR {_is("official", "body")} AS route, len(list_filter(list_transform(own, lambda x: regexp_replace(x, '(?i)^https?://[^/?#]*', '')), lambda x: NOT regexp_matches(x, {_PATH_OK}))) > 0 AS astray,
  kind = 'single_program' OR ({_is("offering", "title")} AND NOT {_is("generic", "title")}) AS offering, NOT {_is("deadline_detail", "body")} OR deadline = '' OR NOT {_is("implementer", "body")} OR body_name = '' OR away = 0 OR NOT official AS wanting,
  greatest(0, least(100, 100 - 12 * len(lacks))) AS coverage, greatest(0, least(100, CASE WHEN official THEN 100 ELSE 60 END - 20 * n_unsupported - 35 * n_contradictory)) AS grounded FROM h),
j AS (SELECT *, long >= 4000 AND n_table >= 2 AND {_is("checklist", "html")} AND len(own) > 0 AND NOT astray AND {_is("action", "body")} AND NOT {_is("memo", "html")} AND detailed AND (program <> 'subsidy' OR started) AND route AND official AND {_is("local", "body")}
  AND n_unsupported = 0 AND n_contradictory = 0 AS excellent FROM i),
k AS (SELECT *, {_COUNT(_FAULTS)} AS n_faults, {_COUNT(_WARNINGS)} AS n_warnings, least(100, {", ".join(f"CASE WHEN {test} THEN {most} ELSE 100 END" for test, most in (*_FAULTS, *_WARNINGS, *_MORE_CAPS) if most)}) AS cap_value FROM j),
l AS (SELECT *, greatest(0, least(100, 100 - 12 * n_faults - 4 * n_warnings)) AS base FROM k)
SELECT doc_id, kind AS article_type, program AS program_kind, n_faults, n_warnings, cap_value AS least_cap, coverage, grounded, least(base, cap_value) AS content_score, least(base, cap_value, coverage, grounded) AS score,
  CASE WHEN least(base, cap_value, coverage, grounded) >= 90 THEN 'A' WHEN least(base, cap_value, coverage, grounded) >= 80 THEN 'B' WHEN least(base, cap_value, coverage, grounded) >= 60 THEN 'C' ELSE 'D' END AS grade FROM l"""


@register("article_reviews", _REVIEW_SQL)
def article_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("review")
    rows = review.reviewed(_articles(spark, sf_dir))
    return rows.select(
        "doc_id", r["article_type"].alias("article_type"), r["facts"]["program_kind"].alias("program_kind"), F.size(r["fatal_issues"]).alias("n_faults"), F.size(r["warnings"]).alias("n_warnings"), review.least_cap(r["caps"]).alias("least_cap"),
        r["source_coverage_score"].alias("coverage"), r["factual_grounding_score"].alias("grounded"), r["content_quality_score"].alias("content_score"), r["quality_score"].alias("score"), r["grade"].alias("grade"),
    )
