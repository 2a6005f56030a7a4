"""Queries over merged records and over texts of details cut at their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.functions import lexicon, sections
from curatorium.operators import precedence
from curatorium.plans.shared import quoted, registry, table

QUERIES, ORACLES, register = registry()

#: Stored and extracted values of each field; a customer's key picks one of each.
_VALUES = {
    "title": (("創業補助金", "", None), ("別の題", None, "  ")),
    "application_period_text": ((None, "2026年4月1日から", "要領を参照"), ("", "2027/1/1まで", "松山市の創業を支援する補助金の公募についての題名です", "随時", None)),
    "prefecture": (("", "全国", "どこか", "愛媛県"), ("愛媛県", "東京都", None, "松山市")),
    "region_text": (("", "全国", "どこか"), ("四国", "東京都", "愛媛県内のいずれかの市町に事業所を置いてから一年を超える期間がたっている中小の事業者が対象")),
    "official_url": (("", "https://a.example.jp/", "ftp://x"), ("https://b.example.jp/x", "b.example.jp", "")),
    "amount_text": (("", "50万円", "不明", "公募要領参照", "上限あり"), ("100万円", "", "未定")),
    "subsidy_rate_text": (("2分の1", "公募要領参照", "不明", "", "要領の1/2以内"), ("3分の2", "", "以内")),
}
_LISTS = {"tags": (((), ("a",), None), ((), ("b", "c"), None))}


def _picked(values, by: int) -> Column:
    at = (F.floor(F.col("c_custkey") / by) % len(values) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(list(v) if isinstance(v, tuple) else v).cast("array<string>" if any(isinstance(x, tuple) for x in values) else "string") for v in values]), at)


def _sql_value(v) -> str:
    return "NULL" if v is None else f"[{', '.join(map(quoted, v))}]::VARCHAR[]" if isinstance(v, tuple) else quoted(v)


def _picked_sql(values, by: int) -> str:
    return f"CASE c_custkey // {by} % {len(values)} {' '.join(f'WHEN {k} THEN {_sql_value(v)}' for k, v in enumerate(values))} END"


def _reason_sql(name: str) -> str:
    old, new = f"trim(coalesce(old_{name}, ''))", f"trim(coalesce(new_{name}, ''))"
    rx = lambda c, p: f"regexp_matches({c}, {quoted(p)})"
    dated = lambda c: rx(c, lexicon.DATED)
    tests = {
        "period": lambda c: f"({c} <> '' AND NOT (length({c}) >= 20 AND {rx(c, lexicon.TITLE_LIKE)} AND NOT {dated(c)}) AND ({rx(c, lexicon.UNDATED_PERIOD)} OR {dated(c)}))", "region": lambda c: f"(length({c}) <= 40 AND {rx(c, lexicon.KNOWN_REGION)})", "address": lambda c: rx(c, "(?i)^https?://.+"),
        "amount": lambda c: f"({c} NOT IN ({', '.join(map(quoted, lexicon.NO_AMOUNT))}) AND {rx(c, '[0-9０-９]|上限|最大|限度額')})",
        "rate": lambda c: f"({c} NOT IN ({', '.join(map(quoted, lexicon.NO_AMOUNT))}) AND NOT {rx(c, lexicon.REFERENCE_ONLY)} AND {rx(c, lexicon.CONCRETE_RATE)})",
    }
    kind = precedence.KINDS.get(name)
    cases = [f"WHEN {new} = '' THEN {quoted(precedence.NO_VALUE)}"]
    if name in precedence.LOCKED:
        cases += [f"WHEN feed AND {old} <> '' THEN {quoted(precedence.IS_LOCKED)}", f"WHEN feed THEN {quoted(precedence.FILLED)}"]
    if kind in ("period", "region", "address"):
        cases.append(f"WHEN NOT {tests[kind](new)} THEN {quoted(precedence.UNUSABLE)}")
    if kind in tests:
        cases.append(f"WHEN {tests[kind](old)} THEN {quoted(precedence.STAYS)}")
    return f"CASE {' '.join(cases)} ELSE {quoted(precedence.TAKEN)} END"


_NAMES = (*_VALUES, *_LISTS)
_STEPS = {name: 2 + 3 * k for k, name in enumerate(_NAMES)}
_MERGE_SQL = f"""
WITH a AS (SELECT c_custkey, c_custkey % 3 = 0 AS feed, {", ".join(f"{_picked_sql(v[0], _STEPS[n])} AS old_{n}, {_picked_sql(v[1], _STEPS[n] + 1)} AS new_{n}" for n, v in (*_VALUES.items(), *_LISTS.items()))} FROM customer),
b AS (SELECT *, {", ".join(f"{_reason_sql(n)} AS why_{n}" for n in _VALUES)}, CASE WHEN new_tags IS NULL THEN {quoted(precedence.NO_VALUE)} WHEN coalesce(len(old_tags), 0) > 0 AND len(new_tags) = 0 THEN {quoted(precedence.LIST)} ELSE {quoted(precedence.TAKEN)} END AS why_tags FROM a)
SELECT c_custkey, {", ".join(f"CASE WHEN why_{n} LIKE 'taken%' THEN new_{n} ELSE old_{n} END AS {n}, why_{n}" for n in _NAMES)} FROM b"""


@register("merge_precedence", _MERGE_SQL)
def merge_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of field with stored and extracted values of every sort, merged, with the reason for each."""
    pairs = {n: (_picked(v[0], _STEPS[n]), _picked(v[1], _STEPS[n] + 1)) for n, v in (*_VALUES.items(), *_LISTS.items())}
    source = F.when(F.col("c_custkey") % 3 == 0, precedence.FEED).otherwise("web")
    out = precedence.merged({n: p[0] for n, p in pairs.items()}, {n: p[1] for n, p in pairs.items()}, source)
    rows = table(spark, sf_dir, "customer").select("c_custkey", *[c.alias(n) for n, c in out.items()])
    return rows.select("c_custkey", *_NAMES, *[F.col("why")[n].alias(f"why_{n}") for n in _NAMES])


#: Texts of details around a document's text: cells between bars, labels in prose, markup, and none.
_FORMS = (
    ("■対象者 | 小規模事業者 || 対象経費 | 設備費/工事費 | 申請期間 | | 概要 | ", "｜https://www.example.jp/a｜終わりの文｜連絡先：| 産業課"), ("制度の概要：", "\n対象者：法人  団体\n\n\n対象経費: 備品 https://x.example.jp/a 公式URL https://y.example.jp"),
    ("<p>【目的】<b>", "</b></p>募集期間 4月1日から ｜ 連絡先 産業課<br/>対象事業者"), ("", ""), ("対象経費", " / なし / 機器&amp;車両 | - | 制度名"),
)
_GROUPS = {"people": ("対象事業者", "対象者", "補助対象者"), "expenses": ("対象経費", "補助対象経費"), "period": ("申請期間", "募集期間"), "about": ("制度の概要", "概要", "目的")}


def _sql_ends(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _sql_normal(c: str) -> str:
    out = rf"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '\r', '', 'g'), '(?i)<br\s*/?>|</p>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("　", " ")):
        out = f"replace({out}, {quoted(name)}, {quoted(sign)})"
    return _sql_ends(rf"regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _sql_bare_urls(c: str) -> str:
    return _sql_ends(rf"regexp_replace({_sql_normal(c)}, 'https?://[^\s]+', '', 'g')")


def _sql_tidy(c: str) -> str:
    out = f"regexp_replace(regexp_replace({_sql_bare_urls(c)}, '[■□◆◇●○◎※]', ' ', 'g'), '[|｜]{{2,}}', ' | ', 'g')"
    return _sql_ends(rf"regexp_replace(regexp_replace(regexp_replace({out}, '\s*\|\s*', ' | ', 'g'), '\s*/\s*', ' / ', 'g'), '\s{{2,}}', ' ', 'g')")


_LABELS = ", ".join(map(quoted, lexicon.SECTION_LABELS))


def _sql_is_label(c: str) -> str:
    return f"regexp_replace({_sql_normal(c)}, '[:：]', '', 'g') IN ({_LABELS})"


def _sql_section(labels: tuple[str, ...]) -> str:
    cell = f"list_filter(list_transform(range(1, len(ts)), lambda i: CASE WHEN trim(regexp_replace(ts[i], '[:：]', '', 'g')) IN ({', '.join(map(quoted, labels))}) AND NOT {_sql_is_label('ts[i + 1]')} THEN ts[i + 1] END), lambda x: x IS NOT NULL)[1]"
    prose = []
    for label in labels:
        behind = rf"regexp_extract(v, '(?is){label}\s*[:：]?\s*(.{{1,{sections.MAX_SECTION}}})', 1)"
        cut = _sql_ends(rf"split_part(regexp_replace(regexp_split_to_array({behind}, '\n{{2,}}')[1], '｜', '|', 'g'), '|', 1)")
        prose.append(f"CASE WHEN {cut} <> '' AND NOT {_sql_is_label(cut)} THEN {cut} END")
    return f"coalesce({cell}, {', '.join(prose)}, '')"


_RAW_SQL = f"CASE CAST(doc_id % {len(_FORMS) + 1} AS INTEGER) {' '.join(f'WHEN {k} THEN {quoted(a)} || left(text, 300) || {quoted(b)}' for k, (a, b) in enumerate(_FORMS))} END"
_SECTION_SQL = rf"""
WITH r AS (SELECT doc_id, {_RAW_SQL} AS raw FROM documents), t AS (SELECT doc_id, raw, {_sql_tidy('raw')} AS v, {_sql_normal('raw')} AS n FROM r),
s AS (SELECT *, list_filter(list_transform(string_split(replace(v, '｜', '|'), '|'), lambda x: {_sql_normal('x')}), lambda x: x <> '') AS ts FROM t),
c AS (SELECT *, list_filter(list_transform(regexp_split_to_array(v, '[|｜/\n]'), lambda x: {_sql_normal('x')}), lambda x: lower(x) NOT IN ({', '.join(map(quoted, lexicon.UNKNOWN_WORDS))}) AND NOT {_sql_is_label('x')} AND NOT regexp_matches(x, '^https?://') AND length(x) <= {sections.MAX_ITEM}) AS items FROM s)
SELECT doc_id, {", ".join(f"{_sql_section(labels)} AS {name}" for name, labels in _GROUPS.items())}, len(items) AS n_items, md5(array_to_string(items, '|')) AS items,
  n <> '' AND (length(n) > {sections.LONG} OR len(regexp_extract_all(n, '[|｜]')) >= 4 OR len(regexp_extract_all(n, '\s/\s')) >= 4 OR regexp_matches(n, 'https?://') OR (regexp_matches(n, {quoted('|'.join(lexicon.SECTION_LABELS))}) AND length(n) > {sections.LONG_LABELLED})) AS raw_dump FROM c"""


@register("labelled_sections", _SECTION_SQL)
def labelled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, items and the looks of details made around documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW_SQL.replace("\n", "\\n")).alias("raw"))
    raw = F.col("raw")
    rows = rows.select("doc_id", *[sections.by_labels(raw, labels).alias(name) for name, labels in _GROUPS.items()], sections.candidates(raw).alias("_items"), sections.looks_raw(raw).alias("raw_dump"))
    return rows.select("doc_id", *_GROUPS, F.size("_items").cast("bigint").alias("n_items"), F.md5(F.array_join("_items", "|")).alias("items"), "raw_dump")
