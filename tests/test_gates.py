"""Gates against golden rows derived by reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.operators import gates
from tests.test_functions import one


def test_periods(spark):
    texts = ("令和8年4月1日から5月31日まで", "省エネ補助金", "申請期間", "2026年4月1日更新", "対象期間：令和8年4月", "支援事業の案内", "随時受付", "", None, "受付終了")
    assert one(spark, lambda c: gates.is_bad_period(c, F.lit("省エネ補助金")), *texts) == [False, True, True, True, True, True, False, False, False, True]
    assert [tuple(x) for x in one(spark, lambda c: gates.safe_period(c, F.lit("")), "通年", "概要")] == [("通年", "通年", ""), ("概要", "公式ページをご確認ください", "not_application_period_like")]
    assert one(spark, gates.date_years, "令和6年4月1日、2025年5月1日、平成元年1月8日、令和6年3月", None) == [[2024, 2025, 1989], []]


def test_ended(spark):
    rows = spark.createDataFrame(
        [(0, "令和4年度省エネ補助金", "受付終了", "", ""), (1, "令和8年度省エネ補助金", "受付終了", "", ""), (2, "補助金", "", "", "現在、受付を休止しています"), (3, "補助金", "", "令和7年3月31日まで", ""), (4, "補助金", "終了", "2025年3月31日まで", ""), (5, None, None, None, None)],
        "k int, t string, s string, p string, page string",
    )
    none = F.lit(None).cast("string")
    got = rows.select("k", gates.ended(F.col("t"), F.col("s"), F.col("p"), none, none, none, F.col("page"), F.lit("2026-05-01").cast("date")).alias("e")).orderBy("k").collect()
    assert [(r["e"]["should_skip"], r["e"]["reason"]) for r in got] == [(True, "old_closed_fiscal_year"), (False, ""), (True, "suspended_program"), (False, ""), (True, "ended_program"), (False, "")]
    assert got[0]["e"]["oldest_fiscal_year"] == 2022 and got[0]["e"]["current_fiscal_year"] == 2026 and got[3]["e"]["date_years"] == [2025]


def test_sources(spark):
    u = ("https://www.city.matsuyama.ehime.jp/a", "https://hojokin.example.com/x", "https://note.com/y", "https://www.pref.ehime.jp/", "no address", None)
    assert one(spark, gates.is_official, *u) == [True, False, False, True, False, False]
    assert one(spark, gates.is_portal, *u) == [False, True, True, False, False, False]
    assert [x and x["municipality"] for x in one(spark, gates.area_of, *u)] == ["松山市", None, None, "", None, None]
    assert one(spark, lambda c: gates.is_of_host(c, F.lit("ehime.jp")), *u)[:2] == [True, False] and one(spark, lambda c: gates.is_of_host(c, F.lit("")), *u)[:2] == [True, False]
    assert one(spark, gates.with_slash, "https://a.jp/x?q=1", "https://a.jp/x/", "https://a.jp/x.pdf", "bad") == ["https://a.jp/x/?q=1", "", "", ""]
    assert one(spark, lambda c: gates.official_url(c, F.lit(" b ")), "a ", "", None) == ["a", "b", "b"]


def test_titles(spark):
    title = F.lit("令和8年度 松山市 省エネ設備導入 補助金（第2回）")
    assert one(spark, gates.title_tokens, "令和8年度 松山市 省エネ設備導入 補助金（第2回）")[0] == ["松山市", "省エネ設備導入", "第2回"]
    assert one(spark, lambda c: gates.is_about(title, c), "松山市の省エネ設備導入について", "松山市", "", None) == [True, False, False, False]


def test_records(spark):
    rows = spark.createDataFrame([(1, "x", None, ["a", ""], ["b"]), (2, None, "", [""], ["b"]), (3, "", "", None, None)], "k int, note string, reason string, p array<string>, i array<string>").orderBy("k")
    assert [r[0] for r in rows.select(gates.has_review_note(F.col("note"), F.lit(None).cast("long"), F.col("reason"))).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(gates.needs_tags(F.col("p"), F.col("i"))).collect()] == [False, True, True]
    assert [r[0] for r in rows.select(gates.united(F.col("p"), F.col("i"))).collect()] == [["a", "b"], ["b"], []]
    assert one(spark, lambda c: gates.missing_fields(c, F.lit("4月"), F.lit(""), F.lit("要確認です"), F.lit("1/2")), "100万円", "不明", None) == [["対象事業者", "対象経費"], ["金額", "対象事業者", "対象経費"], ["金額", "対象事業者", "対象経費"]]
    tags = F.array(F.lit("DX"), F.lit("農業"))
    assert one(spark, lambda c: gates.allowed_tags(tags, F.split(c, ",")), "農業,観光") == [["農業"]] and one(spark, lambda c: gates.tags_in_text(c, tags), "農業のDX", None) == [["DX", "農業"], []]
