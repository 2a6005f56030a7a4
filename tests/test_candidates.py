"""Candidates of a page's fields against golden rows derived by reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.functions import candidates
from tests.test_functions import one


def test_values_and_items(spark):
    assert one(spark, candidates.value, "・【概要】対象経費：設備の購入費", "**対象者**: 県内の法人", None) == ["設備の購入費", "県内の法人", ""]
    assert one(spark, lambda c: candidates.is_item(c, "expense"), "設備の購入費", "費用", "補助率 2/3 の設備", "更新した設備の一覧", "よくある質問") == [True, False, False, False, False]
    assert one(spark, lambda c: candidates.is_item(c, "entity"), "県内に本店を置く法人", "法人", "締切のある団体") == [True, False, False]


def test_blocks_and_choice(spark):
    page = "制度の概要\n対象経費\n設備の購入費\n工事に要する経費\n募集期間 4月1日\n対象者：県内の中小企業\nお問い合わせ"
    lines = lambda c: F.split(c, "\n")
    assert one(spark, lambda c: candidates.around(lines(c), "対象経費", 1, 2), page, "なし") == [["制度の概要\n対象経費\n設備の購入費\n工事に要する経費"], []]
    assert one(spark, lambda c: candidates.chosen(F.array(F.lit("広告の費用"), F.lit("なし")), lines(c), "expense"), page)[0][:3] == ["広告の費用", "設備の購入費", "工事に要する経費"]
    assert "県内の中小企業" in one(spark, lambda c: candidates.chosen(None if c is None else F.lit(None).cast("array<string>"), lines(c), "entity"), page)[0]


def test_addresses(spark):
    text = "案内 https://example.com/a https://www.city.example.jp/hojo/x.pdf https://prtimes.jp/b と https://example.com/a"
    got = one(spark, lambda c: candidates.addresses(c, F.lit("https://www.pref.ehime.jp/page/1")), text, None)
    assert got == [["https://www.city.example.jp/hojo/x.pdf", "https://www.pref.ehime.jp/page/1", "https://example.com/a", "https://prtimes.jp/b"], ["https://www.pref.ehime.jp/page/1"]]


def test_confidence_and_warnings(spark):
    names = ("title", "organization", "region_text", "application_period_text", "application_status", "amount_text", "subsidy_rate_text", "official_url", "summary", "application_end_date")
    rows = spark.createDataFrame(
        [(0, *["x"] * 5, "100万円", "2/3以内", "u", "", "2026-01-01", 1_000_000, ["県内の法人"], ["設備の購入費"]), (1, *[None] * 10, 0, None, None), (2, "児童手当", "", "", "4月から", "不明", "", "", "", "", "", 0, [], ["謝金"])],
        "k int, " + ", ".join(f"{n} string" for n in names) + ", amount_max_yen long, target_entities array<string>, target_expenses array<string>",
    )
    f = {n: F.col(n) for n in (*names, "amount_max_yen", "target_entities", "target_expenses")}
    got = rows.select("k", candidates.confidence(f, {"title": F.col("title")}).alias("c"), candidates.warnings(f).alias("w")).orderBy("k").collect()
    assert [tuple(r["c"]) for r in got] == [(95, 85, 85, 93, 90, 87, 83, 76, 90), (40, 45, 45, 35, 40, 40, 35, 35, 40), (95, 45, 45, 88, 40, 90, 35, 70, 40)]
    assert [len(r["w"]) for r in got] == [0, 6, 5]
