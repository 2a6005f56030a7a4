"""Periods, expenses, imports and the list view against golden rows derived by reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.functions import expenses, periods
from curatorium.operators import imports, search
from tests.test_functions import one


def test_expense_items(spark):
    got = one(spark, expenses.items, "・機械装置費、補助率 2/3<br>①委託費及び謝金", "対象経費：専門家謝金／旅費。", "上限50万円", None, "設備、設備費、機械装置費")
    assert got == [["機械装置費", "3 ①委託費", "謝金", "委託費"], ["専門家謝金", "旅費"], [], [], ["設備", "設備費", "機械装置費"]]
    assert one(spark, expenses.known, "設備費と設備、広告宣伝費・広報費", "謝金と専門家謝金") == [["広告宣伝費", "設備費"], ["専門家謝金"]]
    assert one(spark, expenses.cleaned, "1.補助対象経費：工事費。", "3年以内", "材料費以内", "あ") == ["工事費", "", "材料費以内", ""]


def test_rates(spark):
    assert one(spark, expenses.stated_rate, "２／３ 以内", "上限50万円", "<b>1/2</b>", "", "対象経費") == ["2／3以内", "", "1/2", "", ""]
    assert one(spark, lambda c: expenses.rate(F.lit("上限10万円"), c), "補助率：2分の1以内", "定額") == ["2分の1以内", ""]


def test_period_lines(spark):
    lines = ("申請期間：令和6年4月1日～令和6年6月28日", "対象者：令和6年4月1日に住民登録がある方", "募集開始 令和6年4月1日", "令和6年4月1日", None)
    assert one(spark, periods.is_good, *lines) == [True, False, False, False, False]
    assert one(spark, periods.is_bad, *lines) == [False, True, False, False, False]
    assert one(spark, periods.deadline_score, "企画提案書の提出期限", "参加申込書 締切", "申請期限", "審査結果の通知", "質問に対する回答 締切") == [120, 70, 60, 0, 0]


def test_period_dates(spark):
    got = one(spark, periods.ends, "令和6年4月1日（月）から6月28日まで", "2026年6月30日", "2026年4月1日 予算がなくなり次第終了", "対象者 2026年4月1日", None)
    assert [tuple(x) for x in got] == [("2024-04-01", "2024-06-28", False), (None, "2026-06-30", False), ("2026-04-01", None, True), (None, None, False), (None, None, False)]


def test_best_period(spark):
    pages = (
        "公募開始｜令和6年4月1日\n参加申込書の提出期限｜令和6年5月10日\n企画提案書の提出期限｜令和6年5月31日（金）17時まで\n審査｜令和6年6月10日",
        "制度の案内\n申請期間\n令和6年4月1日から令和6年6月28日まで\n対象者：市民",
        "更新日 令和6年4月1日",
        None,
    )
    best = one(spark, lambda c: periods.best(F.array().cast("array<string>"), F.split(F.coalesce(c, F.lit("")), "\n")), *pages)
    assert best[0] == "令和6年4月1日 ～ 令和6年5月31日（金）17時まで" and best[2:] == ["", ""]
    labelled = one(spark, lambda c: periods.best(F.array(c), F.array().cast("array<string>")), "申請期間\n令和6年4月1日から令和6年6月28日まで", "申請期限：令和6年6月28日")
    assert labelled == ["令和6年4月1日から令和6年6月28日まで", "令和6年6月28日まで"]


def test_period_status(spark):
    rows = spark.createDataFrame(
        [(0, "受付終了しました", None, None, ""), (1, "", None, None, "予告"), (2, "p", "2026-03-01", None, ""), (3, "p", None, "2026-01-01", "公募中"), (4, "随時", None, None, ""), (5, "p", "2026-01-01", "2026-12-31", ""), (6, None, None, None, None)],
        "k int, p string, a string, b string, s string",
    )
    got = rows.select("k", periods.status(F.col("p"), F.col("a"), F.col("b"), F.col("s"), F.lit("2026-02-01")).alias("out")).orderBy("k").collect()
    assert [r["out"] for r in got] == ["受付終了", "予告", "予告", "受付終了", "公募中", "不明", "不明"]


def test_imports(spark):
    feed = [("id", "S1"), ("title", "省エネ補助金"), ("institution_name", "愛媛県"), ("target_area_search", "愛媛県"), ("target_area_detail", None), ("use_purpose", "設備投資/省エネ"), ("industry", None), ("target_expense", "設備費、工事費"), ("subsidy_rate", "1/2"), ("subsidy_max_limit", "500万円"), ("detail", "<p>概要</p>"), ("subsidy_catch_phrase", None), ("target_number_of_employees", "20名以下"), ("front_subsidy_detail_page_url", None), ("acceptance_start_datetime", "2026-01-05 00:00:00"), ("acceptance_end_datetime", "2026-03-31 17:00:00"), ("project_end_deadline", None), ("fiscal_year", None), ("search_area", None), ("search_keyword", "")]
    schema = ", ".join(f"{c} string" for c, _ in feed) + f", workflow array<{imports.ROUND}>"
    round_ = lambda **own: tuple(own.get(c) for c in ("id", "fiscal_year_round", *imports.OVERRIDDEN, "detail"))
    row = tuple(v for _, v in feed)
    rows = [(*row, [round_(id="1", fiscal_year_round="令和7年度"), round_(target_area_search="香川県"), round_(subsidy_max_limit="1億円", subsidy_rate="2/3")]), ("S2", *row[1:], None), ("", *row[1:], None)]
    got = {r["source_external_id"]: r for r in imports.normalised(spark.createDataFrame(rows, schema), F.to_timestamp(F.lit("2026-02-01"))).collect()}
    assert set(got) == {"S1:1", "S1:workflow-2", "S1:workflow-3", "S2:workflow-1"}
    one_, three = got["S1:1"], got["S1:workflow-3"]
    assert (one_["title"], one_["fiscal_year"], one_["amount_max_yen"], one_["subsidy_rate_text"], one_["target_expenses"]) == ("省エネ補助金（令和7年度）", "令和7年度", 5_000_000, "1/2", ["設備費", "工事費"])
    assert (three["amount_max_yen"], three["subsidy_rate_text"], three["amount_text"]) == (100_000_000, "2/3", "上限 100,000,000円")
    assert one_["application_status"] == "公募中" and one_["application_start_date"] == "2026-01-05" and one_["application_period_text"] == "2026年1月5日から2026年3月31日まで"
    assert one_["tags"] == ["設備投資", "省エネ", "業種指定無し"] and one_["target_entities"] == ["対象従業員数：20名以下"] and one_["official_url"].endswith("/S1") and one_["prefecture"] == "愛媛県"
    assert one_["dedupe_key"] == "愛媛県::省エネ補助金（令和7年度）::令和7年度::2026-01-05::2026-03-31"


def test_list_view(spark):
    rows = spark.createDataFrame([(1, False, 5, 30, 0.0, "b"), (2, True, 9, 10, 50.0, "a"), (3, False, 7, 20, 90.0, None)], "n int, closed boolean, newest int, due int, amount double, title string")
    order = lambda mode, sort: [r["n"] for r in search.of_mode(rows, mode, F.col("closed")).orderBy(*search.list_order(mode, sort, *map(F.col, ("closed", "newest", "due", "amount", "title", "n")))).collect()]
    assert [order("all", s) for s in ("newest", "deadline", "amount_desc", "amount_asc", "title", "other")] == [[3, 1, 2], [3, 1, 2], [3, 1, 2], [3, 1, 2], [3, 1, 2], [3, 1, 2]]
    assert order("open", "title") == [3, 1] and order("closed", "newest") == [2]
    pages = spark.createDataFrame([(1, 9), (2, 9), (5, 9), (8, 9), (9, 9), (1, 3), (1, 0)], "p int, n int")
    assert [r[0] for r in pages.select(search.page_numbers(F.col("p"), F.col("n"))).collect()] == [[1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [3, 4, 5, 6, 7], [5, 6, 7, 8, 9], [5, 6, 7, 8, 9], [1, 2, 3], []]
    times = spark.createDataFrame([(7, None, "2026-01-01 00:00:00"), (8, "bad", ""), (9, "2026-01-02", None)], "id int, a string, b string")
    assert [r[0] for r in times.select(search.newness([F.col("a"), F.col("b")], F.col("id"))).collect()] == [1767225600000, 8, 1767312000000]
