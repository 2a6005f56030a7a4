"""Merges by the table of precedence, and sections of details, on planted values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curatorium.functions import sections
from curatorium.operators import precedence as p

CASES = [
    ("title", "web", "古い題", "新しい題", p.TAKEN), ("title", "jgrants", "古い題", "新しい題", p.IS_LOCKED), ("title", "jgrants", "", "新しい題", p.FILLED), ("title", "web", "古い題", " ", p.NO_VALUE),
    ("application_period_text", "web", "", "2026年4月1日〜2026年5月31日", p.TAKEN), ("application_period_text", "web", "", "令和八年度の創業を支援する補助金の公募について", p.UNUSABLE), ("application_period_text", "web", "令和8年4月1日から", "2027/01/01", p.STAYS),
    ("application_period_text", "jgrants", "", "題だけ", p.FILLED), ("prefecture", "web", "全国", "愛媛県", p.STAYS), ("prefecture", "web", "不明", "愛媛県", p.TAKEN), ("region_text", "web", "", "東京都", p.UNUSABLE), ("official_url", "web", "http://a.jp", "https://b.jp", p.STAYS),
    ("official_url", "web", "なし", "b.jp", p.UNUSABLE), ("amount_text", "web", "50万円", "100万円", p.STAYS), ("amount_text", "web", "不明", "100万円", p.TAKEN), ("amount_text", "web", "公募要領参照", "100万円", p.TAKEN), ("subsidy_rate_text", "web", "2/3", "1/2", p.STAYS),
    ("subsidy_rate_text", "web", "公募要領に1/2以内", "1/2", p.TAKEN), ("summary", "jgrants", "古い", "新しい", p.TAKEN), ("summary", "web", "古い", None, p.NO_VALUE),
]


@pytest.mark.parametrize("name", sorted({c[0] for c in CASES}))
def test_reasons(spark, name):
    rows = [(k, *c[1:]) for k, c in enumerate(CASES) if c[0] == name]
    df = spark.createDataFrame(rows, "k int, source string, old string, new string, want string")
    out = p.merged({name: F.col("old")}, {name: F.col("new")}, F.col("source"))
    for r in df.select("old", "new", "want", *[c.alias(n) for n, c in out.items()]).collect():
        assert r["why"] == {name: r["want"]} and r[name] == (r["new"] if r["want"].startswith("taken") else r["old"])


def test_lists_and_new_fields(spark):
    df = spark.createDataFrame([(["a"], [], "x"), (["a"], ["b"], "x"), (None, [], None), (["a"], None, "")], "old array<string>, new array<string>, extra string")
    out = p.merged({"tags": F.col("old")}, {"tags": F.col("new"), "extra": F.col("extra")}, F.lit("jgrants"))
    got = [(r["tags"], r["extra"], r["why"]["tags"]) for r in df.select(*[c.alias(n) for n, c in out.items()]).collect()]
    assert got == [(["a"], "x", p.LIST), (["b"], "x", p.TAKEN), ([], None, p.TAKEN), (["a"], None, p.NO_VALUE)]


def test_unusable_values_are_dropped(spark):
    found = {"region": F.col("a"), "official_url": F.col("b"), "title": F.col("a")}
    got = spark.createDataFrame([("東京都", "x"), ("愛媛", "https://a.jp"), ("", None)], "a string, b string").select(*[c.alias(n) for n, c in p.checked(found).items()]).collect()
    assert [tuple(r) for r in got] == [(None, None, "東京都"), ("愛媛", "https://a.jp", "愛媛"), ("", None, "")]


def one(spark, c, *values):
    return spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values)))).select(c).first()[0]


@pytest.mark.parametrize(
    ("text", "labels", "want"),
    [
        ("対象者 | 法人 | 対象経費 | 設備費", ("対象経費",), "設備費"), ("対象者 | 対象経費 | 設備費", ("対象者",), ""), ("概要：<b>一</b>行目\n二行目\n\n別の節 | 後", ("目的", "概要"), "一 行目\n二行目 別の節"),
        ("申請期間 4月1日から ｜ 連絡先", ("申請期間",), "4月1日から"), ("連絡先", ("連絡先",), ""), (None, ("概要",), ""), ("何もない", ("概要",), ""), ("対象経費 https://a.jp/b 備品", ("対象経費",), "備品"),
    ],
)
def test_sections_by_labels(spark, text, labels, want):
    assert one(spark, sections.by_labels(F.col("c0"), labels), text) == want


def test_whole_overviews(spark):
    of = lambda t: one(spark, sections.overview(F.col("c0"), ("制度の概要", "概要")), t)
    assert of("制度の概要 | 一つ目 | https://a.jp | 二つ目■ | 対象者 | 法人") == "一つ目\n二つ目"
    assert of("制度の概要：本文の一行目\n二行目\n対象者：法人") == "本文の一行目\n二行目" and of("対象者：法人") == "" and of("概要") == ""


def test_items_of_details(spark):
    assert one(spark, sections.candidates(F.col("c0")), "設備費 / 不明 | 対象者 | https://a.jp ・備品\n機器 / " + "長" * 200) == ["設備費", "・備品", "機器"]
    items = spark.createDataFrame([(["創業補助金", "創業支援補助金の令和8年度公募", "設備", " "], "【創業支援補助金】の令和8年度公募")], "a array<string>, t string").select(sections.without_title(F.col("a"), F.col("t"))).first()[0]
    assert items == ["創業補助金", "設備"]
    assert one(spark, sections.first_known(F.col("c0"), F.col("c1"), F.col("c2")), "不明", " N/A ", "<b>値</b>") == "値" and one(spark, sections.looks_raw(F.col("c0")), "a | b | c | d | e") and not one(spark, sections.looks_raw(F.col("c0")), "短い値")
