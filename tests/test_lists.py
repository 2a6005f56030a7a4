"""Orders of the editors' list on planted rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.operators import search

#: In the order of Japanese readers.
TITLES = ["", "1番", "10番", "apple", "Banana", "cherry", "あい", "アイス", "いぬ", "かき", "ガラス", "きつね", "サクラ", "さる", "んま", "愛媛", "補助金"]


def test_titles_in_japanese_order(spark):
    rows = [(k, t) for k, t in enumerate(TITLES)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: hash(r[1])), "n int, title string")
    got = [r["title"] for r in df.orderBy(search.in_japanese(F.col("title")), "n").collect()]
    kana = [t for t in got if t and ord(t[0]) in range(0x3041, 0x30FF)]
    assert got[0] == "" and kana == ["あい", "アイス", "いぬ", "かき", "ガラス", "きつね", "サクラ", "さる", "んま"]
    assert got[3:6] == ["apple", "Banana", "cherry"] and {"1番", "10番"} == set(got[1:3]) and set(got[-2:]) == {"愛媛", "補助金"}
    assert got != [t for t in sorted(TITLES)]  # code points put katakana behind all hiragana


def test_orders_of_the_editors_list(spark):
    rows = [(1, 30, 100, "2026-05-01", "松山市", "い", 5), (2, None, None, None, None, "あ", 9), (3, 10, 900, "2026-01-01", "今治市", "う", None), (4, 30, 100, "2026-05-01", "", "ア", 9)]
    df = spark.createDataFrame(rows, "n int, published int, amount int, deadline string, region string, title string, fetched int")
    of = lambda sort: [r["n"] for r in df.orderBy(*search.admin_order(sort, *[F.col(c) for c in ("published", "amount", "deadline", "region", "title", "fetched", "n")])).collect()]
    assert of("published_at_desc") == [1, 4, 3, 2] and of("amount_desc") == [3, 1, 4, 2] and of("deadline_asc") == [3, 1, 4, 2] and of("fetched_at_desc") == [2, 4, 1, 3]
    ordered = of("region_title_asc")
    assert ordered.index(2) + 1 == ordered.index(4) and set(ordered) == {1, 2, 3, 4}  # both without a place, by title
    assert [r["n"] for r in search.visible(df, F.col("fetched") > 5, F.col("amount") >= 100).collect()] == [4] and search.visible(df).count() == 4
