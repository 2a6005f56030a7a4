"""Golden rows for the Column functions and small operators."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from curatorium.functions import dates, money, regions, status, text, urls
from curatorium.operators import dedupe, graph, pages, quality, relations, search
from curatorium.sources import tables


def one(spark, make, *values):
    """make of a column holding each value, in order."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["out"] for r in rows.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def test_amounts(spark):
    # The profiles differ: the largest of plain amounts, and the stored one, which knows n万m千円 and no 億.
    assert one(spark, money.largest, "上限50万円", "3万5千円", "1億円", None, "なし") == [500000, 5000, 100000000, 0, 0]
    assert one(spark, money.all_safe, "3万5千円", "1億円", None) == [[35000, 5000], [], []]
    assert one(spark, money.first, "50千円", "100万円（2件）")[1] == 1000000


def test_dates(spark):
    today = F.lit("2026-01-10").cast("date")
    found = one(spark, lambda c: dates.in_text(c, today), "2025年4月1日から6月30日", "令和元年5月1日", "未定", None)
    assert found[0] == [datetime.date(2025, 4, 1), datetime.date(2025, 6, 30)] and found[1] == [datetime.date(2019, 5, 1)]
    assert not found[2] and not found[3]


def test_text(spark):
    assert one(spark, text.without_html, "<p>a&amp;b</p><script>x</script><br>c", None) == ["a&b c", ""]
    assert one(spark, text.nfkc, "ＡＢＣ１２", None) == ["ABC12", None]
    assert one(spark, lambda c: text.truncated(c, 4), "abcdef", "abc") == ["abc…", "abc"]
    assert one(spark, text.tight, " a　b\n", None) == ["ab", ""]
    assert one(spark, text.escaped_xml, "<a&'\">") == ["&lt;a&amp;&apos;&quot;&gt;"]


def test_urls(spark):
    assert one(spark, lambda c: urls.normalised(c, "crawl"), "https://a.jp/x/?utm_source=q&b=1#top", "https://a.jp/x/") == ["https://a.jp/x/?b=1", "https://a.jp/x"]
    assert one(spark, lambda c: urls.normalised(c, "dup"), "http://a.jp/x/index.html?b=1") == ["a.jp/x"]
    assert one(spark, urls.host, "https://User@WWW.A.jp:80/x", "no address") == ["www.a.jp", ""]


def test_regions(spark):
    gate = one(spark, lambda c: regions.gate(c, F.lit(""), F.lit(""), F.lit("")), "全国", "香川県")
    assert [g["keep"] for g in gate] == [True, False]


def test_status_by_instants(spark):
    rows = spark.createDataFrame([(1, "2026-01-01", "2026-02-01"), (2, "2026-03-01", None), (3, None, "2025-01-01")], "k int, a string, b string")
    at = F.to_timestamp_ntz(F.lit("2026-01-15"))
    out = rows.select("k", status.by_instants(F.to_timestamp_ntz("a"), F.to_timestamp_ntz("b"), F.lit(""), at).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in out] == ["公募中", "予告", "受付終了"]


def test_keys(spark):
    row = spark.range(1).select(
        dedupe.crawl_key(F.lit("a b"), F.lit("t"), F.lit("2026"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("通 年")).alias("c"), dedupe.import_key(F.lit(None).cast("string"), F.lit("t"), F.lit("2026"), F.lit("s"), F.lit("e")).alias("i")
    ).first()
    assert row["c"] == "ab::t::2026::通年" and row["i"] == "::t::2026::s::e"


def test_title_key(spark):
    assert one(spark, dedupe.title_key, "松山市：創業支援金（第2回）の募集について")[0] == one(spark, dedupe.title_key, "創業補助金の")[0]


def test_fuzzy_groups_are_greedy(spark):
    """c matches members of two groups and joins the first; the groups stay apart."""
    rows = [(1, 1, "x", ["a"], None), (2, 2, "y", ["b"], None), (3, 3, "x", ["b"], None), (4, 4, None, ["d"], "aaaaaaaa longer title"), (5, 5, None, ["e"], "a longer title"), (6, 6, None, [], None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "id long, seq long, ext string, urls array<string>, title string, org string, region string")
    got = {r["id"]: r["group_id"] for r in dedupe.fuzzy_groups(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6}


def test_most_similar(spark):
    body = lambda seed: "".join(chr(0x4E00 + (i * i * seed + i * 7 + seed) % 3000) for i in range(1300))
    one_, two = body(3), body(3)[:700] + body(5)[700:]
    rows = spark.createDataFrame([(1, one_), (2, one_), (3, two), (4, body(11)), (5, "short")], "id long, content string")
    got = {r["id"]: (r["other_id"], round(r["score"], 2)) for r in dedupe.most_similar(rows).collect()}
    assert got[1] == (2, 1.0) and got[2] == (1, 1.0) and got[3][0] == 1 and 0 < got[3][1] < 1 and 5 not in got


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "source string, target string")
    got = {r["url"]: r["depth"] for r in pages.frontier(links, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_search(spark):
    df = spark.createDataFrame([(1, "Red bolt"), (2, None), (3, "blue")], "k int, v string")
    assert [r["k"] for r in search.keyword_filter(df, "RED", F.col("v")).collect()] == [1] and search.keyword_filter(df, "", F.col("v")).count() == 3
    assert [r["k"] for r in search.page_of(df, 2, 2, F.col("k")).collect()] == [3]


def test_upsert_and_quality(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {tuple(r) for r in relations.upserted(old, new, ["id"]).select("id", "v", "action").collect()} == {(1, "a", "kept"), (2, "c", "updated"), (3, "d", "inserted")}
    assert [r["g"] for r in spark.range(1).select(quality.letter(F.lit(92)).alias("g")).collect()] == ["A"]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.jp/?x=1&y=2", datetime.date(2026, 5, 26)), ("https://a.jp/z", None)], "location string, changed date")
    tables.write_sitemap(rows, str(tmp_path / "map"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "map")).collect())
    assert lines == ["<url><loc>https://a.jp/?x=1&amp;y=2</loc><lastmod>2026-05-26</lastmod></url>", "<url><loc>https://a.jp/z</loc></url>"]
    (tmp_path / "report.csv").write_text('﻿URL,Reason\n"https://a.jp/x,y",404\n,\nhttps://b.jp/,404\n', encoding="utf-8")
    assert sorted(r["url"] for r in tables.read_url_report(spark, str(tmp_path / "report.csv")).collect()) == ["https://a.jp/x,y", "https://b.jp/"]
    for run, n in (("r1", 1), ("r2", 2), ("r1", 3)):
        tables.append_audit(spark.range(n), str(tmp_path / "audit"), run)
    assert {r["run_id"]: r["count"] for r in spark.read.parquet(str(tmp_path / "audit")).groupBy("run_id").count().collect()} == {"r1": 3, "r2": 2}


def test_stream_upserts(spark, tmp_path):
    from curatorium.streaming import ingest

    schema = "id int, v string, at int"
    for k, rows in enumerate([[(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(2, "d", 5), (3, "e", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ingest.upsert_stream(stream, str(tmp_path / "out"), ["id"], "at", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    last = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir())
    assert last == 1 and {r["id"] for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()} == {1, 2, 3}


@pytest.mark.parametrize("f", [dedupe.loose_key, dedupe.title_key])
def test_null_titles(spark, f):
    assert one(spark, f, None) == [None]
