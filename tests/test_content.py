"""Areas and headings of links, and focused texts, on planted pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curatorium.functions import focus
from curatorium.operators import areas
from curatorium.plans import content
from tests.compare import duck_rows, rows_of

BASE = "https://www.city.example.jp/life/12/index.html"
PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "<a href='/no'>no</a>";</script></head><body>
<!-- <a href="/comment">x</a> --><header id="gnav"><h1> 市の  <b>名前</b></h1><a href="/">トップ</a></header>
<div class="content"><p>first<p>second <a href='sub/a.html'>相対</a><br>
<section><h3>制度</h3><ul><li><a href="../b.html?x=1&amp;y=2">上の階</a> 説明<li><span><a href=/c>引用符なし</a></span></ul></section>
<table><tr><td>左<td><a href="https://other.example.org/d">表の中</a></table>
<div><div><div><div><a href="#here">ここ</a><a href="mailto:a@b">m</a><a href="javascript:void(0)">j</a><a href="">空</a><a name="anchor">名</a><a href="deep.html">深い</a></div></div></div></div>
</div><div id="tmp_footer"><ul><li><a href="/f">下</a></ul></div></body>"""
PLANTED = [
    ("https://www.city.example.jp/life/12/sub/a.html", "相対", "市の 名前", "firstsecond 相対 制度上の階 説明引用符なし 左表の中 ここmj空名深い", False, False, False),
    ("https://www.city.example.jp/life/b.html?x=1&y=2", "上の階", "制度", "上の階 説明", False, False, False),
    ("https://www.city.example.jp/c", "引用符なし", "制度", "引用符なし", False, False, False),
    ("https://other.example.org/d", "表の中", "市の 名前", "左表の中", False, False, False),
    ("https://www.city.example.jp/life/12/deep.html", "深い", "市の 名前", "ここmj空名深い", False, False, False),
]


def rows(spark, html, **more):
    df = areas.links(spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string"), **more)
    return [tuple(r)[2:] for r in df.orderBy("pos").collect()]


def test_links_of_the_content_area(spark):
    assert rows(spark, PAGE) == PLANTED


def test_links_of_the_whole_page(spark):
    got = rows(spark, PAGE, whole=True)
    assert got[0] == ("https://www.city.example.jp/", "トップ", "市の 名前", "市の 名前トップ", True, False, False)
    assert got[1:-1] == PLANTED and got[-1] == ("https://www.city.example.jp/f", "下", "市の 名前", "下", False, True, False)


@pytest.mark.parametrize(
    ("html", "heading"),
    [
        ("<div><h2>a</h2><p>x</p><h3>b</h3><p><a href='/x'>x</a></p><h4>c</h4></div>", "b"),  # the last before it
        ("<div><p><a href='/x'>x</a></p><h4>c</h4></div>", "c"),  # none before it: the parent's first
        ("<div><h2>far</h2><i><i><i><i><i><i><a href='/x'>x</a></i></i></i></i></i></i></div>", "far"),  # seven hops
        ("<h1>title</h1><div><div><h2>far</h2><i><i><i><i><i><i><i><a href='/x'>x</a></i></i></i></i></i></i></i></div></div>", "title"),  # eight
        ("<a href='/x'>x</a>", ""),
        ("<h2>before</h2><a href='/x'>x</a>", "before"),
    ],
)
def test_nearest_heading(spark, html, heading):
    assert [r[2] for r in rows(spark, html)] == [heading]


def test_page_areas_reads_entities_as_its_sql(spark, tmp_path):
    """Other entities than &amp;, and one cut off before its semicolon, in a page's first heading."""
    page = "<html><body><nav><ul><li><a href=\"/a\">a &amp;lt; b</a></li></ul></nav><h1>a &amp;&amp;amp; b &quot;c&middot; and&amp</h1><footer>x</footer></body></html>"
    spark.createDataFrame([(1, BASE, page), (2, BASE, page.replace("and&amp<", "and&am<"))], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    df = content.page_areas(spark, str(tmp_path))
    columns, told = duck_rows(str(tmp_path), content.ORACLES["page_areas"])
    assert rows_of(df.columns, df.collect()) == rows_of(columns, told) and len(told) == 10


def test_content_area_by_order_of_kinds(spark):
    """The first kind that holds a link or a longer text; a short one without links is passed over."""
    assert [r[1] for r in rows(spark, "<main>short</main><article><a href='/a'>a</a></article><div class='content'><a href='/b'>b</a></div>")] == ["a"]
    assert rows(spark, f"<a href='/out'>o</a><main>{'long ' * 80}</main>") == []
    assert [r[1] for r in rows(spark, "<div class='x main y'><a href='/a'>a</a></div><p><a href='/b'>b</a>")] == ["a"]


def test_odd_pages(spark):
    odd = [(1, None, None), (2, BASE, ""), (None, BASE, "<a href='/x'>x"), (3, None, "<a href='y'>y</a>"), (4, "::", "<a href='http://[bad'>y</a></div></p><a href=/ok>z"), (5, BASE, "<li>" * 3000 + "<a href='/z'>z</a>")]
    got = areas.links(spark.createDataFrame(odd, "page_id long, url string, html string")).collect()
    assert sorted(((r["page"], r["url"], r["text"]) for r in got), key=str) == sorted([(None, "https://www.city.example.jp/x", "x"), (3, "y", "y"), (4, "/ok", "z"), (5, "https://www.city.example.jp/z", "z")], key=str)
    assert areas.links(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def focused(spark, raw, title=""):
    return spark.createDataFrame([(raw, title)], "raw string, title string").select(focus.focused(F.col("raw"), F.col("title"))).first()[0]


LONG = "\n".join(f"{n}番目の行はこの制度の説明を続ける長めの文です。" for n in range(20))


def test_focus_starts_before_the_best_line(spark):
    raw = f"一行目の文\n二行目の文\n三行目の文\n四行目の文\n令和８年度　創業支援補助金（公募）について\n{LONG}\nお問い合わせ先 産業課\n{LONG}"
    got = focused(spark, raw, "令和8年度創業支援補助金公募").split("\n")
    assert got[0] == "二行目の文" and got[3] == "令和８年度　創業支援補助金（公募）について" and got[-1].startswith("19番目")


def test_focus_without_a_title_starts_at_a_word(spark):
    raw = f"あいさつの文です\nようこそお越しくださいました\n受付の案内\n{LONG}"
    assert focused(spark, raw).split("\n")[0] == "受付の案内"


def test_focus_drops_frames_and_short_repeats(spark):
    raw = f"トップページ > くらし\n観光\n観光案内所の受付\nＡＢＣ 受付\nabc受付\n{LONG}\nabc 受付\n{LONG}"
    got = focused(spark, raw).split("\n")
    assert got[:2] == ["観光案内所の受付", "ＡＢＣ 受付"] and got[2].startswith("0番目") and len(got) == 42  # long lines stay twice


def test_focus_falls_back_and_is_bounded(spark):
    assert focused(spark, None) == "" and focused(spark, "検索\n組織") == "検索\n組織"
    short = "はじめの文\r\nもう一つの文\r\n補助金の公募"
    assert focused(spark, short + "\nCopyright\n" + "x" * 400).startswith("はじめの文\nもう一つの文")
    assert len(focused(spark, "\n".join(f"{n}: {'長い行' * 20}" for n in range(400)))) == focus.MAX_CHARS
    marked = "![図](a.png)\n[要領](https://a.jp/b.pdf) の補助\n" + LONG
    assert focused(spark, marked).split("\n")[0] == "要領 https://a.jp/b.pdf の補助"


def test_focus_of_many_lines(spark):
    """Repeats are found by sorting, so a page of very many short lines is no square of them."""
    raw = "補助金の公募\n" + "\n".join(f"行{n % 7000}" for n in range(60_000))
    assert len(focused(spark, raw)) == focus.MAX_CHARS
