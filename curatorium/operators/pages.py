"""Links and pages: scores, classes, gates and the crawl frontier."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text, urls
from curatorium.operators import rules
from curatorium.operators.stages import once


def _assists(c: Column) -> Column:
    return c.rlike(lexicon.ASSISTANCE)


def detail_signals(c: Column) -> Column:
    return text.matches(c, lexicon.DETAIL_SIGNALS)


def is_form(url: Column, title: Column, body: Column) -> Column:
    """Application forms: named so in title or address without a guideline, or in the body of a page without any detail."""
    name, head = F.concat_ws("\n", title, url), F.substring(body, 1, 1200)
    named, worded = text.matches(name, lexicon.FORMS) > 0, text.matches(head, lexicon.FORMS) > 0
    guided = text.matches(F.concat_ws("\n", name, head), lexicon.GUIDELINES) > 0
    return ~guided & (named | (worded & ~_assists(title) & (detail_signals(body) == 0)))


def is_index_title(title: Column) -> Column:
    flat = text.tight(title)
    return (flat != "") & flat.rlike("|".join(lexicon.INDEX_TITLES))


def is_index(url: Column, title: Column, body: Column, links: Column, subsidy_links: Column) -> Column:
    """Lists of pages rather than pages about one programme."""
    found = F.struct(F.lower(urls.normalised(url, "index")).alias("u"), detail_signals(body).alias("signals"), is_index_title(title).alias("generic"))

    def judge(f: Column) -> Column:
        u, signals, generic = f["u"], f["signals"], f["generic"]
        detail = u.rlike(r"\.html?$") & ~u.rlike(r"/index\.html?$") & ~generic & (_assists(title) | (signals >= 1))
        listlike = u.rlike(r"/(?:index\.html?|hojokin|josei|sangyou|sangyo|shien|life/[0-9]+|theme[0-9]+)/?$|/page/theme[0-9]+\.html$")
        many = (subsidy_links >= 4) & (signals < 4) | (links >= 80) & (subsidy_links >= 3) & (signals < 5)
        return ~detail & ((generic | listlike) & (signals < 4) | many | title.rlike("補助金|助成金|支援制度") & (subsidy_links >= 3) & (signals < 3))

    return text.bound(found, judge)


def page_type(url: Column, title: Column, body: Column, links: Column, subsidy_links: Column, pdf: Column) -> Column:
    """Class of a page, first match wins."""
    found = F.struct(F.concat_ws("\n", title, url, F.substring(body, 1, 2500)).alias("everything"), is_form(url, title, body).alias("form"), (pdf | urls.is_pdf(url)).alias("pdf"), detail_signals(body).alias("signals"))
    return text.bound(found, lambda f: _type(url, title, body, links, subsidy_links, f["everything"], f["form"], f["pdf"], f["signals"]))


def _type(url: Column, title: Column, body: Column, links: Column, subsidy_links: Column, everything: Column, form: Column, is_pdf: Column, signals: Column) -> Column:
    return rules.decision(
        [
            (urls.is_grant_portal(url), "jgrants_page"),
            (is_pdf & ~form & (text.matches(everything, lexicon.GUIDELINES) > 0), "pdf_guideline"),
            (is_pdf, "application_form"),
            (is_index(url, title, body, links, subsidy_links), F.when(F.concat_ws(" ", title, url).rlike("(?i)産業|商工|農業|観光|住宅|環境|kurashi|sangyo|life"), "category_index").otherwise("municipal_index")),
            (form, "application_form"),
            (F.concat_ws("\n", title, url).rlike("|".join(lexicon.NOISE)) & ~_assists(everything), "noise_page"),
            (everything.rlike(lexicon.PERSONAL_ASSISTANCE) & _assists(everything), "personal_assistance"),
            (url.rlike(r"(?i)\.html?\z") & url.rlike("(?i)hojo|hojokin|josei|shien") & ((signals >= 1) | _assists(everything) | F.contains(everything, F.lit("支援"))), "subsidy_detail"),
            ((signals >= 2) & _assists(everything), "subsidy_detail"),
        ],
        "unknown",
    )


def page_score(url: Column, title: Column, body: Column, links: Column, kind: Column) -> Column:
    """Additive score of a page for being about one programme."""
    def points(everything: Column) -> Column:
        found = rules.conditions(lexicon.PAGE_RULES, {"title": title, "url": url, "all": everything}, {"weak": ~_assists(everything), "pdf": urls.is_pdf(url)})
        short = F.length(F.trim(body))
        more = [
            (urls.is_grant_portal(url) | F.contains(everything, F.lit("jgrants-portal.go.jp")), -8, "portal"),
            (links >= 100, -5, "links"), ((short > 0) & (short < 300), -5, "short"), (is_form(url, title, body), -5, "form"), (kind.isin("subsidy_detail", "pdf_guideline"), 2, "kind"),
        ]
        return rules.score(found + more)

    return text.bound(F.concat_ws("\n", title, url, F.substring(body, 1, 5000)), points)


def scored_links(links: DataFrame, domains: Column | None = None) -> DataFrame:
    """Candidate links of index pages, scored: links has page, pos, url, text, heading, context, and nav (in a navigation area) or the flags of areas.links.

    Links of a page that share a normal form count once, the first one accepted. Adds link, score, reasons, penalties, same_domain, should_crawl.
    """
    link, label, heading = urls.normalised(F.col("url"), "index"), text.collapsed(F.col("text")), text.collapsed(F.col("heading"))
    rows = once(links, {"link": link, "text": label, "heading": heading}).where("link <> ''")
    link, label, heading = F.col("link"), F.col("text"), F.col("heading")
    strong = _assists(label) & ~label.rlike("事務補助|業務補助|作業補助")
    near = F.lit(True) if domains is None else urls.within(urls.host(link), domains)
    found = rules.conditions(lexicon.LINK_RULES, {"text": label, "heading": heading, "url": link}, {"weak": ~strong, "no_interest": ~label.rlike("利子補給|補助"), "pdf": urls.is_pdf(link)}, lexicon.LINK_FIELDS, lexicon.LINK_LABELS)
    around = [F.coalesce(c, F.lit(False)) for c in ("nav", *lexicon.AREAS) if c in links.columns]
    found += [(reduce(or_, around, F.lit(False)), -5, "common_navigation_area -5"), (~near, -4, "external_domain -4")]
    rows = once(rows, {"_hits": F.array(*[hit for hit, _, _ in found]), "_near": near})  # each rule is tried once, for the score and for its label
    found = [(F.get("_hits", F.lit(i)), points, name) for i, (_, points, name) in enumerate(found)]
    everything = F.concat_ws("\n", label, heading, F.col("context"), link)
    signal = _assists(everything) | everything.rlike("支援|公募|募集|交付") | link.rlike("(?i)hojo|josei|shien")
    here = F.concat_ws(" ", label, heading, link)
    excluded = text.any_contained(here, lexicon.EXCLUDED_LINKS) & ~_assists(here)
    judged = {"raw": rules.score(found), "reasons": rules.labels(found, True), "penalties": rules.labels(found, False), "same_domain": F.col("_near"), "excluded": excluded, "signal": signal, "keyword": text.any_contained(here, lexicon.INCLUDED_LINKS)}
    rows = once(rows, judged).drop("_hits", "_near")
    rows = rows.where("keyword or signal or raw >= 5").withColumn("score", F.when(F.col("excluded"), F.least("raw", F.lit(0))).otherwise(F.col("raw")))
    crawl = (F.col("score") >= 8) & F.col("same_domain") & ~F.col("excluded") & ~urls.is_grant_portal(link) & ~is_form(link, label, F.lit(""))
    first = Window.partitionBy("page", "link").orderBy("pos")
    rows = rows.withColumn("should_crawl", crawl).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.drop("raw", "signal", "keyword", "_n")


def anchors(pages: DataFrame) -> DataFrame:
    """(page, pos, url, text): the links of HTML pages (page_id, html) in the order they stand."""
    whole = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*?\bhref="[^"]*"[^>]*>.*?</a>'), 0)
    rows = pages.select(F.col("page_id").alias("page"), F.posexplode(whole).alias("pos", "a"))
    return rows.select("page", "pos", F.regexp_extract("a", r'(?is)\bhref="([^"]*)"', 1).alias("url"), text.without_html(F.regexp_extract("a", r"(?is)>(.*)</a>", 1)).alias("text"))


def frontier(links: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Pages reached from the seeds (url) over links (source, target) in at most `depth` steps: (url, depth), the smallest depth of each.

    Every step joins the last level's pages with the links and drops those already seen; the loop is as long as the depth only.
    """
    seen = level = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(links, level["url"] == links["source"]).select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(level)
    return seen


def noise_reason(title: Column, summary: Column, url: Column) -> Column:
    """Why a record is no subsidy, empty where it may be one; first match wins."""
    worded = F.concat_ws("\n", title, summary, url).rlike(lexicon.SUBSIDY_WORDS)
    return rules.decision(
        [
            (title.rlike("モニター"), "モニター募集の可能性が高い"),
            (title.rlike("名簿|登録を募集|利用者の募集|募集について") & ~worded, "募集案内で補助制度ではない可能性が高い"),
            (title.rlike("認定申請|保証[45]号|セーフティネット保証|危機関連保証"), "認定・保証申請ページの可能性が高い"),
            (title.rlike("商品券|キャンペーン") & ~worded, "商品券・キャンペーン案内の可能性が高い"),
            (title.rlike("融資制度") & ~title.rlike("利子補給|補助金|助成金|支援金"), "融資制度のみの案内の可能性が高い"),
            (title.rlike("導入計画") & ~worded, "導入計画のみの案内の可能性が高い"),
            (title.rlike("ビジョン|計画策定|策定しました|報告書") & ~worded, "計画・報告ページの可能性が高い"),
            (title.rlike("手当") & ~title.rlike("補助金|助成金|支援金|給付金"), "手当制度の案内の可能性が高い"),
            (title.rlike(r"(?:制度について|支援について|のご案内)\z") & ~worded, "制度案内ページの可能性が高い"),
        ]
    )
