"""Quality of records: issues, grades, filters, completeness, freshness, and claims of amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import dates, text, urls

ISSUES = {
    "missing_purpose_tags": "warning", "missing_industry_tags": "warning", "missing_official_url": "danger", "missing_amount": "warning",
    "unclear_application_period": "warning", "deadline_passed": "danger", "duplicate_candidate": "danger", "admin_review_note": "warning",
}


def issues(c: dict[str, Column], today: Column) -> Column:
    """Codes of a record's issues in a fixed order. c: purposes, industries, official_url, amount_text, period_text, published, duplicate_of_id, note."""
    late = dates.deadline(c["period_text"]) < today
    tests = {
        "missing_purpose_tags": F.coalesce(F.size(c["purposes"]), F.lit(0)) <= 0,
        "missing_industry_tags": F.coalesce(F.size(c["industries"]), F.lit(0)) <= 0,
        "missing_official_url": text.collapsed(c["official_url"]) == "",
        "missing_amount": text.is_missing(c["amount_text"]),
        "unclear_application_period": text.is_missing(c["period_text"]) | text.is_missing(c["period_text"], "period"),
        "deadline_passed": c["published"] & late,
        "duplicate_candidate": c["duplicate_of_id"].isNotNull(),
        "admin_review_note": F.coalesce(c["note"] != "", F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(hit, F.lit(code)) for code, hit in tests.items()]))


def grade(codes: Column) -> Column:
    """要確認 with any issue of danger, 情報不足 with any other, else 良好."""
    danger = [code for code, severity in ISSUES.items() if severity == "danger"]
    return F.when(F.exists(codes, lambda i: i.isin(danger)), "要確認").when(F.size(codes) > 0, "情報不足").otherwise("良好")


def publish_issues(codes: Column) -> Column:
    """Issues that warn before publishing."""
    return F.filter(codes, lambda i: ~i.isin("duplicate_candidate", "admin_review_note"))


def passes(codes: Column, name: str) -> Column:
    """Named filters of the review list."""
    if name == "all":
        return F.lit(True)
    if name == "needs_review":
        return F.size(codes) > 0
    if name == "missing_tags":
        return F.array_contains(codes, "missing_purpose_tags") | F.array_contains(codes, "missing_industry_tags")
    return F.array_contains(codes, {"missing_period": "unclear_application_period"}.get(name, name))


def completeness(*fields: Column) -> Column:
    """How many of the fields are neither null nor blank."""
    out = F.lit(0)
    for c in fields:
        out = out + F.coalesce((F.trim(c) != "").cast("int"), F.lit(0))
    return out


def freshness(checked: Column, today: Column) -> Column:
    """struct(days, status) since the latest of an array of dates: fresh to 30 days, aging to 60, then stale; unknown without a date."""
    days = F.greatest(F.datediff(today, F.array_max(checked)), F.lit(0))
    return F.struct(days.alias("days"), F.when(days.isNull(), "unknown").when(days > 60, "stale").when(days > 30, "aging").otherwise("fresh").alias("status"))


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def coverage_score(missing: Column) -> Column:
    """100 less 12 for each distinct missing fact."""
    return clamped(100 - 12 * F.size(F.array_distinct(missing)))


def grounding_score(unsupported: Column, contradictory: Column, official: Column) -> Column:
    """100, or 60 without official evidence, less 20 for an unsupported claim and 35 for a contradictory one."""
    return clamped(F.when(official, 100).otherwise(60) - 20 * unsupported - 35 * contradictory)


def letter(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 60, "C").otherwise("D")


def amounts(c: Column) -> Column:
    """Every amount of yen in a text."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), ",", "")
    found = F.regexp_extract_all(flat, F.lit(r"[0-9]+(?:\.[0-9]+)?\s*(?:億円|万円|千円|円)"), 0)
    factor = lambda m: F.when(F.contains(m, F.lit("億円")), 1e8).when(F.contains(m, F.lit("万円")), 1e4).when(F.contains(m, F.lit("千円")), 1e3).otherwise(1.0)
    return F.transform(found, lambda m: F.regexp_extract(m, "^([0-9.]+)", 1).cast("double") * factor(m))


def same_amount(a: Column, b: Column) -> Column:
    return F.arrays_overlap(amounts(a), amounts(b))


def internal_links(html: Column, domain: str) -> Column:
    """Paths of an article's links within the site."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s+[^>]*href=["']([^"']+)["'][^>]*>"""), 1)
    own = lambda h: h.startswith("/") | urls.host(h).endswith(domain)
    return F.transform(F.filter(hrefs, own), lambda h: F.when(h.startswith("/"), h).otherwise(F.concat(urls.path(h), urls.query(h))))
