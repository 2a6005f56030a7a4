"""URLs: parts, normal forms and the classes of the URL report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import lexicon

VALID = r"(?i)^[a-z][a-z0-9+.-]*://[^\s/?#]+"
WEB = r"(?i)^https?://"


def is_valid(u: Column) -> Column:
    return F.coalesce(u.rlike(VALID), F.lit(False))


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(u: Column) -> Column:
    """Lower-cased host, empty for what is no URL."""
    return F.coalesce(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def base_host(u: Column) -> Column:
    return F.regexp_replace(host(u), r"^www\.", "")


def path(u: Column) -> Column:
    """Path, / where there is none."""
    found = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)


def basename(u: Column) -> Column:
    """Last segment of the path, percent-decoded."""
    return F.try_url_decode(F.regexp_extract(path(u), r"([^/]*)/*$", 1))


def normalised(u: Column, profile: str = "crawl") -> Column:
    """Without fragment and tracking parameters; profiles crawl and index also drop one slash at the end; dup drops scheme, query and index pages."""
    out = F.trim(F.coalesce(u, F.lit("")))
    if profile == "dup":
        out = F.regexp_replace(out, r"(?i)^https?://|[?#].*$", "")
        return F.regexp_replace(F.regexp_replace(out, r"(?i)/(?:index|default)\.(?:html|php|aspx|jsp)$", ""), r"/$", "")
    names = "|".join(lexicon.TRACKING[profile])
    out = F.regexp_replace(out, r"#.*$", "")
    out = F.regexp_replace(out, rf"(?i)([?&])(?:{names})=[^&]*", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"&{2,}", "&"), r"\?&", "?")
    out = F.regexp_replace(out, r"[?&]+$", "")
    return out if profile == "fetch" else F.regexp_replace(out, r"/$", "")


def within(h: Column, domains: Column) -> Column:
    """Whether the host is one of the domains or below one; no domains allow all."""
    return (F.size(domains) <= 0) | F.exists(domains, lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))


def is_crawlable(u: Column, domain: Column) -> Column:
    """Of the domain and outside the denied parts of a site."""
    h = host(u)
    return ((h == domain) | h.endswith(F.concat(F.lit("."), domain))) & ~path(u).rlike(lexicon.DENIED_SEGMENTS)


def is_grant_portal(u: Column) -> Column:
    return host(u).rlike(r"(^|\.)jgrants-portal\.go\.jp$")


def is_pdf(u: Column) -> Column:
    return F.coalesce(u.rlike(r"(?i)\.pdf(?:\z|\?)"), F.lit(False))


def source_id(u: Column) -> Column:
    """Identity of an official page: a digest of its normal form."""
    return F.concat(F.lit("official_site:"), F.substring(F.sha2(normalised(u, "crawl"), 256), 1, 32))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def report(u: Column) -> dict[str, Column]:
    """Category, pattern and flags of a URL for the report; invalid URLs have no flag set."""
    ok, low = is_valid(u), F.lower(path(u))
    asset = low.startswith("/assets/") | low.startswith("/static/") | low.rlike(rf"[^/]\.(?:{'|'.join(lexicon.ASSET_EXTENSIONS)})$")
    category = F.when(~ok, "invalid-url").when(asset, "static-asset").when(low == "/", "top")
    for name, prefix in lexicon.ROUTES:
        category = category.when(low.startswith(prefix), name)
    category = category.otherwise("unknown")
    segment = F.regexp_extract(low, r"^/*([^/]+)", 1)
    slug = category.isin(list(lexicon.SLUG_ROUTES))
    pattern = F.when(category.isin("invalid-url", "static-asset"), category).when(category == "top", "/").when(slug, F.concat(F.lit("/"), category, F.lit("/:slug")))
    pattern = pattern.when(category != "unknown", F.concat(F.lit("/"), category)).when(segment == "", "/").otherwise(F.concat(F.lit("/"), segment, F.lit("/...")))
    flags = {
        "has_trailing_slash": (path(u) != "/") & path(u).endswith("/"),
        "is_http": scheme(u) == "http",
        "is_www": host(u).startswith("www."),
        "is_index_html": low.endswith("/index.html"),
        "has_double_slash": F.contains(path(u), F.lit("//")),
        "has_query": F.length(query(u)) > 1,
        "is_likely_missing": F.lower(u).rlike("|".join(lexicon.LIKELY_MISSING)),
        "is_static_asset": asset,
    }
    return {"category": category, "pattern": pattern} | {k: ok & F.coalesce(v, F.lit(False)) for k, v in flags.items()}
