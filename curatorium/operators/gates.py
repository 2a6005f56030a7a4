"""Gates of the crawl and of the editors' list: which periods and programmes to take, which sources are official, what a record lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import dates, lexicon, text, urls


def _has(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def is_period_like(c: Column) -> Column:
    """Whether a text has the shape of a period."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return ~t.isin("", lexicon.UNKNOWN) & t.rlike(lexicon.CRAWL_PERIOD)


def is_bad_period(c: Column, title: Column) -> Column:
    """Whether a text cannot stand as an application period: the title, a bare label, a date of an update, something else's period. An empty one is not bad."""
    t, name = F.trim(F.coalesce(c, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    titled = (name != "") & F.contains(t, name) & (F.length(t) <= F.length(name) + 20)
    label = t.rlike("^(?:申請期間|受付期間|募集期間|対象者|対象経費|補助率|上限金額)\\z") | ((F.length(t) <= 8) & t.rlike("期間|対象|概要|詳細"))
    update = t.rlike("^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日(?:現在)?(?:更新|掲載)?\\z|(?:更新|掲載)\\z|^(?:受付終了|募集終了|終了しました)\\z")
    grant = t.rlike("補助金|助成金|支援事業") & ~t.rlike("[0-9]{4}|令和|平成|月|日|随時|終了")
    return (t != "") & (titled | label | t.rlike(lexicon.CRAWL_NOT_PERIOD) | update | grant | ~is_period_like(t))


def safe_period(c: Column, title: Column) -> Column:
    """struct(before, after, reason): a bad period text is replaced by a hint at the official page."""
    before = F.trim(F.coalesce(c, F.lit("")))
    after = F.when(is_bad_period(c, title), F.lit(lexicon.SEE_OFFICIAL)).otherwise(before)
    return F.struct(before.alias("before"), after.alias("after"), F.when(before != after, F.lit("not_application_period_like")).otherwise(F.lit("")).alias("reason"))


def date_years(c: Column) -> Column:
    """Distinct Western years of full dates in a text, in the order they stand."""
    return F.array_distinct(F.transform(F.regexp_extract_all(dates.western(c), F.lit("([0-9]{4})年[0-9]{1,2}月[0-9]{1,2}日"), 1), lambda y: y.cast("int")))


def ended(title: Column, status: Column, period: Column, fiscal_year: Column, summary: Column, excerpt: Column, page: Column, today: Column) -> Column:
    """struct(should_skip, fiscal_years, date_years, current_fiscal_year, oldest_fiscal_year, is_closed, is_suspended, has_current_signal, reason) of a programme. A fiscal year begins in April; today is a date."""
    status, period = F.coalesce(status, F.lit("")), F.coalesce(period, F.lit(""))
    focus = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (title, period, fiscal_year, summary, excerpt)])
    whole = F.concat_ws("\n", focus, F.substring(F.coalesce(page, F.lit("")), 1, 5000))
    now = F.year(today) - F.when(F.month(today) >= 4, 0).otherwise(1)
    seen = F.struct(focus.alias("focus"), whole.alias("whole"), dates.fiscal_years(focus).alias("fiscal"), date_years(focus).alias("dated"), now.alias("now"), status.alias("status"), period.alias("period"))

    def judged(x: Column) -> Column:
        old = lambda years: F.exists(years, lambda y: x["now"] - y >= 2)
        closed = x["whole"].rlike(lexicon.ENDED) | F.contains(x["status"], F.lit("終了"))
        suspended = x["whole"].rlike(lexicon.SUSPENDED) | F.contains(x["status"], F.lit("休止"))
        running = x["focus"].rlike(lexicon.RUNNING) | F.exists(x["fiscal"], lambda y: y >= x["now"])
        over = x["period"].rlike(lexicon.ENDED_PERIOD)
        skip = ~running & (suspended | closed | (over & F.concat_ws("\n", x["status"], x["period"]).rlike("終了|休止")))
        reason = F.when(~skip, "").when(suspended, "suspended_program").when(old(x["fiscal"]), "old_closed_fiscal_year").when(closed | over, "ended_program").otherwise("")
        return F.struct(
            skip.alias("should_skip"), x["fiscal"].alias("fiscal_years"), x["dated"].alias("date_years"), x["now"].alias("current_fiscal_year"), F.array_min(x["fiscal"]).alias("oldest_fiscal_year"),
            closed.alias("is_closed"), suspended.alias("is_suspended"), running.alias("has_current_signal"), reason.alias("reason"),
        )

    return text.bound(seen, judged)


def has_review_note(note: Column, duplicate_of: Column, reason: Column) -> Column:
    return _has(note) | _has(duplicate_of.cast("string")) | _has(reason)


def needs_tags(purposes: Column, industries: Column) -> Column:
    """Whether a published record lacks purposes or industries."""
    filled = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x != "")), F.lit(0)) > 0
    return ~(filled(purposes) & filled(industries))


def official_url(official: Column, source: Column) -> Column:
    return F.trim(F.coalesce(text.first_present(official, source), F.lit("")))


def is_official(u: Column) -> Column:
    """Whether an address names a public body."""
    return text.any_contained(F.coalesce(u, F.lit("")), lexicon.OFFICIAL_PARTS)


def is_portal(u: Column) -> Column:
    """Whether an address is of another portal of grants."""
    u = F.coalesce(u, F.lit(""))
    return text.any_contained(u, lexicon.PORTALS) | (F.contains(u, F.lit("hojokin")) & ~is_official(u))


def is_of_host(u: Column, official_host: Column) -> Column:
    """Whether an address lies at the official host or under it; where none is known, at a public body's."""
    h, known = urls.host(u), F.coalesce(official_host, F.lit(""))
    return F.when(known == "", h.rlike(r"pref\.ehime\.jp|city\.|town\.|lg\.jp|go\.jp|or\.jp")).otherwise(h.endswith(known))


def title_tokens(title: Column, most: int = 8) -> Column:
    """Words of a title that tell it from others."""
    flat = F.regexp_replace(text.collapsed(title), r"[（()）【】［］\[\]「」『』・,，、。:：/／\-―—]", " ")
    return F.slice(F.array_distinct(F.filter(F.split(flat, r"\s+"), lambda w: (F.length(w) >= 2) & ~w.rlike(lexicon.TITLE_FILLERS))), 1, most)


def is_about(title: Column, c: Column) -> Column:
    """Whether a text holds the title, or two of its words, or one where it has no more than two."""
    name, flat = text.collapsed(title), text.collapsed(c)
    hits = lambda words: F.size(F.filter(words, lambda w: F.contains(flat, w)))
    enough = text.bound(title_tokens(title), lambda words: (F.size(words) > 0) & (hits(words) >= F.when(F.size(words) <= 2, 1).otherwise(2)))
    return (name != "") & (F.contains(flat, name) | enough)


def area_of(u: Column) -> Column:
    """struct(prefecture, municipality, organization, region_text) of a public body's address; null for others."""
    h = F.regexp_replace(urls.host(u), r"^www\.", "")
    place = F.element_at(F.create_map(*[F.lit(x) for pair in lexicon.MUNICIPALITY_HOSTS for x in pair]), h)
    name = F.when(h == lexicon.PREFECTURE_HOST, F.lit("")).otherwise(place)
    told = F.struct(F.lit("愛媛県").alias("prefecture"), name.alias("municipality"), F.when(name == "", F.lit("愛媛県")).otherwise(name).alias("organization"), F.lit("愛媛").alias("region_text"))
    return F.when(name.isNotNull(), told)


def missing_fields(amount: Column, period: Column, entities: Column, costs: Column, rate: Column) -> Column:
    """Names of the fields that a record does not state."""
    lacks = lambda c: ~_has(c) | text.any_contained(F.coalesce(c, F.lit("")), lexicon.NO_VALUE)
    return F.array_compact(F.array(*[F.when(lacks(c), F.lit(name)) for c, name in zip((amount, period, entities, costs, rate), lexicon.MISSING_FIELDS, strict=True)]))


def allowed_tags(tags: Column, allowed: Column, most: int = 8) -> Column:
    """Tags among the allowed ones (all where none are named), in their own order."""
    return F.slice(F.when(F.size(allowed) > 0, F.filter(tags, lambda t: F.array_contains(allowed, t))).otherwise(tags), 1, most)


def tags_in_text(c: Column, allowed: Column, most: int = 8) -> Column:
    """Allowed tags that a text holds."""
    return F.slice(F.filter(allowed, lambda t: F.contains(F.coalesce(c, F.lit("")), t)), 1, most)


def with_slash(u: Column) -> Column:
    """The address with a slash behind its path, to be tried where it fails; empty where it has one or names a file."""
    last = F.element_at(F.split(urls.path(u), "/", -1), -1)
    other = urls.is_valid(u) & (last != "") & ~last.rlike(r"(?i)\.[a-z0-9]{2,6}\z")
    return F.when(other, F.regexp_replace(u, r"^([^?#]*)", "$1/")).otherwise(F.lit(""))


def united(*tags: Column) -> Column:
    """Tags of all lists, each once, in order."""
    return F.array_distinct(F.concat(*[F.filter(F.coalesce(t, F.array().cast("array<string>")), lambda x: x != "") for t in tags]))
