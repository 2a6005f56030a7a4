"""Application status, expiry and sort keys from periods. Each variant is a function of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import dates, lexicon, text


def by_instants(start: Column, end: Column, period_text: Column, now: Column) -> Column:
    """From two instants and words that say "open"."""
    return (
        F.when(end < now, lexicon.CLOSED_STATUS)
        .when(start > now, lexicon.ANNOUNCED)
        .when(start <= now, lexicon.OPEN)
        .when(period_text.rlike(lexicon.OPEN_NOW), lexicon.OPEN)
        .otherwise(lexicon.UNKNOWN)
    )


def by_text(status: Column, period_text: Column, start: Column, end: Column, today: Column) -> Column:
    """struct(status, start, end) from the period text first and stored ISO dates next; unchanged where nothing decides. today: an ISO text."""
    t = F.trim(F.coalesce(period_text, F.lit("")))
    return text.bound(dates.period(t), lambda p: _by_period(status, t, p, start, end, today))


def _by_period(status: Column, t: Column, p: Column, start: Column, end: Column, today: Column) -> Column:
    s, e = F.coalesce(p["start"], dates.iso_or_null(start)), F.coalesce(p["end"], dates.iso_or_null(end))
    bad, closed = t.rlike(lexicon.BAD_PERIOD), t.rlike(lexicon.CLOSED)
    open_now = p["open_ended"] | ((s <= today) & (today <= e)) | (s.isNull() & (today <= e))
    same = lambda st, a, b: F.struct(st.alias("status"), a.alias("start"), b.alias("end"))
    return (
        F.when(t == "", same(status, start, end))
        .when(bad, same(F.when(status == lexicon.CLOSED_STATUS, status).otherwise(lexicon.UNKNOWN), start, end))
        .when((closed & (e.isNull() | (e < today))) | (e < today), same(F.lit(lexicon.CLOSED_STATUS), F.coalesce(s, start), F.coalesce(e, end)))
        .when(today < s, same(F.lit(lexicon.ANNOUNCED), s, F.coalesce(e, end)))
        .when(open_now, same(F.lit(lexicon.OPEN), F.coalesce(s, start), F.when(p["open_ended"], F.lit(None).cast("string")).otherwise(e)))
        .otherwise(same(status, start, end))
    )


def is_expired(c: Column, today: Column) -> Column:
    """Whether a deadline text lies before today. Without a date, years up to 2025 count as past; one date that only opens a period never expires."""
    return text.bound(F.struct(dates.in_text(c, today).alias("found"), dates.western(c).alias("flat")), lambda x: _expired(c, x["found"], x["flat"], today))


def _expired(c: Column, found: Column, flat: Column, today: Column) -> Column:
    opens = flat.rlike("開始|より|から|以降") & ~flat.rlike("まで|締切|必着")
    return (
        F.when(F.coalesce(c, F.lit("")).isin("", "不明", "未定") | F.contains(c, F.lit("随時")), False)
        .when(F.size(found) == 0, flat.rlike(lexicon.EXPIRED_YEARS))
        .when((F.size(found) == 1) & opens, False)
        .otherwise(F.array_max(found) < today)
    )


def is_closed(end: Column, period_text: Column, status: Column, today: Column) -> Column:
    """End date first, then the period text if it has a date, then the stored status."""
    dated = F.size(dates.in_text(period_text, today)) > 0
    return F.when(end.isNotNull(), end < today).when(dated, is_expired(period_text, today)).when(F.contains(period_text, F.lit("随時")), False).otherwise(F.coalesce(status == lexicon.CLOSED_STATUS, F.lit(False)))


def sort_millis(end: Column, period_text: Column, today: Column) -> Column:
    """Milliseconds to sort deadlines by: open and unknown ones last, unreadable ones just before them, texts of past years first."""
    return text.bound(dates.in_text(period_text, today), lambda found: _millis(end, period_text, found))


def _millis(end: Column, period_text: Column, found: Column) -> Column:
    late = F.coalesce(period_text, F.lit("")).isin("", "不明", "未定") | F.contains(period_text, F.lit("随時"))
    millis = lambda d: F.unix_date(d).cast("bigint") * 86_400_000
    return F.when(end.isNotNull(), millis(end)).when(late, F.lit(9999999999999)).when(F.size(found) > 0, millis(F.array_max(found))).when(dates.western(period_text).rlike(lexicon.EXPIRED_YEARS), F.lit(0)).otherwise(F.lit(9999999999998))
