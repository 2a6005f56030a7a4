"""Dates in Japanese text. Today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text

ERAS = {"令和": 2018, "平成": 1988}


def western(c: Column, eras=("令和", "平成")) -> Column:
    """Era years as Western years, with ASCII digits: 令和元年 is 2019年. The text is cut at each era year and put together again with the year computed."""
    out = text.ascii_digits(c)
    for era in eras:
        out = text.bound(out, _without(era, ERAS[era]))
    return out


def _without(era: str, base: int):
    """A function that writes the years of one era as Western ones."""

    def f(t: Column) -> Column:
        years = F.transform(F.regexp_extract_all(t, F.lit(f"{era}(元|[0-9]+)年"), 1), lambda y: _year(y, base))
        gaps = F.split(t, f"{era}(?:元|[0-9]+)年", -1)
        joined = F.concat_ws("", F.flatten(F.zip_with(gaps, years, lambda g, y: F.array(g, F.coalesce(y, F.lit(""))))))
        return F.when(F.contains(t, F.lit(era)), joined).otherwise(t)

    return f


def _year(y: Column, base: int) -> Column:
    return F.concat((F.when(y == "元", F.lit(1)).otherwise(F.try_to_number(y, F.lit("9999999999")).cast("bigint")) + F.lit(base)).cast("string"), F.lit("年"))


def in_text(c: Column, today: Column) -> Column:
    """All dates of a text: [year 年] month 月 day, a year carried on to later dates without one (the first ones are of today's year), then dates in digits. Days past a month's end run on into the next."""
    return text.bound(western(c), lambda flat: _in_western(flat, today))


def _in_western(flat: Column, today: Column) -> Column:
    spoken = F.regexp_extract_all(flat, F.lit(r"(?:[0-9]{4}年)?[0-9]{1,2}月[0-9]{1,2}"), 0)
    zero = F.struct(F.year(today).alias("year"), F.array().cast("array<date>").alias("found"))

    def step(acc, m):
        own = F.regexp_extract(m, r"^([0-9]{4})年", 1)
        year = F.when(own != "", own.cast("int")).otherwise(acc["year"])
        month, day = F.regexp_extract(m, r"([0-9]{1,2})月", 1).cast("int"), F.regexp_extract(m, r"月([0-9]{1,2})", 1).cast("int")
        return F.struct(year.alias("year"), F.concat(acc["found"], F.array(_run_on(year, month, day))).alias("found"))

    first = F.aggregate(spoken, zero, step, lambda acc: acc["found"])
    digits = F.regexp_extract_all(flat, F.lit(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}"), 0)
    second = F.transform(digits, lambda m: _run_on(*[F.element_at(F.split(m, "[-/.]"), i).cast("int") for i in (1, 2, 3)]))
    return F.concat(first, second)


def _run_on(year: Column, month: Column, day: Column) -> Column:
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)


def iso_or_null(c: Column) -> Column:
    """The text if it has the shape of an ISO date; its day is not checked."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c)


def period(c: Column) -> Column:
    """struct(start, end, open_ended) of a period text, ISO texts: open-ended words give the first date only; two dates or more give the first and the last; a range may leave out the second year; one date is the end."""
    return text.bound(text.collapsed(F.translate(western(c), "〜~－―ー", "～～---")), _period)


def _period(flat: Column) -> Column:
    shape = r"20[0-9]{2}年\s*[0-9]{1,2}月\s*[0-9]{1,2}"
    return text.bound(F.transform(F.regexp_extract_all(flat, F.lit(shape), 0), _iso), lambda found: _spread(flat, shape, found))


def _spread(flat: Column, shape: str, found: Column) -> Column:
    first, last = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(-1))
    tail = F.regexp_extract(flat, rf"{shape}日?.{{0,40}}(?:から|より|～|-).{{0,40}}?([0-9]{{1,2}}月\s*[0-9]{{1,2}})", 1)
    ranged = F.when(tail != "", _iso(F.concat(F.substring(first, 1, 4), F.lit("年"), tail)))
    is_open = flat.rlike(lexicon.OPEN_ENDED)
    start = F.when(is_open | (F.size(found) >= 2) | ranged.isNotNull(), first)
    end = F.when(is_open, F.lit(None)).when(F.size(found) >= 2, last).otherwise(F.coalesce(ranged, first))
    return F.struct(start.alias("start"), end.alias("end"), is_open.alias("open_ended"))


def _iso(m: Column) -> Column:
    return F.concat_ws("-", F.regexp_extract(m, r"([0-9]{4})年", 1), F.lpad(F.regexp_extract(m, r"([0-9]{1,2})月", 1), 2, "0"), F.lpad(F.regexp_extract(m, r"月\s*([0-9]{1,2})", 1), 2, "0"))


def deadline(c: Column) -> Column:
    """Latest full date of a period text, null where it is open-ended or has none."""
    return text.bound(western(text.collapsed(c), ("令和",)), _last_day)


def _last_day(flat: Column) -> Column:
    found = F.transform(F.regexp_extract_all(flat, F.lit(r"20[0-9]{2}[年/.-]\s*[0-9]{1,2}[月/.-]\s*[0-9]{1,2}"), 0), lambda m: _run_on(*[F.element_at(F.regexp_extract_all(m, F.lit("[0-9]+"), 0), i).cast("int") for i in (1, 2, 3)]))
    return F.when(~flat.rlike("随時|予算上限|上限に達するまで|通年|年度中"), F.array_max(found))


def fiscal_years(c: Column) -> Column:
    """Distinct Western years of `…年度` in the order they stand."""
    flat = western(c)
    return F.array_distinct(F.transform(F.regexp_extract_all(flat, F.lit("([0-9]{4})年度"), 1), lambda y: y.cast("int")))


def spoken(d: Column) -> Column:
    """2026年6月1日, empty for null."""
    return F.coalesce(F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.day(d).cast("string"), F.lit("日")), F.lit(""))


def period_text(start: Column, end: Column) -> Column:
    """Start and end as a phrase."""
    a, b = spoken(start), spoken(end)
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("から"), b, F.lit("まで"))).when(a != "", F.concat(a, F.lit("から"))).when(b != "", F.concat(b, F.lit("まで"))).otherwise(lexicon.UNKNOWN)
