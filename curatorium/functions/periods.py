"""Application periods found in the lines of a page: which lines state one, the best of them, its dates, and the status that follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import dates, lexicon, text

_DAY = r"20[0-9]{2}年\s*[0-9]{1,2}月\s*[0-9]{1,2}"


def cleaned_line(c: Column) -> Column:
    """A line without the marks of Markdown and bullets, digits in ASCII, white space collapsed."""
    out = text.ascii_digits(c)
    for mark, new in ((r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\((https?://[^)]+)\)", "$1 $2"), (r"^#{1,6}\s*", ""), (r"\*\*", ""), (r"^[-・●■◆◇※]\s*", "")):
        out = F.regexp_replace(out, mark, new)
    return text.collapsed(out)


def is_bad(c: Column) -> Column:
    """Whether a line is about whom a grant is for, or a period made up from today."""
    return cleaned_line(c).rlike(lexicon.NOT_PERIOD)


def _only_starts(line: Column) -> Column:
    return line.rlike(lexicon.START_ROW) & ~line.rlike(lexicon.ENDS_IN_ROW)


def is_good(c: Column) -> Column:
    """Whether a line states an application period: a date, a range or an end, and a word of applications."""
    signal = f"{lexicon.PERIOD_LABEL}|{lexicon.PERIOD_HINT}|{lexicon.PAGE_OPEN_ENDED}"
    return text.bound(cleaned_line(c), lambda x: (x != "") & ~x.rlike(lexicon.NOT_PERIOD) & ~_only_starts(x) & x.rlike(lexicon.DATE_LIKE) & x.rlike(lexicon.RANGE_LIKE) & x.rlike(signal))


def _states_date(line: Column) -> Column:
    return line.rlike(lexicon.DATE_LIKE) & ~line.rlike(lexicon.NOT_PERIOD) & ~_only_starts(line)


def _iso(m: Column) -> Column:
    return F.concat_ws("-", F.substring(m, 1, 4), F.lpad(F.regexp_extract(m, r"年\s*([0-9]{1,2})月", 1), 2, "0"), F.lpad(F.regexp_extract(m, r"月\s*([0-9]{1,2})", 1), 2, "0"))


def full_dates(c: Column) -> Column:
    """All full dates of a text as ISO texts, in order."""
    return F.transform(F.regexp_extract_all(dates.western(c), F.lit(_DAY), 0), _iso)


def deadline_score(row: Column) -> Column:
    """How surely a row of a schedule is the last day of application; 0 where it is none."""
    score = F.lit(0)
    for pattern, points in reversed(lexicon.DEADLINE_ROWS):
        score = F.when(row.rlike(pattern), points).otherwise(score)
    return F.when(row.rlike(lexicon.OTHER_ROWS) & ~row.rlike("提出期限|提出締切|応募期限|申請期限"), 0).otherwise(score)


def schedule(lines: Column) -> Column:
    """Rows (shown, iso, row) of lines that hold an era date: of a table row the date in its columns behind the first."""
    def read(line: Column) -> Column:
        flat = F.regexp_replace(F.replace(F.replace(cleaned_line(line), F.lit("｜"), F.lit("|")), F.lit("【必着】"), F.lit("")), "[ \t\u3000]+", " ")
        table = F.contains(flat, F.lit("|"))
        columns = F.filter(F.transform(F.split(flat, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
        dated = F.when(table & (F.size(columns) >= 2), F.array_join(F.slice(columns, 2, F.greatest(F.size(columns) - 1, F.lit(0))), " ")).otherwise(flat)
        shown = F.regexp_replace(F.regexp_extract(dated, lexicon.SHOWN_DATE, 0), "[ \t\u3000]+", "")
        return F.struct(shown.alias("shown"), F.try_element_at(full_dates(shown), F.lit(1)).alias("iso"), flat.alias("row"))

    return F.filter(F.transform(lines, read), lambda r: (r["shown"] != "") & r["iso"].isNotNull())


def scheduled(lines: Column) -> Column:
    """The period that a schedule's rows give: the first start and the surest end, of equally sure ones the latest; empty without an end."""
    def told(rows: Column) -> Column:
        starts = F.filter(rows, lambda r: r["row"].rlike(lexicon.START_ROW))
        ends = F.filter(F.transform(rows, lambda r: F.struct(deadline_score(r["row"]).alias("score"), r["iso"].alias("iso"), r["shown"].alias("shown"))), lambda r: r["score"] > 0)
        start = F.array_min(F.transform(starts, lambda r: F.struct(r["iso"].alias("iso"), r["shown"].alias("shown"))))["shown"]
        end = F.array_max(ends)["shown"]
        return F.coalesce(F.concat(start, F.lit(" ～ "), end), F.concat(end, F.lit("まで")), F.lit(""))

    return text.bound(schedule(lines), told)


def _labelled(lines: Column) -> Column:
    """The date value on the first line with a label of a period, or on one of the three lines behind it; null where no line has one."""
    def at(i: Column) -> Column:
        line = F.element_at(lines, i)
        same = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, f"^(.*?)(?:{lexicon.PERIOD_LABEL})", "$1"), f"^(.*?)(?:{lexicon.PERIOD_HINT})", "$1"), r"^[:：\s]+", ""))
        after = F.filter(F.slice(lines, i + 1, 3), _states_date)
        found = F.when((same != "") & _states_date(same), same).otherwise(F.try_element_at(after, F.lit(1)))
        return F.when(line.rlike(f"{lexicon.PERIOD_LABEL}|{lexicon.PERIOD_HINT}") & ~_only_starts(line), found)

    found = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), at), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.try_element_at(found, F.lit(1)))


def best(candidates: Column, lines: Column) -> Column:
    """The best period text of a page: that of its schedule; else, candidates first and then lines that state a period, the first block's schedule or labelled value; else the first good line; else empty."""
    lines = F.filter(F.transform(lines, cleaned_line), lambda x: F.length(x) > 1)

    def chosen(whole: Column) -> Column:
        every = F.filter(F.array_distinct(F.concat(F.coalesce(candidates, F.array().cast("array<string>")), F.filter(lines, is_good))), lambda x: (x != "") & ~is_bad(x))

        def block(x: Column) -> Column:
            own = F.filter(F.transform(F.split(x, "\n"), cleaned_line), lambda y: y != "")
            return text.bound(scheduled(own), lambda s: F.when((s != "") & ~is_bad(s), s).otherwise(_labelled(own)))

        found = F.filter(F.transform(every, block), lambda x: x.isNotNull())
        good = F.filter(F.transform(every, cleaned_line), is_good)
        return F.when((whole != "") & ~is_bad(whole), whole).otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), F.try_element_at(good, F.lit(1)), F.lit("")))

    return text.bound(scheduled(lines), chosen)


def ends(c: Column) -> Column:
    """struct(start, end, open_ended) of a period text, ISO texts: words that leave the end open give the first date; a range may leave out the second year; else the last date is the end."""
    def read(flat: Column) -> Column:
        shape = rf"(20[0-9]{{2}})年\s*([0-9]{{1,2}})月\s*([0-9]{{1,2}})日?(?:（[^）]+）)?\s*(?:～|〜|-|から|より)\s*(?:(20[0-9]{{2}})年\s*)?([0-9]{{1,2}})月\s*([0-9]{{1,2}})日?"
        part = lambda i: F.regexp_extract(flat, shape, i)
        day = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        found, none = full_dates(flat), F.lit(None).cast("string")
        open_ended, ranged, bad = flat.rlike(lexicon.PAGE_OPEN_ENDED), flat.rlike(shape), (flat == "") | is_bad(flat)
        first, last = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(-1))
        start = F.when(bad, none).when(open_ended, first).when(ranged, day(part(1), part(2), part(3)))
        end = F.when(bad | open_ended, none).when(ranged, day(text.first_present(part(4), part(1)), part(5), part(6))).otherwise(last)
        return F.struct(start.alias("start"), end.alias("end"), (~bad & open_ended).alias("open_ended"))

    return text.bound(dates.western(c), read)


def status(period: Column, start: Column, end: Column, stated: Column, today: Column) -> Column:
    """The status that a period text and its dates (ISO texts) give; where they decide nothing, the stated one, else unknown. today: an ISO text."""
    period, stated = F.coalesce(period, F.lit("")), F.coalesce(stated, F.lit(""))
    known = F.when(stated.isin(list(lexicon.STATED_STATUS)), stated).otherwise(F.lit(lexicon.UNKNOWN))
    return (
        F.when(F.concat_ws("\n", period, stated).rlike(lexicon.CLOSED), lexicon.CLOSED_STATUS)
        .when((period == "") | is_bad(period), known)
        .when(today < start, lexicon.ANNOUNCED)
        .when(end < today, lexicon.CLOSED_STATUS)
        .when(period.rlike(lexicon.PAGE_OPEN_ENDED), lexicon.OPEN)
        .otherwise(known)
    )
