"""The part of a page's text that is about a programme, as expressions over the array of its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text

MAX_CHARS, LEAST_CHARS = 12000, 300
SHORT_KEY = 20  # a line whose key is no longer is kept once
LEAST_SCORE, LINES_BEFORE = 6, 3
_MENU = r"^[\p{IsHiragana}\p{IsKatakana}\p{IsHan}a-zA-Z0-9\s]+\z"


def compacted(c: Column) -> Column:
    """Line ends as \\n, runs of blanks as one, at most one empty line, none at the ends."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, f"^{text.WHITE}+|{text.WHITE}+\\z", "")


def key(c: Column) -> Column:
    """A line's key: without white space, brackets and stops, lower-cased. c is in compatibility form."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"{text.WHITE}+", ""), r"[「」『』【】\[\]（）()・｜|:：,，.。]", ""))


def is_noise(line: Column) -> Column:
    """Lines that are dropped wherever they stand: empty, a single character, of a page's frame, or a word of a menu."""
    return (F.length(line) <= 1) | line.rlike(lexicon.PAGE_NOISE) | ((F.length(line) <= 8) & line.rlike(_MENU) & line.isin(list(lexicon.MENU_WORDS)))


def line_score(line: Column, line_key: Column, title_key: Column, parts: Column) -> Column:
    """How much a line tells about the programme of a title, from the keys of both and the parts of the title's key."""
    points = lambda hit, n: F.when(hit, n).otherwise(0)
    whole = points((F.length(title_key) >= 8) & F.contains(line_key, title_key), 20) + points((F.length(title_key) >= 8) & (F.length(line_key) >= 8) & F.contains(title_key, line_key), 10)
    out = whole + 4 * F.size(F.filter(parts, lambda p: F.contains(line_key, p)))
    for word in lexicon.IMPORTANT_WORDS:
        out = out + points(F.contains(line, F.lit(word)), 2)
    return out + points(line.rlike(r"^#+\s*"), 2) + points(line.rlike(lexicon.SECTION_WORDS), 3)


def title_parts(title_key: Column) -> Column:
    return F.filter(F.split(title_key, lexicon.TITLE_PARTS), lambda p: F.length(p) >= 4)


def _until_footer(lines: Column) -> Column:
    """Lines (struct with a field line) before the first of a footer."""
    at = F.array_position(F.transform(lines, lambda x: x["line"].rlike(lexicon.PAGE_FOOTER)), True)
    return F.when(at > 0, F.slice(lines, 1, (at - 1).cast("int"))).otherwise(lines)


def _from(lines: Column, start: Column) -> Column:
    return F.slice(lines, start.cast("int") + 1, F.size(lines) + 1)


def _once(lines: Column) -> Column:
    """Lines with a key, each short key at its first place only. Sorted by key and place, an equal key stands right before its repeat."""
    found = F.array_sort(F.filter(F.transform(lines, lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"))), lambda x: x["key"] != ""))

    def first(fresh: Column) -> Column:
        new = lambda x, i: (F.length(x["key"]) > SHORT_KEY) | (i == 0) | (F.get(fresh, i - 1)["key"] != x["key"])
        return F.array_sort(F.transform(F.filter(fresh, new), lambda x: x["at"]))

    return F.transform(text.bound(found, first), lambda at: F.get(lines, at)["line"])


def focused(raw: Column, title: Column) -> Column:
    """The lines of a page's text that are about the programme of a title, at most MAX_CHARS characters.

    Frame and menu lines are dropped; the text begins LINES_BEFORE lines before the line with the best score, or at the first line with an
    important word, and ends before the first line of a footer; short lines are kept once. Where that leaves fewer than LEAST_CHARS characters of a longer text,
    the text's beginning is returned as it is. A null text gives an empty one.
    """
    white = compacted(raw)
    bare = F.regexp_replace(F.regexp_replace(white, r"!\[.*?\]\(.*?\)", ""), r"\[([^\]]+)\]\((https?://[^)]+)\)", "$1 $2")
    forms = F.struct(bare.alias("bare"), text.nfkc(bare).alias("plain"), white.alias("white"), key(text.nfkc(F.coalesce(title, F.lit("")))).alias("title"))

    def pick(b: Column) -> Column:
        trim = lambda x: F.regexp_replace(x, f"^{text.WHITE}+|{text.WHITE}+\\z", "")
        # Composition changes no line end, so both forms have the same lines.
        both = F.zip_with(F.split(b["bare"], "\n"), F.split(b["plain"], "\n"), lambda x, y: F.struct(trim(x).alias("line"), key(y).alias("key")))
        return text.bound(F.filter(both, lambda x: ~is_noise(x["line"])), lambda rows: F.when(F.size(rows) == 0, b["white"]).otherwise(_cut(rows, b["white"], b["title"])))

    return text.bound(forms, pick)


def _cut(rows: Column, white: Column, title_key: Column) -> Column:
    def begin(lines: Column) -> Column:
        best = text.bound(title_parts(title_key), lambda parts: F.array_max(F.transform(lines, lambda x, i: F.struct(line_score(x["line"], x["key"], title_key, parts).alias("score"), (-i).alias("at")))))
        worded = F.array_position(F.transform(lines, lambda x: text.any_contained(x["line"], lexicon.IMPORTANT_WORDS)), True) - 1
        start = text.bound(best, lambda b: F.when(b["score"] >= LEAST_SCORE, F.greatest(F.lit(0), -b["at"] - LINES_BEFORE)).otherwise(F.greatest(F.lit(0), worded)))
        return F.when(F.size(lines) > 0, _from(lines, F.coalesce(start, F.lit(0)))).otherwise(lines)

    body = text.bound(_until_footer(rows), begin)
    kept = text.bound(body, lambda b: compacted(F.array_join(_once(b), "\n")))
    short = lambda k: (F.length(k) < LEAST_CHARS) & (F.length(white) > F.length(k))
    return text.bound(kept, lambda k: F.substring(F.when(short(F.substring(k, 1, MAX_CHARS)), white).otherwise(k), 1, MAX_CHARS))
