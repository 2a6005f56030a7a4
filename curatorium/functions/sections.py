"""Texts of details cut at their labels, as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text

MAX_SECTION, MAX_ITEM, LONG, LONG_LABELLED, LEAST_TITLE = 500, 160, 240, 120, 8
_URL = r"https?://[^\s]+"
_MARKS = "[■□◆◇●○◎※]"


def _ends(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def normal(c: Column) -> Column:
    """Text of a detail: markup as breaks or blanks, four entities decoded, blanks collapsed, at most one empty line."""
    out = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\r", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("　", " ")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return _ends(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def is_unknown(c: Column) -> Column:
    return F.lower(normal(c)).isin(list(lexicon.UNKNOWN_WORDS))


def first_known(*cs: Column) -> Column:
    """The first text that says something; empty where none does."""
    return F.coalesce(*[F.when(~is_unknown(c), normal(c)) for c in cs], F.lit(""))


def known_list(c: Column) -> Column:
    """Members of a list that say something, as one text."""
    return F.array_join(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), normal), lambda x: ~F.lower(x).isin(list(lexicon.UNKNOWN_WORDS))), " / ")


def without_urls(c: Column) -> Column:
    return _ends(F.regexp_replace(normal(c), _URL, ""))


def tidy(c: Column) -> Column:
    """One line of parts: without addresses and marks, bars and slashes between blanks."""
    out = F.regexp_replace(F.regexp_replace(without_urls(c), _MARKS, " "), "[|｜]{2,}", " | ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*\|\s*", " | "), r"\s*/\s*", " / ")
    return _ends(F.regexp_replace(out, r"\s{2,}", " "))


def _tidy_overview(c: Column) -> Column:
    return _ends(F.regexp_replace(F.regexp_replace(F.regexp_replace(without_urls(c), _MARKS, " "), r"\s{2,}", " "), r"\n{3,}", "\n\n"))


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[:：]", ""))


def is_label(c: Column) -> Column:
    return F.regexp_replace(normal(c), "[:：]", "").isin(list(lexicon.SECTION_LABELS))


def looks_raw(c: Column) -> Column:
    """Whether a text is a dump of a page rather than a value: long, or full of bars, slashes, addresses or labels."""

    def judge(t: Column) -> Column:
        count = lambda pattern: F.regexp_count(t, F.lit(pattern))
        labelled = text.any_contained(t, lexicon.SECTION_LABELS) & (F.length(t) > LONG_LABELLED)
        return (t != "") & ((F.length(t) > LONG) | (count("[|｜]") >= 4) | (count(r"\s/\s") >= 4) | (count("https?://") >= 1) | labelled)

    return text.bound(normal(c), judge)


def candidates(c: Column) -> Column:
    """Parts of a text that may be items: between bars, slashes and breaks, known, no labels, no addresses, and not long."""
    parts = F.transform(F.split(tidy(c), "[|｜/\n]"), normal)
    return F.filter(parts, lambda x: ~F.lower(x).isin(list(lexicon.UNKNOWN_WORDS)) & ~is_label(x) & ~x.rlike("^https?://") & (F.length(x) <= MAX_ITEM))


def without_title(items: Column, title: Column) -> Column:
    """Items other than the title or, from LEAST_TITLE characters on, parts of it and what holds it."""
    plain = lambda c: F.regexp_replace(normal(c), r"[【】「」『』（）()［\]\s]", "")
    part = lambda a, b: F.contains(a, b) & (F.length(b) >= LEAST_TITLE)
    return text.bound(plain(title), lambda t: F.filter(items, lambda x: (plain(x) != "") & ((t == "") | ~(part(t, plain(x)) | part(plain(x), t)))))


def _tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[|｜]"), normal), lambda x: x != "")


def by_labels(c: Column, labels: tuple[str, ...]) -> Column:
    """The section behind the first of the labels: the next cell of a table of bars, else what follows the label up to an empty line or a bar, MAX_SECTION characters at most; empty where no label has one."""

    def cells(ts: Column) -> Column:
        follows = lambda i: F.coalesce(F.get(ts, i + 1), F.lit(""))
        rows = F.transform(ts, lambda t, i: F.when(_bare(t).isin(list(labels)) & (follows(i) != "") & ~is_label(follows(i)), follows(i)))
        return F.get(F.filter(rows, lambda x: x.isNotNull()), F.lit(0))

    def prose(value: Column, label: str) -> Column:
        behind = F.regexp_extract(value, rf"(?is){re.escape(label)}\s*[:：]?\s*(.{{1,{MAX_SECTION}}})", 1)
        cut = _ends(F.regexp_extract(F.regexp_extract(behind, r"(?s)^(.*?)(?:\n{2,}|\z)", 1), r"(?s)^([^|｜]*)", 1))
        return F.when((cut != "") & ~is_label(cut), cut)

    return text.bound(tidy(c), lambda v: F.coalesce(text.bound(_tokens(v), cells), *[prose(v, label) for label in labels], F.lit("")))


def overview(c: Column, labels: tuple[str, ...]) -> Column:
    """The whole section behind the first of the labels that has one: all cells up to the next label, addresses left out, else the text up to the next label."""

    def cells(ts: Column) -> Column:
        def section(t: Column, i: Column) -> Column:
            rest = F.slice(ts, i + 2, F.size(ts))
            stop = F.array_position(F.transform(rest, lambda x: _bare(x).isin(list(lexicon.SECTION_LABELS))), True)
            own = F.when(stop > 0, F.slice(rest, 1, (stop - 1).cast("int"))).otherwise(rest)
            return F.when(_bare(t).isin(list(labels)), _tidy_overview(F.array_join(F.filter(own, lambda x: ~x.rlike("^https?://")), "\n")))

        return F.get(F.filter(F.transform(ts, section), lambda x: x.isNotNull() & (x != "")), F.lit(0))

    def prose(value: Column, label: str) -> Column:
        others = "|".join(re.escape(x) for x in lexicon.SECTION_LABELS if x != label)
        cut = _tidy_overview(F.regexp_extract(value, rf"(?is){re.escape(label)}\s*[:：]?\s*(.*?)(?=\n?\s*(?:{others})\s*[:：]?|\z)", 1))
        return F.when((cut != "") & ~is_label(cut), cut)

    return text.bound(normal(c), lambda v: F.coalesce(text.bound(_tokens(v), cells), *[prose(v, label) for label in labels], F.lit("")))
