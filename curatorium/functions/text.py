"""Text normalisers as Column functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatorium.functions import lexicon

WHITE = "[\\s\u00a0\u3000]"
FULL_DIGITS = "０１２３４５６７８９"


def bound(c: Column, f) -> Column:
    """f of c, with c evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def tight(c: Column) -> Column:
    """Without white space, the ideographic space included; null counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"{WHITE}+", "")


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WHITE}+", " "))


def ascii_digits(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), FULL_DIGITS, "0123456789")


def ascii_numbers(c: Column) -> Column:
    """Full-width digits, comma and per-cent sign as ASCII."""
    return F.translate(F.coalesce(c, F.lit("")), FULL_DIGITS + "，％", "0123456789,%")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, for which Spark SQL has no function."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def without_html(c: Column, lines: bool = False) -> Column:
    """Text of an HTML fragment: scripts and styles dropped, ends of blocks as breaks, six entities decoded. lines: keep the breaks."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b.*?</(?:script|style)>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|li|div|tr)>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    out = entities(out)
    if lines:
        out = F.regexp_replace(F.regexp_replace(out, "[ \\t\u00a0\u3000]+", " "), r" *\n[ \n]*", "\n")
        return F.regexp_replace(out, r"^[ \n]+|[ \n]+\z", "")
    return collapsed(out)


def entities(c: Column) -> Column:
    """The named entities of plain text, & last but before what it may reveal stays as it is."""
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def escaped_xml(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def truncated(c: Column, most: int) -> Column:
    """At most so many characters, the last of a cut text an ellipsis."""
    flat = collapsed(c)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def is_missing(c: Column, profile: str = "quality") -> Column:
    """Empty, or one of the profile's words: contained in the text, or equal to it for the profiles exact and title."""
    words, flat = lexicon.MISSING[profile], collapsed(c)
    if profile in ("exact", "title"):
        return (flat == "") | flat.isin(list(words))
    return (flat == "") | flat.rlike("|".join(words))


def first_present(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cs])


def listed(c: Column, signs: str = "、,\n/") -> Column:
    """Parts between any of the signs, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"[{signs}]"), lambda x: F.trim(x)), lambda x: x != "")


def lines(c: Column) -> Column:
    """Trimmed lines of a text, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def matches(c: Column, patterns) -> Column:
    """How many of the patterns occur."""
    out = F.lit(0)
    for p in patterns:
        out = out + c.rlike(p).cast("int")
    return out


def skipping(pattern: str) -> str:
    """The same expression, for rlike: where each of its alternatives begins with a sign outside ASCII, ASCII is passed over without trying them one by one."""
    if re.search(r"[()\[\]\\^$.]", pattern):
        return pattern  # only plain alternatives
    plain = all(x and ord(x[0]) > 127 and x[1:2] not in ("?", "*", "{") for x in pattern.split("|"))
    return f"(?=[^\\x00-\\x7F])(?:{pattern})" if plain else pattern


#: No digit, none of %/<>- and nothing from the CJK radicals on, signs of two surrogates included: what an idle stretch of a text consists of.
_IDLE = r"[^0-9%/<>\-\u2E80-\uFFFF\x{10000}-\x{10FFFF}]"


def condensed(c: Column) -> Column:
    """A text for expressions each of whose matches holds a sign that is not idle (see _IDLE) and spans fewer than 90 idle ones on end: the same matches, in a text whose longer idle stretches are their first and last 90 signs."""
    return F.regexp_replace(c, rf"(?<!{_IDLE})({_IDLE}{{90}}){_IDLE}++(?<=({_IDLE}{{90}}))", "$1$2")


def any_contained(c: Column, words) -> Column:
    """Whether the text holds any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def searchable(*cs: Column) -> Column:
    """One lower-cased haystack; nulls are left out."""
    return F.lower(F.concat_ws(" ", *cs))
