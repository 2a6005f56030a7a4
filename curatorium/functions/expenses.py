"""Expenses and rates as stated in feeds: what counts as one, cleaned and split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import lexicon, money, text

MOST = 8  # items kept of a record


def is_bad(c: Column) -> Column:
    """Whether a piece of text is no expense: too short or long, markup, a rate, an amount, a period, or a bound without a known kind."""

    def judge(flat: Column) -> Column:
        bounded = flat.rlike("以内|以下|以上|未満") & ~text.any_contained(flat, lexicon.EXPENSES)
        return (F.length(flat) < 2) | (F.length(flat) > 60) | flat.rlike(lexicon.MARKUP) | flat.rlike(lexicon.NOT_EXPENSE) | bounded

    return text.bound(F.trim(text.ascii_numbers(text.without_html(c))), judge)


def cleaned(c: Column) -> Column:
    """A piece of a list without its bullet, number, conjunction, full stop and label; empty where it is no expense."""
    out = text.without_html(c)
    for sign in (r"^[・\-—◆◇■□●○◎※＊*]+", r"^[0-9]+[.)．、]", "^[①-⑳]", "^(?:及び|または|又は|並びに)", "[。．]+$"):
        out = F.regexp_replace(out, sign, "")
    out = F.trim(out)
    for label in lexicon.EXPENSE_LABELS:
        out = F.regexp_replace(out, f"^{label}[：:・]?", "")
    return text.bound(F.trim(out), lambda x: F.when(is_bad(x), F.lit("")).otherwise(x))


def known(c: Column) -> Column:
    """Kinds of expenses the text names, at most MOST, general ones only where no special one says the same."""

    def special(found: Column) -> Column:
        def keep(w: Column) -> Column:
            other = lambda part: F.exists(found, lambda x: F.contains(x, F.lit(part)) & (x != part))
            drop = ((w == "設備") & other("設備")) | ((w == "機器") & other("機器")) | ((w == "謝金") & F.array_contains(found, "専門家謝金")) | ((w == "広報費") & F.array_contains(found, "広告宣伝費"))
            return ~(drop | (w.isin("設備費", "機器費") & F.arrays_overlap(found, F.array(*map(F.lit, lexicon.MACHINES)))))

        return F.slice(F.filter(found, keep), 1, MOST)

    return text.bound(text.without_html(c), lambda flat: text.bound(F.filter(F.array(*map(F.lit, lexicon.EXPENSES)), lambda w: F.contains(flat, w)), special))


def items(c: Column) -> Column:
    """The items of a list of expenses, then the kinds it names, each once, at most MOST."""
    parts = F.split(text.without_html(c), r"[\n、，,／/]|及び|または|又は|並びに")
    direct = F.filter(F.transform(parts, cleaned), lambda x: x != "")
    return F.slice(F.array_distinct(F.concat(direct, known(c))), 1, MOST)


def is_safe_rate(c: Column) -> Column:
    """Whether a stated rate can be shown: short, no markup, no amount, no heading."""
    flat = F.trim(F.coalesce(c, F.lit("")))
    return (flat != "") & (F.length(flat) <= 40) & ~flat.rlike(lexicon.MARKUP) & ~flat.rlike("上限|限度額|補助額|助成額|円|(?:対象経費|補助対象|金額)$")


def stated_rate(c: Column) -> Column:
    """A stated rate without white space, empty where it cannot be shown."""
    return text.bound(text.tight(text.ascii_numbers(text.without_html(c))), lambda x: F.when(is_safe_rate(x), x).otherwise(F.lit("")))


def rate(stated: Column, prose: Column) -> Column:
    """The stated rate, else the one that prose gives."""
    return F.coalesce(text.first_present(stated_rate(stated), money.rate(prose)), F.lit(""))
