"""Amounts of yen and rates in text. Each variant is a function of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text

UNITS = (("億円", 100_000_000), ("億", 100_000_000), ("万円", 10_000), ("万", 10_000), ("千円", 1_000), ("円", 1))


def _times(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, factor in reversed(UNITS):
        out = F.when(unit == name, F.lit(float(factor))).otherwise(out)
    return out


def _number(c: Column) -> Column:
    return F.expr("null").cast("double") if c is None else F.when(c.rlike(r"^[0-9]+(?:\.[0-9]*)?\z|^\.[0-9]+\z"), c.cast("double"))


def int4(c: Column) -> Column:
    """A positive amount that fits a 32-bit integer, cut to a whole number; null otherwise."""
    return F.when((c > 0) & (c <= lexicon.INT4_MAX), F.floor(c).cast("int"))


def of_all_digits(c: Column) -> Column:
    """All digits of the text as one number, times the largest unit named in it; 0 where there is none."""
    flat = F.replace(text.ascii_numbers(text.without_html(c)), F.lit(","), F.lit(""))
    n = F.coalesce(_number(F.regexp_replace(flat, "[^0-9.]", "")), F.lit(0.0))
    factor = F.when(F.contains(flat, F.lit("億")), 1e8).when(F.contains(flat, F.lit("万")), 1e4).when(F.contains(flat, F.lit("千円")), 1e3).otherwise(1.0)
    return F.round(n * factor).cast("bigint")


def labelled(c: Column) -> Column:
    """The amount behind a label such as 上限, else one before a word such as 以内, else one near 補助額; 0 where there is none."""
    flat = F.regexp_replace(text.tight(text.ascii_numbers(text.without_html(c))), ",", "")
    unit = "(億円|億|万円|万|千円|円)"
    out = []
    for p in (rf"(?:補助上限額|助成上限額|上限額|限度額|補助限度額|助成限度額|上限|最大)[：:・]?([0-9.]+){unit}", rf"([0-9.]+){unit}(?:以内|以下|を上限|まで|限度)", rf"(?:補助額|助成額)[：:・]?[^0-9]{{0,12}}([0-9.]+){unit}"):
        value = _number(F.regexp_extract(flat, p, 1)) * _times(F.regexp_extract(flat, p, 2))
        out.append(F.when(value > 0, F.round(value)))
    return F.coalesce(*out, F.lit(0.0)).cast("bigint")


def first(c: Column) -> Column:
    """The first amount in 億円, 万円 or 円; 0 where there is none."""
    flat = F.regexp_replace(text.ascii_digits(c), ",", "")
    value = _number(F.regexp_extract(flat, r"([0-9.]+)\s*(億円|万円|円)", 1)) * _times(F.regexp_extract(flat, r"([0-9.]+)\s*(億円|万円|円)", 2))
    return F.when(text.is_missing(c, "exact"), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def largest(c: Column) -> Column:
    """The largest amount in 億円, 万円, 千円 or 円; 0 where there is none."""
    flat = F.regexp_replace(text.tight(text.ascii_digits(c)), ",", "")
    found = F.regexp_extract_all(flat, F.lit("[0-9]+(?:\\.[0-9]+)?(?:億円|万円|千円|円)"), 0)
    values = F.transform(found, lambda m: F.regexp_extract(m, r"^([0-9.]+)", 1).cast("double") * _times(F.regexp_extract(m, r"([^0-9.]+)$", 1)))
    return F.round(F.coalesce(F.array_max(values), F.lit(0.0))).cast("bigint")


def all_safe(c: Column) -> Column:
    """Every amount in n万m千円, 万円, 千円 and 円 that fits 32 bits, in this order of forms."""
    flat = F.coalesce(c, F.lit(""))
    n = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*"
    clean = lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double")
    both = F.zip_with(
        F.regexp_extract_all(flat, F.lit(rf"{n}万\s*([0-9][0-9,]*)\s*千\s*円?"), 1), F.regexp_extract_all(flat, F.lit(rf"{n}万\s*([0-9][0-9,]*)\s*千\s*円?"), 2), lambda a, b: clean(a) * 10_000 + clean(b) * 1_000
    )
    times = lambda factor: lambda x: clean(x) * factor
    one = [F.transform(F.regexp_extract_all(flat, F.lit(n + unit), 1), times(factor)) for unit, factor in (("万円", 10_000), ("千円", 1_000), ("円", 1))]
    return F.filter(F.transform(F.concat(both, *one), int4), lambda x: x.isNotNull())


def sanitised(value: Column, amount_text: Column) -> Column:
    """struct(amount, before, reason): vouchers and unit prices give no amount, and the text's largest amount overrides the stored one."""
    t = F.trim(F.coalesce(amount_text, F.lit("")))
    return text.bound(F.array_max(all_safe(t)), lambda found: _sanitised(value, t, found))


def _sanitised(value: Column, t: Column, found: Column) -> Column:
    before, voucher = int4(value.cast("double")), t.rlike(lexicon.VOUCHER)
    fixed = found.isNotNull() & ~found.eqNullSafe(before)
    reason = (
        F.when(voucher, "voucher_or_unit_amount")
        .when(fixed & before.isNull(), "parsed_from_amount_text")
        .when(fixed, "corrected_from_amount_text")
        .when(before.isNull() & value.isNotNull() & (value != 0), "invalid_amount_to_null")
        .otherwise("")
    )
    return F.struct(F.when(voucher, F.lit(None).cast("int")).when(fixed, found).otherwise(before).alias("amount"), before.alias("before"), reason.alias("reason"))


def display(yen: Column) -> Column:
    return F.when(yen > 0, F.concat(F.lit("上限 "), F.format_number(yen, 0), F.lit("円"))).otherwise(lexicon.UNKNOWN)


def rate(c: Column) -> Column:
    """The subsidy rate: behind its label, else 定額 or 全額 behind it, else the first fraction or percentage; empty where there is none."""
    flat = text.tight(text.ascii_numbers(text.without_html(c)))
    share = "((?:[0-9]+分の[0-9]+|[0-9]+/[0-9]+|[0-9]+%)(?:以内|以下)?)"
    label = "(?:補助率|助成率)[：:・]?"
    out = [F.regexp_extract(flat, p, 1) for p in (f"{label}(?:補助対象経費の)?{share}", f"{label}(定額)", f"{label}(全額)", share)]
    return F.coalesce(text.first_present(*out), F.lit(""))
