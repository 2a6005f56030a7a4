"""Regions: the portal's municipalities and the gate for records of other places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text


def first_contained(c: Column, names) -> Column:
    """The first of the names, in their order, that the text holds; empty where it holds none."""
    held = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.coalesce(c, F.lit("")), n))
    return F.coalesce(F.try_element_at(held, F.lit(1)), F.lit(""))


def categories(c: Column, names=lexicon.MUNICIPALITIES, elsewhere: str = lexicon.REGION_ELSEWHERE) -> Column:
    """All names the text holds, or the one category of records without any."""
    held = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.coalesce(c, F.lit("")), n))
    return F.when(F.size(held) > 0, held).otherwise(F.array(F.lit(elsewhere)))


def names_other_municipality(c: Column) -> Column:
    """Whether the text names a city, town or village outside the list."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{2,12}(?:市|町|村)"), 0)
    return F.exists(found, lambda n: ~n.isin(list(lexicon.NOT_MUNICIPALITIES + lexicon.MUNICIPALITIES)) & (F.length(n) >= 3))


def gate(region: Column, title: Column, organisation: Column, keyword: Column) -> Column:
    """struct(keep, reason): records of the region, of searches for it, and of the whole country unless they name another place."""
    everything = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (region, title, organisation)])
    here = everything.rlike("愛媛|四国")
    searched = F.contains(F.coalesce(keyword, F.lit("")), F.lit("愛媛")) | text.any_contained(F.coalesce(keyword, F.lit("")), lexicon.MUNICIPALITIES)
    nation = F.coalesce(region, F.lit("")).rlike("全国|地域での制限はありません")
    reason = (
        F.when(here, "愛媛・四国対象")
        .when(searched, "愛媛キーワード由来のためdraft採用")
        .when(nation & text.any_contained(everything, lexicon.OTHER_PREFECTURES), "全国表記ありだが他県名を含む")
        .when(nation & names_other_municipality(everything), "全国表記ありだが他市町村名を含む")
        .when(nation, "全国対象")
        .otherwise("愛媛・四国・全国対象ではない")
    )
    return F.struct(reason.isin("愛媛・四国対象", "愛媛キーワード由来のためdraft採用", "全国対象").alias("keep"), reason.alias("reason"))
