"""Search and serving: keywords, facets, orders, pages, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyword_filter(df: DataFrame, keyword: str, *fields: Column) -> DataFrame:
    """Rows of which some field holds the keyword in any case; an empty keyword keeps all."""
    if not keyword:
        return df
    hit = F.lit(False)
    for c in fields:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(keyword.lower()))
    return df.where(hit)


def facet_counts(df: DataFrame, facet: Column, domain: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """(value, n): rows of each value of a multi-valued facet, each row once a value, under the other facets' filter. domain: the values to list, absent ones with 0."""
    rows = df if where is None else df.where(where)
    counts = rows.select(F.explode(F.array_distinct(facet)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    if domain is None:
        return counts
    listed = df.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    return listed.join(counts, "value", "left").fillna(0, "n")


def missing_last(c: Column, descending: bool) -> list[Column]:
    """Sort keys: rows without a positive value last, either way."""
    return [F.when(c > 0, 0).otherwise(1), c.desc() if descending else c.asc()]


def newness(times: list[Column], number: Column) -> Column:
    """Milliseconds of the first of the times (texts) that can be read, else the number."""
    read = [F.try_to_timestamp(F.nullif(c, F.lit(""))) for c in times]
    return F.coalesce(*[F.unix_millis(c) for c in read], number.cast("bigint"), F.lit(0).cast("bigint"))


def of_mode(df: DataFrame, mode: str, closed: Column) -> DataFrame:
    """Rows that are open, closed, or all."""
    return df if mode == "all" else df.where(~closed if mode == "open" else closed)


def in_japanese(c: Column) -> Column:
    """A text to sort by as Japanese readers expect: digits, letters whatever their case, kana by sound, then kanji. Null counts as empty."""
    return F.collate(F.coalesce(c, F.lit("")), "ja")


ADMIN_SORTS = ("published_at_desc", "amount_desc", "deadline_asc", "region_title_asc", "fetched_at_desc")


def admin_order(sort: str, published: Column, amount: Column, deadline: Column, region: Column, title: Column, fetched: Column, number: Column) -> list[Column]:
    """Sort keys of the editors' list: the last published, the largest amount (none counts as 0), the next deadline (none last), place and title in Japanese order, or the last fetched; ties by number, so the order is total. Times are milliseconds, none counts as 0."""
    whole = lambda c: F.coalesce(c, F.lit(0)).desc()
    by = {
        "published_at_desc": [whole(published)], "amount_desc": [whole(amount)], "deadline_asc": [deadline.asc_nulls_last()],
        "region_title_asc": [in_japanese(F.coalesce(F.when(region != "", region), F.lit("不明"))).asc(), in_japanese(title).asc()],
    }
    return by.get(sort, [whole(fetched)]) + [number.asc()]


def visible(df: DataFrame, noted: Column | None = None, passes: Column | None = None) -> DataFrame:
    """Rows of the editors' list under its filters: with a note of theirs, and with the quality asked for."""
    for test in (noted, passes):
        df = df if test is None else df.where(F.coalesce(test, F.lit(False)))
    return df


def list_order(mode: str, sort: str, closed: Column, newest: Column, deadline: Column, amount: Column, title: Column, number: Column) -> list[Column]:
    """Sort keys of the list: where all rows are shown, open ones first; deadlines run backwards in the list of closed ones; rows without an amount last; ties by number, so the order is total. A title goes by code point unless it comes as in_japanese gives it."""
    by = {
        "deadline": [deadline.desc() if mode == "closed" else deadline.asc()], "amount_desc": missing_last(amount, True), "amount_asc": missing_last(amount, False), "title": [F.coalesce(title, F.lit("")).asc()],
    }
    return ([closed.cast("int").asc()] if mode == "all" else []) + by.get(sort, [newest.desc()]) + [number.asc()]


def page_numbers(page: Column, pages: Column) -> Column:
    """The page numbers to offer: five around the page, fewer where there are fewer."""
    first, last = F.greatest(F.lit(1), page - 2), F.least(pages, page + 2)
    short = last - first < 4
    low = F.when(short & (first != 1) & (last == pages), F.greatest(F.lit(1), pages - 4)).otherwise(first)
    high = F.when(short & (first == 1), F.least(pages, F.lit(5))).otherwise(last)
    return F.when(high >= low, F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))).otherwise(F.array().cast("array<int>"))


def page_of(df: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """Rows of one page, in order. The order must be total. The engine keeps only the rows up to the page's end."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_bounds(total: Column, page: Column, size: int) -> dict[str, Column]:
    """total_pages, start_count and end_count of a page."""
    return {"total_pages": F.ceil(total / size), "start_count": F.when(total == 0, F.lit(0)).otherwise((page - 1) * size + 1), "end_count": F.least(page * size, total)}


def top_per(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in a total order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order; rows with an empty or null key are dropped."""
    for key in keys:
        df = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return top_per(df, keys, 1, *order).drop("rank")


def suggestions(items: DataFrame, features: DataFrame, key: str, purposes: Column, industries: Column, haystack: Column, k: int = 3, least: int = 3) -> DataFrame:
    """(key, slug, score, rank): landing pages that fit each item: 4 points a shared purpose, 5 a shared industry, 1 a keyword contained.

    features (slug, purpose_tags, industry_tags, keywords, priority) is the portal's list of landing pages, a few dozen rows
    written by hand, so it is paired with every item.
    """
    pairs = items.select(F.col(key), purposes.alias("_p"), industries.alias("_i"), haystack.alias("_h")).crossJoin(F.broadcast(features))
    shared = lambda a, b: F.size(F.filter(F.col(a), lambda t: F.array_contains(F.col(b), t)))
    score = 4 * shared("purpose_tags", "_p") + 5 * shared("industry_tags", "_i") + F.size(F.filter("keywords", lambda w: (w != "") & F.contains(F.col("_h"), w)))
    scored = pairs.select(key, "slug", "priority", score.alias("score")).where(F.col("score") >= least)
    return top_per(scored, [key], k, F.col("score").desc(), F.col("priority").desc(), F.col("slug")).select(key, "slug", "score", "rank")


def inferred_tags(items: DataFrame, rules: DataFrame, key: str, haystack: Column, k: int) -> DataFrame:
    """(key, tag, hits, rank): the k tags most of whose keywords an item holds. rules (tag, place, keywords) is a hand-written list."""
    pairs = items.select(F.col(key), haystack.alias("_h")).crossJoin(F.broadcast(rules))
    scored = pairs.select(key, "tag", "place", F.size(F.filter("keywords", lambda w: F.contains(F.col("_h"), w))).alias("hits")).where("hits > 0")
    return top_per(scored, [key], k, F.col("hits").desc(), F.col("place")).select(key, "tag", "hits", "rank")
