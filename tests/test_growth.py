"""Costly expressions are computed by many tasks, and once, however the tables' files are cut."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from curatorium.functions import expenses, lexicon, text
from curatorium.operators import dedupe, facts, pages, review
from curatorium.plans import articles, content, golden, web


@pytest.mark.parametrize("rows", [lambda *a: golden._dealt(*a, golden.EXPENSES), web._made_links, content.page_focus, articles._articles], ids=["expense_items", "link_reasons, page_types", "page_focus", "article_claims, article_reviews"])
def test_one_group_of_rows_is_dealt_over_tasks(spark, data, rows):
    """The tables of sf0.01 are files of one group of rows, which one task reads."""
    assert rows(spark, data).select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_expressions_are_bound_and_not_written_out(spark):
    """What an expression uses often stands in it once."""
    c = F.col("t")
    assert str(expenses.is_bad(c)).count("<(script") == 1
    assert str(pages.is_index(c, c, c, F.lit(1), F.lit(1))).count("#.*$") == 1
    assert str(pages.page_score(c, c, c, F.lit(1), c)).count("5000") == 1
    assert str(facts.program_kind(F.lit(""), F.lit(""), c)).count("concat_ws") == 1


def test_claims_need_no_tests_of_rules(spark, data):
    assert "_seen" not in review.claimed(articles._articles(spark, data)).columns


def test_expressions_that_skip_ascii_find_the_same(spark):
    told = ["", "abc", "ab補助x", "é補助", "上限", "a上b限", "補\n助", "𠮷補助"]
    rows = spark.createDataFrame([(t,) for t in told], "t string")
    for pattern in ("補助|上限", "上限|補助金", "補助|abc", "補?助|x", "[補上]限"):
        assert all(r[0] == r[1] for r in rows.select(F.col("t").rlike(pattern), F.col("t").rlike(text.skipping(pattern))).collect())
    assert text.skipping("補助|上限") != "補助|上限" and text.skipping("補助|abc") == "補助|abc" and text.skipping("補?助|x") == "補?助|x"


_ON_BRIEF = (
    "year", "amount", "money", "official", "checked", "deadline_detail", "round", "implementer", "study", "study_detail", "equipment", "definite", "risky", "local", "contract", "target", "expense", "excluded", "action", "project", "conditions", "start", "single", "method",
    "industry_claim", "expense_claim", "excluded_claim", "fiction", "number_claim",
)


def test_condensed_texts_have_the_same_matches(spark):
    """Stretches without digits and Japanese are cut to their ends, and every expression that is tried on such a text finds there what it finds in the whole."""
    draw = random.Random(3)
    signs = ["補助率", "上限額", "契約", "申請前", "必ず", "対象", "です", "導入効果", "円", "3分の1", "20%", "2026年", "2026-03", "5 / 7", "株式会社A社", "FS調査", "令和8年度", "中古品"]
    idle = lambda n: "".join(draw.choices("abcdefgh ,.éß𠮷"[:14] + "😀", k=n))
    told = ["".join(draw.choice(signs) + idle(draw.choice((0, 1, 3, 11, 12, 13, 23, 24, 25, 39, 40, 41, 59, 60, 61, 62, 89, 90, 91, 120, 179, 181, 400))) for _ in range(draw.randrange(1, 9))) for _ in range(600)]
    told += ["", "a" * 90, "a" * 91, "a" * 5000, "ab ." * 750 + "円", "円" + "ab ." * 750, "FS" + idle(500) + "FS調査"]
    rows = spark.createDataFrame([(t,) for t in told], "t string")
    found = lambda c: [F.regexp_extract_all(c, F.lit(f"({lexicon.ARTICLE[n]})"), 1).alias(n) for n in _ON_BRIEF]
    whole, brief = (rows.select(*found(c)).collect() for c in (F.col("t"), text.condensed(F.col("t"))))
    assert whole == brief and all(any(r[n] for r in whole) for n in ("definite", "contract", "fiction", "number_claim", "risky"))
    short = [r[0] for r in rows.select(text.condensed(F.col("t"))).collect()]
    assert max(len(x) for s in short for x in re.findall(r"[^0-9%/<>\u2e80-\U0010ffff-]+", s)) <= 180 and sum(map(len, short)) < sum(map(len, told))


def test_program_kinds_need_a_sign_that_condensed_texts_keep():
    assert all(re.search("[⺀-￿]", part) for _, pattern in lexicon.PROGRAM_KIND_WORDS for part in pattern.split("|"))


def test_pieces_of_an_article_take_one_pass(spark):
    """The pieces that substrings would give, without counting each off from the beginning."""
    told = ["", "a" * 13, "a" * 14, "".join(chr(97 + i * i % 26) for i in range(101)), "".join(chr(97 + i * i % 23) for i in range(100)), "𠮷補助𠮷" * 9, "x" * 20000]
    rows = spark.createDataFrame([(t,) for t in told], "t string")
    cut = F.expr("IF(length(t) >= 14, array_sort(array_distinct(transform(sequence(1, length(substring(t, 1, 12000)) - 13, 2), i -> xxhash64(substring(t, i, 14))))), array())")
    assert all(r[0] == r[1] for r in rows.select(dedupe.article_shingles(F.col("t")), cut).collect())
    assert "substring(t, lambda" not in str(dedupe.article_shingles(F.col("t"))) and "sequence" not in str(dedupe.article_shingles(F.col("t")))


def _similar(spark, texts: dict[int, str]) -> dict[int, tuple[int, float]]:
    rows = spark.createDataFrame(list(texts.items()), "id long, content string")
    return {r["id"]: (r["other_id"], r["score"]) for r in dedupe.most_similar(rows).collect()}


def _letters(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def test_an_article_is_compared_to_its_end(spark):
    """Articles that share only what stands behind their first 12,000 characters."""
    tail = _letters(0, 3000)
    got = _similar(spark, {1: _letters(1, 14000) + tail, 2: _letters(2, 14000) + tail, 3: _letters(3, 14000)})
    n, common = (17000 - 14) // 2 + 1, (3000 - 14) // 2 + 1
    assert got == {1: (2, common / (2 * n - common)), 2: (1, common / (2 * n - common))}


@pytest.mark.parametrize(("block", "cells"), [(1 << 23, 1 << 22), (40, 16)], ids=["one block", "many blocks"])
def test_most_similar_articles_in_blocks_are_those_of_all_pairs(spark, monkeypatch, block, cells):
    """A common line, near and exact copies, and articles that share nothing, with blocks of any size."""
    monkeypatch.setattr(dedupe, "BLOCK", block)
    monkeypatch.setattr(dedupe, "CELLS", cells)
    line = _letters(0, 60)
    texts = {k: (line if k % 3 else "") + _letters(k, 1400 + 2 * (k % 5)) for k in range(1, 41)}
    texts |= {50 + k: texts[k][: 200 * k] + _letters(50 + k, 1600 - 200 * k) for k in range(1, 7)} | {60: texts[9], 61: texts[9], 62: texts[10] * 2, 63: texts[10] * 3, 64: ""}
    sets = {k: {t[i : i + 14] for i in range(0, len(t) - 13, 2)} for k, t in texts.items() if len(t) >= 1200}
    want = {}
    for k, s in sets.items():
        scores = [(-len(s & t) / len(s | t), j) for j, t in sets.items() if j != k and s & t]
        if scores:
            want[k] = (min(scores)[1], -min(scores)[0])
    assert _similar(spark, texts) == want
