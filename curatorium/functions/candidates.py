"""Candidates for a record's fields in the lines of a page, the choice among them, and how far the chosen ones are to be trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text
from curatorium.functions.periods import cleaned_line

MOST = 8  # items kept of a record
KINDS = {"expense": (lexicon.EXPENSE_LABEL, lexicon.EXPENSE_WORDS, 4, 120), "entity": (lexicon.ENTITY_LABEL, lexicon.ENTITY_WORDS, 3, 180)}


def value(c: Column) -> Column:
    """A line without a heading in brackets and a leading label."""
    out = F.regexp_replace(cleaned_line(c), r"^【[^】]+】\s*", "")
    return F.trim(F.regexp_replace(out, f"^(?:{'|'.join(lexicon.VALUE_LABELS)})[:：]\\s*", ""))


def around(lines: Column, label: str, before: int = 1, after: int = 3, most: int = 12) -> Column:
    """Blocks of the lines around each line with a label, each once."""
    def block(i: Column) -> Column:
        low = F.greatest(i - before, F.lit(1))
        return F.when(F.element_at(lines, i).rlike(label), F.array_join(F.slice(lines, low, i + after - low + 1), "\n"))

    blocks = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), block), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.slice(F.array_distinct(blocks), 1, most)).otherwise(F.array().cast("array<string>"))


def is_item(c: Column, kind: str) -> Column:
    """Whether a line may be an item of the kind: neither short nor long, no noise, no rate, amount or period, and a word of the kind."""
    _, words, least, longest = KINDS[kind]
    return text.bound(value(c), lambda x: (F.length(x) >= least) & (F.length(x) <= longest) & ~x.rlike(lexicon.FIELD_NOISE) & ~x.rlike(lexicon.NOT_ITEM) & x.rlike(words))


def items(blocks: Column, kind: str) -> Column:
    """Items of the blocks: what stands behind a label and on the four lines after it, and any other line that may be one."""
    label = KINDS[kind][0]

    def of_block(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), cleaned_line), lambda x: x != "")

        def at(line: Column, i: Column) -> Column:
            same = value(F.regexp_replace(line, f"^(.*?)(?:{label})", "$1"))
            after = F.filter(F.transform(F.slice(lines, i + 2, 4), value), lambda x: ~x.rlike(label))
            found = F.when(line.rlike(label), F.concat(F.array(same), after)).otherwise(F.array(value(line)))
            return F.when(line.rlike(lexicon.FIELD_NOISE), F.array().cast("array<string>")).otherwise(F.filter(found, lambda x: is_item(x, kind)))

        return F.flatten(F.transform(lines, at))

    return F.slice(F.array_distinct(F.flatten(F.transform(blocks, of_block))), 1, MOST)


def chosen(stated: Column, lines: Column, kind: str) -> Column:
    """The stated items that may be ones, then those of the blocks around labels, then lines that may be ones; each once, at most MOST."""
    fit = lambda x: is_item(x, kind)
    own = F.filter(F.transform(F.coalesce(stated, F.array().cast("array<string>")), value), fit)
    direct = F.slice(F.filter(F.transform(lines, value), fit), 1, MOST)
    return F.slice(F.array_distinct(F.concat(own, items(around(lines, KINDS[kind][0], 1, 5), kind), direct)), 1, MOST)


def addresses(c: Column, resolved: Column, most: int = 10) -> Column:
    """The page's address and those in its text, the likeliest official ones first, equally likely ones as they stand."""
    found = F.array_distinct(F.concat(F.array(F.coalesce(resolved, F.lit(""))), F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("https?://[^\\s\"'<>）)]+"), 0)))
    found = F.filter(found, lambda u: u.rlike("(?i)^https?://"))

    def scored(u: Column, i: Column) -> Column:
        points = F.lit(0)
        for pattern, worth in lexicon.URL_POINTS:
            points = points + F.when(u.rlike(pattern), worth).otherwise(0)
        return F.struct((-points).alias("order"), i.alias("i"), u.alias("url"))

    return F.slice(F.transform(F.array_sort(F.transform(found, scored)), lambda x: x["url"]), 1, most)


def is_benefit(*parts: Column) -> Column:
    """Whether the parts speak of a benefit paid to persons, which has neither a rate nor expenses."""
    return F.concat_ws(" ", *parts).rlike(lexicon.BENEFIT)


def _some(c: Column, words: str, least: int) -> Column:
    return F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.rlike(words) & (F.length(x) >= least))


def _has(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def confidence(f: dict[str, Column], evidence: dict[str, Column]) -> Column:
    """struct of a number from 0 to 100 for each field of f; five more where there is evidence for it. f: title, organization, region_text, application_period_text, application_status, amount_text, amount_max_yen, subsidy_rate_text, target_entities, target_expenses, official_url, summary."""
    entities, costs = (F.coalesce(F.size(f[k]), F.lit(0)) > 0 for k in ("target_entities", "target_expenses"))
    benefit = is_benefit(f["title"], f["summary"], f["amount_text"], f["subsidy_rate_text"], F.array_join(f["target_entities"], " "), F.array_join(f["target_expenses"], " "))
    dated = _has(f["application_status"]) & (f["application_status"] != lexicon.UNKNOWN)
    points = {
        "title": F.when(_has(f["title"]), 90).otherwise(40),
        "organization": F.when(_has(f["organization"]), 85).otherwise(45),
        "region_text": F.when(_has(f["region_text"]), 85).otherwise(45),
        "application_period_text": F.when(~_has(f["application_period_text"]), 35).when(dated, 93).otherwise(88),
        "amount_text": F.when(~_has(f["amount_text"]), 40).when(f["amount_max_yen"] > 0, 90).otherwise(85),
        "subsidy_rate_text": F.when(_has(f["subsidy_rate_text"]), F.when(f["subsidy_rate_text"].rlike("[0-9]+\\s*/\\s*[0-9]+|[0-9]+分の[0-9]+|[0-9]+[％%]|以内"), 87).otherwise(82)).when(benefit, 90).otherwise(40),
        "target_entities": F.when(_some(f["target_entities"], lexicon.ENTITY_WORDS, 3), 83).when(entities, 70).otherwise(35),
        "target_expenses": F.when(costs & ~_some(f["target_expenses"], lexicon.EXPENSE_WORDS, 4), 70).when(costs, 76).when(benefit, 90).otherwise(35),
        "official_url": F.when(_has(f["official_url"]), 90).otherwise(40),
    }
    more = {k: F.when(_has(evidence[k]), 5).otherwise(0) if k in evidence else F.lit(0) for k in points}
    return F.struct(*[F.least(F.lit(100), p + more[k]).alias(k) for k, p in points.items()])


def warnings(f: dict[str, Column]) -> Column:
    """What an editor should look up, as sentences. f: the fields of confidence and application_end_date."""
    benefit = is_benefit(f["title"], f["summary"], f["amount_text"], f["subsidy_rate_text"], F.array_join(f["target_entities"], " "), F.array_join(f["target_expenses"], " "))
    period, some = _has(f["application_period_text"]), F.coalesce(F.size(f["target_expenses"]), F.lit(0)) > 0
    rules = (
        (~period, "申請期間が取得できていません。公式ページで確認してください。"),
        (period & ~_has(f["application_end_date"]) & ~f["application_period_text"].rlike(lexicon.PAGE_OPEN_ENDED), "終了日が明記されていない可能性があります。"),
        (~_has(f["amount_text"]), "補助上限額・助成額・給付額が取得できていません。"),
        (~_has(f["subsidy_rate_text"]) & ~benefit, "補助率が取得できていません。"),
        (F.coalesce(F.size(f["target_entities"]), F.lit(0)) <= 0, "対象事業者・対象者の取得精度が低い可能性があります。"),
        (~some & ~benefit, "対象経費の取得精度が低い可能性があります。"),
        (some & ~_some(f["target_expenses"], lexicon.EXPENSE_WORDS, 4), "対象経費の根拠文が短いため、念のため公式ページで確認してください。"),
        (~_has(f["official_url"]), "公式URLが取得できていません。"),
    )
    return F.array_compact(F.array(*[F.when(test, said) for test, said in rules]))
