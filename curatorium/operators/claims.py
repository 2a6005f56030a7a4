"""What an article claims in numbers and dates, and whether the facts bear it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text
from curatorium.operators import facts, quality

CLAIMS = "array<struct<claim:string,status:string,source_ids:array<string>,reason:string>>"
STATUSES = ("supported", "unsupported", "contradictory", "unclear")
_MONTH = "20[0-9]{2}年[0-9]{1,2}月"
_A = lexicon.ARTICLE


def numeric(c: Column) -> Column:
    """Stretches of a text that give a rate, an amount, a year or a date of what a programme offers, each once."""
    return facts.unique(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_A["number_claim"]), 0))


def tight(c: Column) -> Column:
    return text.tight(text.without_html(c))


def _holds(c: Column, part: Column) -> Column:
    return (part != "") & F.contains(c, part)


def supported(claim: Column, flat: Column, f: Column, flat_evidence: Column) -> Column:
    """Whether the facts say what a claim says: its words, its rate, its cap (or an equal amount of yen), or its months. flat is the claim without white space, flat_evidence all facts as one text alike."""
    names = ("subsidy_rate", "subsidy_cap", "application_deadline")
    return text.bound(F.struct(*[tight(f[c]).alias(c) for c in names]), lambda told: _supported(claim, flat, f, flat_evidence, *(told[c] for c in names)))


def _supported(claim: Column, flat: Column, f: Column, flat_evidence: Column, rate: Column, cap: Column, end: Column) -> Column:
    months = F.regexp_extract_all(flat, F.lit(_MONTH), 0)
    in_months = lambda stated: _holds(flat, stated) | ((stated != "") & F.exists(months, lambda m: F.contains(stated, m)))
    cap_told = claim.rlike("上限額|補助上限|上限") & (cap != "") & (F.contains(flat, cap) | quality.same_amount(claim, f["subsidy_cap"]))
    end_told = claim.rlike("締切|申請締切|公募期間|受付期間") & (end != "") & (F.contains(flat, end) | F.contains(end, F.regexp_replace(flat, f".*?({_MONTH}).*", "$1")))
    return F.contains(flat_evidence, flat) | (claim.rlike("補助率") & _holds(flat, rate)) | cap_told | end_told | in_months(end) | (_holds(flat, rate) & _holds(flat, cap))


def _claim(claim: Column, status: str, reason: str, sourced: bool = False) -> Column:
    sources = F.array(F.lit("source-1")) if sourced else F.array().cast("array<string>")
    return F.struct(claim.alias("claim"), F.lit(status).alias("status"), sources.alias("source_ids"), F.lit(reason).alias("reason"))


def factual(title: Column, body: Column, f: Column, evidence: Column, brief: Column | None = None) -> Column:
    """Claims of an article (title, text without markup) with their status beside normalised facts and facts.evidence_text of them. brief: text.condensed of the text, where it is at hand."""
    brief = text.condensed(body) if brief is None else brief

    def judge(flat_evidence: Column) -> Column:
        def one(claim: Column) -> Column:
            return text.bound(tight(claim), lambda flat: F.when(supported(claim, flat, f, flat_evidence), _claim(claim, "supported", "", True)).otherwise(_claim(claim, "unsupported", "suppliedFacts に同じ金額・日付・補助率の根拠がありません。")))

        return F.transform(numeric(brief), one)

    unfunded = (title.rlike(_A["rate_title"]) & (f["subsidy_rate"] == "")) | (title.rlike(_A["cap_title"]) & (f["subsidy_cap"] == "")) | (title.rlike(_A["any_amount_title"]) & (f["subsidy_cap"] == "") & (f["calculation_method"] == ""))
    cap_in_text = F.contains(body, text.without_html(f["subsidy_cap"])) | quality.same_amount(body, f["subsidy_cap"])
    fiction = F.regexp_extract(brief, f"({_A['fiction']})", 1)
    more = [
        (title.rlike(_A["amount"]) & unfunded, _claim(F.lit("タイトルで補助率・上限額を約束しているが、公式ファクトに具体値がありません。"), "unsupported", "タイトル安全化が必要です。")),
        (
            (f["subsidy_cap"] != "") & brief.rlike(text.skipping(_A["amount"])) & brief.rlike(text.skipping(_A["money"])) & ~cap_in_text,
            _claim(F.lit("本文中の上限額らしき記述が、suppliedFacts の上限額と一致しない可能性があります。"), "contradictory", "公式ファクトの上限額と本文の金額を照合してください。", True),
        ),
        (brief.rlike(text.skipping(_A["industry_claim"])) & ~evidence.rlike(_A["industry_claim"]), _claim(F.lit("対象者・対象業種の根拠がない"), "unsupported", "suppliedFacts に本文の対象者・対象業種を裏付ける根拠がありません。")),
        (brief.rlike(text.skipping(_A["expense_claim"])) & ~evidence.rlike(_A["expense_claim"]), _claim(F.lit("対象経費の根拠がない"), "unsupported", "suppliedFacts に本文の対象経費を裏付ける根拠がありません。")),
        (brief.rlike(text.skipping(_A["excluded_claim"])) & ~evidence.rlike(_A["excluded_fact"]), _claim(F.lit("対象外経費の根拠がない"), "unsupported", "suppliedFacts に本文の対象外経費を裏付ける根拠がありません。")),
        ((fiction != "") & ~F.contains(evidence, fiction), _claim(F.concat(F.lit("架空・仮名の事例が含まれています: "), fiction), "unsupported", "suppliedFacts にない企業名、導入事例、試算金額は公開本文へ追加できません。")),
    ]
    return F.array_distinct(F.concat(text.bound(tight(evidence), judge), F.array_compact(F.array(*[F.when(hit, claim) for hit, claim in more]))))


def of_status(claims: Column, status: str) -> Column:
    """Texts of the claims of a status, each once."""
    return facts.unique(F.transform(F.filter(claims, lambda c: c["status"] == status), lambda c: c["claim"]))


def cleaned(claims: Column) -> Column:
    """Claims from elsewhere: without empty ones, an unknown status as unclear."""
    fixed = F.transform(
        F.coalesce(claims, F.array().cast(CLAIMS)),
        lambda c: F.struct(facts.present(c["claim"]).alias("claim"), F.when(c["status"].isin(list(STATUSES)), c["status"]).otherwise("unclear").alias("status"), facts.unique(c["source_ids"]).alias("source_ids"), facts.present(c["reason"]).alias("reason")),
    )
    return F.filter(fixed, lambda c: c["claim"] != "")


def table(articles: DataFrame, *key: str, claims: str = "claims") -> DataFrame:
    """A row for each claim: the key columns, place, claim, status, source_ids, reason, and the yen, the rate and the months that it names, by which claims of different articles can be joined. An article without claims has one row with nulls."""
    rows = articles.select(*key, F.posexplode_outer(claims).alias("place", "c")).select(*key, "place", "c.*")
    return rows.select("*", quality.amounts(F.col("claim")).alias("yen"), F.regexp_extract("claim", r"([0-9０-９]+\s*分の\s*[0-9０-９]+|[0-9]+\s*/\s*[0-9]+|[0-9.]+\s*[%％]|[0-9]+\s*割)", 1).alias("rate"), F.regexp_extract_all(tight(F.col("claim")), F.lit(_MONTH), 0).alias("months"))
