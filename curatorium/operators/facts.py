"""Facts of a programme that an article may state: their normal form, what is missing of them, and where they are read from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text
from curatorium.operators import rules

TEXTS = (
    "official_name", "fiscal_year", "application_round", "administering_body", "supervising_body", "application_start", "application_deadline", "subsidy_rate", "subsidy_cap", "calculation_method", "project_period",
)
LISTS = (
    "eligible_applicants", "eligible_projects", "eligible_expenses", "ineligible_expenses", "eligibility_conditions", "payment_conditions", "application_methods", "required_documents", "contact_information", "unknown_fields",
)
SOURCES = "array<struct<id:string,label:string,url:string,checked_at:string,evidence:string>>"
PRE_START = "struct<confirmed:boolean,allowed_from:string,safe_description:string,source_id:string>"
FACTS = f"struct<article_type:string,program_kind:string,{','.join(f'{c}:string' for c in TEXTS)},{','.join(f'{c}:array<string>' for c in LISTS)},pre_start:{PRE_START},official_sources:{SOURCES}>"
LEAST_EVIDENCE, MAX_EVIDENCE, LEAST_SOURCE = 12, 800, 24
#: In the order in which they make up the evidence of all facts.
_EVIDENCE = (
    "official_name", "fiscal_year", "application_round", "administering_body", "supervising_body", "application_start", "application_deadline", "subsidy_rate", "subsidy_cap", "eligible_applicants", "eligible_projects", "eligible_expenses",
    "ineligible_expenses", "eligibility_conditions", "calculation_method", "payment_conditions", "application_methods", "required_documents", "contact_information", "project_period",
)


ORDER = ("article_type", "program_kind", *TEXTS, *LISTS, "pre_start", "official_sources")


def replaced(f: Column, **changed: Column) -> Column:
    """Facts with some of their fields changed."""
    return F.struct(*[changed.get(name, f[name]).alias(name) for name in ORDER])


def present(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def unique(c: Column) -> Column:
    """Trimmed members that are not empty, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, none), present), lambda x: x != ""))


def article_type(value: Column, title: Column, content: Column, category: Column) -> Column:
    """The kind of an article: as given, or by the first words that occur."""
    raw = present(value)

    def judge(everything: Column) -> Column:
        worded = [(everything.rlike(text.skipping(pattern)), kind) for kind, pattern in lexicon.ARTICLE_TYPE_WORDS]
        single = everything.rlike(text.skipping(lexicon.ARTICLE["offering"])) & ~everything.rlike(lexicon.ARTICLE["generic"])
        return rules.decision([*worded, (single, "single_program")], "feature")

    told = text.bound(F.concat_ws(" ", present(title), present(content), present(category)), judge)
    return rules.decision([(raw.isin(list(lexicon.ARTICLE_TYPES)), raw), (present(category) == lexicon.FEATURE, "feature")], told)


def program_kind(value: Column, title: Column, content: Column) -> Column:
    raw = present(value)
    told = text.bound(F.concat_ws(" ", present(title), present(content)), lambda everything: rules.decision([(everything.rlike(text.skipping(pattern)), kind) for kind, pattern in lexicon.PROGRAM_KIND_WORDS], "other"))
    return rules.decision([(raw.isin(list(lexicon.PROGRAM_KINDS)), raw)], told)


def normalised(f: Column) -> Column:
    """Facts with texts trimmed, lists without empty and repeated members, and sources named. Null facts are empty ones."""
    sources = F.transform(
        F.coalesce(f["official_sources"], F.array().cast(SOURCES)),
        lambda s, i: F.struct(
            text.first_present(present(s["id"]), F.concat(F.lit("source-"), (i + 1).cast("string"))).alias("id"),
            text.first_present(present(s["label"]), present(s["url"]), F.concat(F.lit("公式情報 "), (i + 1).cast("string"))).alias("label"), present(s["url"]).alias("url"), present(s["checked_at"]).alias("checked_at"), present(s["evidence"]).alias("evidence"),
        ),
    )
    start = f["pre_start"]
    return F.struct(
        article_type(f["article_type"], F.lit(""), F.lit(""), F.lit("")).alias("article_type"), program_kind(f["program_kind"], f["official_name"], F.lit("")).alias("program_kind"),
        *[present(f[c]).alias(c) for c in TEXTS], *[unique(f[c]).alias(c) for c in LISTS],
        F.struct(F.coalesce(start["confirmed"], F.lit(False)).alias("confirmed"), *[present(start[c]).alias(c) for c in ("allowed_from", "safe_description", "source_id")]).alias("pre_start"), sources.alias("official_sources"),
    )


def usable_source(f: Column) -> Column:
    """Whether a source has an address and enough of what it says."""
    return F.exists(f["official_sources"], lambda s: (s["url"] != "") & (F.length(s["evidence"]) >= LEAST_EVIDENCE))


def _some(c: Column) -> Column:
    return F.size(c) > 0


def _known(f: Column) -> dict[str, Column]:
    """Whether the facts hold what each field is required for."""
    funding = (f["subsidy_rate"] != "") | (f["subsidy_cap"] != "") | (f["calculation_method"] != "")
    eligible = _some(f["eligible_applicants"]) | _some(f["eligibility_conditions"])
    return {
        "officialName": f["official_name"] != "", "administeringBody": f["administering_body"] != "", "officialSources": usable_source(f), "eligibleApplicants": _some(f["eligible_applicants"]), "eligibleProjects": _some(f["eligible_projects"]),
        "eligibleExpenses": _some(f["eligible_expenses"]), "applicationDeadline": f["application_deadline"] != "", "fundingDetails": funding, "eligibilityConditions": eligible, "paymentConditions": _some(f["payment_conditions"]) | funding,
        "calculationMethod": (f["calculation_method"] != "") | (f["subsidy_cap"] != ""), "programDetails": _some(f["eligible_projects"]) | _some(f["eligibility_conditions"]) | _some(f["eligible_expenses"]),
    }


def _names(names) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def _by(c: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return rules.decision([(c == kind, _names(names)) for kind, names in table.items()], _names(()))


def missing(f: Column, title: Column) -> Column:
    """Names of the facts that an article of this type and title needs and that are not known, in the order of their need. f is normalised."""
    single = f["article_type"] == "single_program"
    dated = single | title.rlike(lexicon.ARTICLE["year"]) | title.rlike(lexicon.ARTICLE["deadline"])
    required = F.concat(
        _by(f["article_type"], lexicon.REQUIRED_FACTS), F.when(single, _by(f["program_kind"], lexicon.REQUIRED_OF_PROGRAM)).otherwise(_names(())),
        F.when(title.rlike(lexicon.ARTICLE["amount"]), _names(("officialName", "administeringBody", "officialSources", "fundingDetails"))).otherwise(_names(())), F.when(dated, _names(("applicationDeadline",))).otherwise(_names(())),
    )
    lacking = F.array_compact(F.array(*[F.when(~known, F.lit(name)) for name, known in _known(f).items()]))
    return F.array_intersect(required, lacking)


def readiness(f: Column) -> Column:
    """struct(ready, score, missing): whether an article can be written from these normalised facts, by the checklist of the programme's kind."""
    known = _known(f)
    eligible, conditions = known["eligibilityConditions"], _some(f["eligibility_conditions"])
    common = [("officialName", known["officialName"]), ("administeringBody", known["administeringBody"]), ("officialSources", known["officialSources"]), ("eligibleApplicants", eligible), ("applicationDeadline", known["applicationDeadline"])]
    more = {
        "subsidy": [("eligibleExpenses", known["eligibleExpenses"]), ("fundingDetails", known["fundingDetails"])], "incentive": [("eligibilityConditions", conditions), ("calculationMethod", known["calculationMethod"])],
        "benefit": [("paymentConditions", known["paymentConditions"]), ("eligibilityConditions", eligible)], "loan": [("fundingDetails", known["fundingDetails"]), ("eligibilityConditions", eligible)],
        "other": [("programDetails", known["programDetails"]), ("fundingDetails", known["fundingDetails"])],
    }
    lacks = lambda checks: F.array_compact(F.array(*[F.when(~hit, F.lit(name)) for name, hit in checks]))
    lacking = rules.decision([(f["program_kind"] == kind, lacks(common + checks)) for kind, checks in more.items()], lacks(common))
    return text.bound(lacking, lambda m: F.struct((F.size(m) == 0).alias("ready"), F.round(100 * (7 - F.size(m)) / 7).cast("int").alias("score"), m.alias("missing")))


def labelled(c: Column, label: str) -> Column:
    """What stands behind a label up to the next bar or line end."""
    return F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i){label}\s*[:：]\s*([^|\n]+)", 1))


def fact_list(c: Column) -> Column:
    """Members of a listed value, without the labels that introduce them."""
    return unique(F.transform(F.split(c, "[、,\n／/・|]+"), lambda x: F.regexp_replace(x, r"^(?:対象|経費|概要|上限|締切)\s*[:：]?", "")))


def _without_first(c: Column, part: Column) -> Column:
    at = F.position(part, c)
    return F.trim(F.when((part != "") & (at > 0), F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + F.length(part)))).otherwise(c))


def from_texts(c: dict[str, Column]) -> Column:
    """Facts of an article from what an editor pasted: blocks of labelled values (the one whose ID is that of the article's programme, else the first), joined with facts known before.

    c: facts (FACTS, may be null), source_text, subsidies_text, instructions, memo, title, content, category, article_type, subsidy_id; absent ones are empty.
    """
    get = lambda name: c.get(name, F.lit(None).cast("string"))
    pasted = text.without_html(F.concat_ws("\n", *[F.nullif(present(get(n)), F.lit("")) for n in ("source_text", "subsidies_text", "instructions", "memo")]))
    blocks = F.filter(F.transform(F.split(F.coalesce(text.first_present(get("subsidies_text"), get("source_text")), F.lit("")), "\n---\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+\z", "")), lambda b: b != "")
    wanted = present(get("subsidy_id"))
    own = F.get(F.filter(blocks, lambda b: (wanted != "") & (labelled(b, "ID") == wanted)), F.lit(0))
    old = F.struct(normalised(c.get("facts", F.lit(None).cast(FACTS))).alias("old"), pasted.alias("pasted"), F.coalesce(own, F.get(blocks, F.lit(0)), pasted).alias("block"), text.without_html(get("content")).alias("content"))
    return text.bound(old, lambda s: _joined(s["old"], s["pasted"], s["block"], present(get("title")), s["content"], get("category"), present(get("article_type"))))


def _joined(old: Column, pasted: Column, block: Column, title: Column, content: Column, category: Column, given: Column) -> Column:
    stated = labelled(block, "公式URL")
    found = F.filter(F.regexp_extract_all(F.when(pasted != "", pasted).otherwise(block), F.lit(r"https?://[^\s<>\"')]+"), 0), lambda u: ~u.rlike(lexicon.PORTAL_HOST))
    url = F.when((stated != "") & (stated != "なし"), stated).otherwise(F.coalesce(F.get(found, F.lit(0)), F.lit("")))
    said = _without_first(text.without_html(F.when(block != "", block).otherwise(pasted)), url)
    evidence = F.when((F.length(said) >= LEAST_SOURCE) & said.rlike(lexicon.ARTICLE["evidence"]), F.substring(said, 1, MAX_EVIDENCE)).otherwise("")
    new = F.struct(F.lit("source-1").alias("id"), F.coalesce(text.first_present(labelled(block, "タイトル")), F.lit("公式情報")).alias("label"), url.alias("url"), labelled(pasted, "確認日").alias("checked_at"), evidence.alias("evidence"))
    fresh = (url != "") & ~F.exists(old["official_sources"], lambda s: s["url"] == url)
    sources = F.when(fresh, F.concat(old["official_sources"], F.array(new))).otherwise(old["official_sources"])
    either = lambda name, *more: F.coalesce(text.first_present(old[name], *more), F.lit(""))
    everything = F.concat_ws(" ", content, pasted)
    kind = F.when(given == "column", old["article_type"]).when(given != "", given).otherwise(old["article_type"])
    begun = old["pre_start"]
    told = F.when(pasted.rlike(lexicon.ARTICLE["start"]), "契約・発注・購入・着手が可能になる時点は、入力素材内の記載をもとに確認が必要です。").otherwise("")
    kept = begun["confirmed"] | (begun["safe_description"] != "")
    start = F.when(kept, begun).otherwise(F.struct(F.lit(False).alias("confirmed"), F.lit("").alias("allowed_from"), told.alias("safe_description"), F.lit("").alias("source_id")))
    changed = {
        "article_type": article_type(kind, title, everything, F.coalesce(category, F.lit(""))), "program_kind": program_kind(F.when(old["program_kind"] == "other", "").otherwise(old["program_kind"]), title, text.condensed(everything)), "official_name": either("official_name", labelled(block, "タイトル")),
        "administering_body": either("administering_body", labelled(block, "機関"), labelled(pasted, "実施機関")), "subsidy_rate": either("subsidy_rate", labelled(block, "補助率")), "subsidy_cap": either("subsidy_cap", labelled(block, "上限")),
        "application_deadline": either("application_deadline", labelled(block, "締切")), "eligible_applicants": unique(F.concat(old["eligible_applicants"], fact_list(labelled(block, "対象")))),
        "eligible_expenses": unique(F.concat(old["eligible_expenses"], fact_list(labelled(block, "経費")))), "pre_start": start, "official_sources": sources,
    }
    return text.bound(replaced(old, **changed), lambda f: replaced(f, unknown_fields=unique(F.concat(f["unknown_fields"], missing(f, title)))))


def evidence_text(f: Column) -> Column:
    """All facts as one text, to look claims up in."""
    sources = F.transform(f["official_sources"], lambda s: F.concat_ws(" ", s["label"], s["url"], s["checked_at"], s["evidence"]))
    parts = [F.array(f[c]) if c in TEXTS else f[c] for c in _EVIDENCE]
    return text.without_html(F.array_join(F.filter(F.concat(*parts, F.array(f["pre_start"]["safe_description"]), sources), lambda x: x != ""), "\n"))
