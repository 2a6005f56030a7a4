"""Review of editorial articles: a table of rules that find faults, warn, praise, and cap the score.

Faults cost FATAL points and warnings WARNING; the score is the least of what they leave, the coverage of the facts, the grounding of the claims, and
every cap that applies, so that caps combine whatever their order and the review says where each comes from. Two profiles word some rules differently:
`editor`, for articles that people edit, and `server`, for generated ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions import lexicon, text
from curatorium.operators import claims, facts, quality, rules
from curatorium.operators.stages import once

FATAL, WARNING = 12, 4
LEAST_LENGTH, GOOD_LENGTH, FEATURE_LENGTH = 1500, 4000, 6000
PUBLISH, REGENERATE = 90, 80
NOT_REVIEWED = "APIレビュー未実行"
MACHINE = "struct<enabled:boolean,used_api:boolean,semantic_score:int,title_body_alignment:string,factual_risk:string,search_intent_fit:string,reviewer_comments:array<string>>"
_STRINGS = "array<string>"
#: A review from elsewhere; any of its fields may be null.
REVIEW = (
    f"struct<quality_score:double,final_score:double,rule_based_score:double,source_coverage_score:double,factual_grounding_score:double,content_quality_score:double,missing_facts:{_STRINGS},claims:{claims.CLAIMS},unsupported_claims:{_STRINGS},"
    f"contradictory_claims:{_STRINGS},fatal_issues:{_STRINGS},warnings:{_STRINGS},strengths:{_STRINGS},suggestions:{_STRINGS},caps:{_STRINGS},title_needs_rewrite:boolean,suggested_titles:{_STRINGS},publish_allowed:boolean,human_reviewed:boolean,"
    f"should_regenerate:boolean,machine:{MACHINE}>"
)
_LISTS = ("fatal_issues", "warnings", "strengths", "suggestions", "caps", "suggested_titles", "missing_facts", "unsupported_claims", "contradictory_claims")
#: The fields of a review by reviewed(), in their order.
FIELDS = (
    "quality_score", "rule_based_score", "source_coverage_score", "factual_grounding_score", "content_quality_score", "grade", "article_type", "article_type_label", "facts", "missing_facts", "claims", "unsupported_claims", "contradictory_claims", "fatal_issues", "warnings",
    "strengths", "suggestions", "caps", "title_needs_rewrite", "suggested_titles", "publish_allowed", "human_reviewed", "should_regenerate", "should_human_review", "machine",
)
_A = lexicon.ARTICLE


@dataclass(frozen=True)
class Rule:
    """kind: fatal, warning, strength or cap. server: the message in that profile where it differs; tells: whether that profile gives the suggestion too; rewrite: the title must change."""

    kind: str
    when: Column
    message: Column
    suggestion: Column | None = None
    cap: int | None = None
    reason: str = ""
    server: Column | None = None
    tells: bool = False
    rewrite: bool = False


def _told(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _listed(c: Column) -> Column:
    return F.array_join(c, "、")


def safe_titles(title: Column, f: Column) -> Column:
    """Titles for an article that promise less, from its title and normalised facts."""
    theme = F.regexp_replace(title, "｜.*$", "")
    theme = F.regexp_replace(theme, r"令和\s*[0-9]+\s*年度|20[0-9]{2}\s*年|補助率|上限額|補助上限|締切|第\s*[0-9０-９一二三四五六七八九]+\s*次公募", "")
    theme = text.tight(F.regexp_replace(theme, "[|｜:：]+", ""))
    base = F.coalesce(text.first_present(theme, f["official_name"]), F.lit("愛媛県の補助金"))
    name = f["official_name"]
    named = F.array(_told(name, "の確認ポイント"), F.when(f["program_kind"] == "subsidy", _told(name, "の対象者・対象経費と申請前の注意点")).otherwise(_told(name, "の対象者・交付条件と申請前の注意点")))
    waste = F.array(
        F.lit("愛媛県で産業廃棄物処理業者が確認したい補助金・支援制度｜設備更新・再資源化・省エネ対策の探し方"), F.lit("愛媛県の産業廃棄物処理・リサイクル事業者が補助金を探すときの確認ポイント"), F.lit("産業廃棄物処理業者向け補助金を愛媛県内で探す方法と申請前の注意点")
    )
    general = text.bound(
        base, lambda b: F.array(_told(F.regexp_replace(b, r"向け補助金\z", "向け補助金・支援制度"), "の探し方と申請前の注意点"), _told(F.regexp_replace(b, r"補助金\z", "補助金・支援制度"), "で確認したい公式情報"), _told(F.regexp_replace(b, r"向け\z", ""), "向け支援制度の公式情報確認ポイント"))
    )
    return facts.unique(F.when((f["article_type"] == "single_program") & (name != ""), named).when(title.rlike("産業廃棄物処理業者|廃棄物処理業者|リサイクル業者"), waste).otherwise(general))


def _label(c: Column, table: dict[str, str]) -> Column:
    return rules.decision([(c == k, v) for k, v in table.items()], c)


def _claimed(articles: DataFrame) -> DataFrame:
    have = set(articles.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    rows = once(articles, {"_title": F.coalesce("title", F.lit("")), "_html": F.coalesce("content", F.lit("")), "_body": text.without_html(F.col("content"))})
    given = {c: get(c) for c in ("source_text", "subsidies_text", "instructions", "memo", "category", "article_type", "subsidy_id")} | {"title": F.col("_title"), "content": F.col("_html")}
    if "facts" in have:
        given["facts"] = F.col("facts")
    rows = once(rows, {"_read": facts.from_texts(given), "_brief": text.condensed(F.col("_body"))})
    f, body, brief, title = F.col("_read"), F.col("_body"), F.col("_brief"), F.col("_title")
    kind = facts.article_type(F.when(facts.present(get("article_type")).isin("", "column"), f["article_type"]).otherwise(get("article_type")), title, body, get("category"))
    rows = once(rows, {"_facts": facts.replaced(f, article_type=kind, program_kind=facts.program_kind(f["program_kind"], title, brief))})
    f = F.col("_facts")
    links = F.regexp_extract_all("_html", F.lit(r"""(?i)<a\s+[^>]*href=["']([^"']+)["'][^>]*>"""), 1)
    rows = once(rows, {"_length": F.length(text.tight(body)), "_links": links, "_evidence": facts.evidence_text(f), "_missing": facts.missing(f, title), "_official": facts.usable_source(f)})
    own = F.filter("_links", lambda h: h.startswith("/") | h.rlike(lexicon.PORTAL_HOST))
    path = lambda h: F.when(h.startswith("/"), h).otherwise(F.coalesce(text.first_present(F.regexp_replace(h, "(?i)^https?://[^/?#]*", "")), F.lit("/")))
    return once(
        rows,
        {
            "_claims": claims.factual(title, body, f, F.col("_evidence"), brief), "_own": own, "_away": F.size(F.filter("_links", lambda h: h.rlike("(?i)^https?://") & ~h.rlike(lexicon.PORTAL_HOST))),
            "_astray": facts.unique(F.filter(F.transform(own, path), lambda p: ~p.rlike(lexicon.PORTAL_PATHS))),
            **{f"_n_{tag}": F.regexp_count("_html", F.lit(rf"(?i)<{tag}[\s>]")) for tag in ("h2", "table")}, "_cells": F.col("_html").rlike(r"(?i)<th[\s>]|<td[\s>]"),
        },
    )


def claimed(articles: DataFrame) -> DataFrame:
    """articles with their facts and claims (columns _facts, _claims and what these are read from): the part of measured() that needs no rule's tests."""
    return _claimed(articles).drop("_links", "_own", "_away", "_astray", "_n_h2", "_n_table", "_cells")


def measured(articles: DataFrame) -> DataFrame:
    """articles with what the rules look at, in the columns _title, _body, _length, _facts, _links and _seen (tests by name).

    articles: title, content (HTML), and where they are known category, article_type, subsidy_id, facts (facts.FACTS), source_text, subsidies_text, instructions, memo, human_reviewed.
    """
    have = set(articles.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    rows, brief, title = _claimed(articles), F.col("_brief"), F.col("_title")
    in_body = ("year", "amount", "money", "official", "checked", "deadline_detail", "round", "implementer", "study_detail", "equipment", "definite", "risky", "local", "contract", "target", "expense", "excluded", "action", "project", "conditions", "start", "single", "method")
    in_title = ("year", "amount", "deadline", "offering", "generic", "rate_title", "cap_title", "any_amount_title")
    tests = {f"body_{n}": brief.rlike(text.skipping(_A[n])) for n in in_body} | {f"title_{n}": title.rlike(_A[n]) for n in in_title} | {"memo": F.col("_html").rlike(_A["memo"]), "checklist": F.col("_html").rlike(_A["checklist"]), "study": F.concat_ws(" ", title, brief).rlike(_A["study"])}
    human = F.coalesce(F.col("human_reviewed"), F.lit(False)) if "human_reviewed" in have else F.lit(False)
    return once(rows, {"_seen": F.struct(*[c.alias(n) for n, c in tests.items()]), "_unsupported": claims.of_status(F.col("_claims"), "unsupported"), "_contradictory": claims.of_status(F.col("_claims"), "contradictory"), "_human": human, "_category": facts.present(get("category"))})


def rule_table(profile: str) -> list[Rule]:
    """The rules in the order in which a review lists them, over the columns of measured()."""
    server = profile == "server"
    t, f = F.col("_seen"), F.col("_facts")
    length, n_h2, n_table, away = F.col("_length"), F.col("_n_h2"), F.col("_n_table"), F.col("_away")
    official, subsidy = F.col("_official"), f["program_kind"] == "subsidy"
    kind_name = _label(f["program_kind"], lexicon.PROGRAM_KIND_LABELS)
    route = (away > 0) | t["body_official"]
    specific = t["title_amount"] | t["title_year"] | t["title_deadline"]
    detailed = F.when(subsidy, t["body_target"] & t["body_expense"] & t["body_excluded"] & t["body_project"]).otherwise(t["body_target"] & t["body_conditions"])
    identity = F.array_compact(F.array(F.when(f["official_name"] == "", "正式な制度名"), F.when(f["administering_body"] == "", "実施機関"), F.when(~official, "公式URL・根拠メモ")))
    money = t["body_money"]
    answered = ((t["title_rate_title"] | t["title_cap_title"]) & money) | (t["title_any_amount_title"] & (money | t["body_method"]))
    funded = (~t["title_rate_title"] | (f["subsidy_rate"] != "")) & (~t["title_cap_title"] | (f["subsidy_cap"] != "")) & (~t["title_any_amount_title"] | (f["subsidy_cap"] != "") | (f["calculation_method"] != ""))
    paid = funded & t["body_amount"] & answered & official & (t["body_official"] if server else F.lit(True))
    offering = (f["article_type"] == "single_program") | (t["title_offering"] & ~t["title_generic"])
    no_end, no_body, no_source = ~t["body_deadline_detail"] | (f["application_deadline"] == ""), ~t["body_implementer"] | (f["administering_body"] == ""), (away == 0) | ~official
    wanting = F.array_compact(F.array(F.when(no_end, "公募期間・締切"), F.when(no_body, "実施機関"), F.when(t["title_deadline"] & ~t["body_round"], "回次"), F.when(no_source, "公式URL・根拠メモ"), F.when(~t["body_checked"], "確認日")))
    unsupported, contradictory, lacking = F.col("_unsupported"), F.col("_contradictory"), F.col("_missing")
    shown = lacking if server else F.transform(lacking, lambda m: _label(m, lexicon.FACT_LABELS))
    feature = (f["article_type"] == "feature") | (F.col("_category") == lexicon.FEATURE)
    has_table = (n_table > 0) | F.col("_cells")
    n, said = (lambda c: c.cast("string")), F.lit
    by_kind = lambda a, b: F.when(subsidy, a).otherwise(b if isinstance(b, Column) else F.lit(b))
    short, middling = length < LEAST_LENGTH, (length >= LEAST_LENGTH) & (length < GOOD_LENGTH)
    started = t["body_contract"] | t["body_start"]
    uncertain = (t["body_definite"] | (money & t["body_year"])) & ~official
    return [
        Rule("fatal", short, _told("本文が", n(length), "文字です。致命的NGの目安である1500文字を下回っています。"),
             by_kind("対象者、対象経費、対象外、申請前注意、愛媛県内での探し方を追加してください。", _told("対象者、", kind_name, "の交付・支給要件、算定方法、申請時期、愛媛県内での確認先を追加してください。")), 49, "本文が1,500文字未満です。", said("本文が1,500文字未満です。"), True),
        Rule("warning", middling, _told("本文が", n(length), "文字です。通常コラムは4000文字以上を目安にしてください。"),
             F.lit("概要だけで終わらないよう、公式ファクト表、確認項目、申請準備、よくある失敗、愛媛県内での探し方を追加してください。" if server else "概要だけで終わらないよう、用途別・経費別の見方や次の行動を追加してください。"), 79, "本文が4,000文字未満です。", said("本文が4,000文字未満です。"), True),
        Rule("strength", length >= GOOD_LENGTH, said("通常コラムの推奨文字数を満たしています。")),
        Rule("warning", feature & (length < FEATURE_LENGTH), _told("特集記事としては本文が", n(length), "文字です。6000文字以上を目安にしてください。"),
             F.lit("特集では業種別・用途別の探し方と関連導線を厚めにしてください。" if server else "特集ページでは、業種別・用途別の探し方と関連ページ導線を厚めにしてください。"), server=said("特集記事としては6,000文字未満です。"), tells=True),
        Rule("warning", ~official, said("公式URLだけ、または本文内リンクだけでは公式ファクト確認済みとして扱えません。"), said("管理画面の素材欄や自動生成データに、制度名・実施機関・上限額・締切など一次情報から確認した根拠メモを入れてください。"), 89, "公式URLと根拠メモが揃っていないため、100点・90点台の上限を制限します。"),
        Rule("warning", F.size(lacking) > 0, _told("公式ファクトが不足しています: ", _listed(shown)), said("不足している公式情報は本文で断定せず、missingFacts として管理画面で確認してください。")),
        Rule("strength", F.size(lacking) == 0, said("公式ファクトの必須項目が揃っています。")),
        Rule("fatal", t["title_amount"] & ~paid, said("タイトルで補助率・上限額を約束しているが本文と公式ファクトに具体情報がありません。"), said("具体情報を確認できない場合は、タイトルを「確認ポイント」「探し方」など安全な表現に弱めてください。"), 39, "タイトルの補助率・上限額・金額の約束に本文が答えていません。", tells=True, rewrite=True),
        Rule("fatal", specific & (F.size(identity) > 0), _told("正式な制度名・実施機関・公式URLが確認できません。不足: ", _listed(identity)), said("補助率・上限額・年度などをタイトルで約束する場合は、正式制度名、実施機関、公式URL、補助率、上限額を suppliedFacts に揃えてください。"),
             39, "強いタイトルに必要な正式制度名・実施機関・公式URLが不足しています。", tells=True, rewrite=True),
        Rule("fatal", t["body_single"] & ((f["official_name"] == "") | ~official), said("正式な単一制度を特定できないのに「この補助金」など単一制度を前提にした表現があります。"), said("正式制度を特定できない場合は、業種別特集として複数制度の探し方・比較方法に書き換えてください。"),
             39, "正式制度未特定のまま単一制度として書いています。", tells=True, rewrite=True),
        Rule("fatal", t["title_year"] & (~t["body_year"] | ~official), said("タイトルに年度・年号がありますが、本文で同じ年度の根拠説明が不足しています。"), said("年度をタイトルに入れる場合は、本文にも公式確認日や該当年度の根拠を入れてください。"), 39, "タイトルの年度・年号の約束に本文が答えていません。", rewrite=True),
        Rule("fatal", t["title_deadline"] & (~t["body_deadline_detail"] | ~official), said("タイトルに締切・公募回・申請期間がありますが、本文に対応する期間・締切・回次の説明が不足しています。"), said("公募期間、締切、開始日、回次が不明な場合は、タイトルを「確認ポイント」など安全な表現に弱めてください。"),
             39, "タイトルの締切・公募回の約束に本文が答えていません。", rewrite=True),
        Rule("fatal", t["body_risky"], said("「必ず対象」「必ずもらえる」など、補助金の対象・受給を断定する表現があります。"), said("「対象になる可能性があります」「公式要件の確認が必要です」などに弱めてください。"), server=said("補助金の対象・受給を断定する表現があります。"), tells=True),
        Rule("fatal", t["memo"], said("管理用メモや品質レビュー用の文言が公開本文に混ざっている可能性があります。"), said("品質スコア、自己採点、確認方針、外部リンク件数などは管理画面だけに表示してください。"), 39, "管理用メモが公開本文に混ざっています。", said("管理用メモや品質レビュー用の文言が公開本文に混ざっています。")),
        Rule("fatal", ~route, said("公式ページ・自治体窓口・実施機関への確認導線がありません。"), said("公式URLがある場合は本文にリンクし、ない場合も自治体窓口や実施機関での確認を案内してください。"), 49, "公式情報確認の導線がありません。"),
        Rule("warning", route & (away == 0), said("本文内に公式ページなどの外部確認リンクがありません。"), said("公式URLが分かる場合は、本文に一次情報へのリンクを追加してください。")),
        Rule("strength", away > 0, said("公式情報への外部リンクがあります。")),
        Rule("fatal", ~has_table, said("表が1つもありません。"), said("対象者、対象経費、補助率、上限額、注意点などを表で整理してください。"), 59, "表がありません。", tells=True),
        Rule("warning", has_table & (n_table < 2), said("表が1つだけです。記事の読み応えを出すため、公式ファクト表と申請前確認表など2つ以上に分けてください。"), said("公式ファクト表、不足情報の確認表、対象経費の確認表、申請前チェック表を追加してください。"), 79, "表が1つだけです。", tells=True),
        Rule("strength", n_table >= 2, said("複数の表で情報を整理しています。")),
        Rule("fatal", F.size("_own") == 0, said("えひめ補助金ポータル内の内部リンクがありません。"), said("関連特集、検索ページ、シミュレーター、専門家ページへの自然な内部リンクを入れてください。"), 59, "内部リンクがありません。"),
        Rule("fatal", F.size("_astray") > 0, _told("存在しない可能性がある内部リンクがあります: ", _listed(F.col("_astray"))), said("補助金一覧への導線は /ehime-subsidy/、検索導線は /search?keyword=... を使ってください。/subsidy-list は存在しません。"), 59, "存在しない可能性がある内部リンクがあります。"),
        Rule("strength", (F.size("_own") > 0) & (F.size("_astray") == 0), said("内部リンクがあります。")),
        Rule("fatal", ~detailed, by_kind("対象者・対象経費・対象外になりやすい経費のいずれかが不足しています。", _told(kind_name, "として、対象者・交付要件・算定方法または支給条件の説明が不足しています。")),
             by_kind("「対象になる可能性がある人」「対象になりやすい経費」「対象外・注意が必要な経費」を具体化してください。", "公式ファクトに基づき、対象者、交付・支給要件、金額の算定方法、申請時期を具体化してください。")),
        *([] if server else [Rule("strength", detailed, by_kind("対象者・対象経費・対象外の観点があります。", _told(kind_name, "に必要な対象者・交付条件・算定方法の観点があります。")))]),
        Rule("fatal", subsidy & ~started, said("契約・発注・購入・着手が可能になる時点について、制度ごとの確認を促す注意がありません。"), said("公式情報で確認できない場合は、交付決定前などに発生した経費が対象外になる場合があるため、公募要領と実施機関への確認が必要と安全に書いてください。"),
             69, "契約・発注・購入・着手が可能になる時点の注意がありません。"),
        Rule("fatal", ~t["body_local"], said("愛媛県・市町村・地域事業者の視点が不足しています。"), said("愛媛県内の市町村、商工会議所、商工会、地域事業者向けの探し方を入れてください。")),
        Rule("strength", t["body_local"], said("愛媛県内の読者向けの文脈があります。")),
        Rule("warning", n_h2 < 10, _told("H2が", n(n_h2), "個です。検索意図を満たすには10個以上を目安にしてください。"),
             by_kind("冒頭の結論、公式ファクト、不足情報、対象者、対象経費、対象外、申請前注意、愛媛県内での探し方、内部リンク、まとめをH2で整理してください。", _told("冒頭の結論、公式ファクト、不足情報、対象者、", kind_name, "の交付・支給要件、算定方法、申請時期、愛媛県内の確認先、内部リンク、まとめをH2で整理してください。")),
             server=said("H2が10個未満です。")),
        Rule("warning", n_h2 > 12, _told("H2が", n(n_h2), "個あります。見出しを細分化しすぎず、10〜12個を目安に内容の近い節を統合してください。"), said("各H2に2段落以上の具体的な説明を持たせ、薄い節の量産を避けてください。"), 79, "H2が13個以上あり、見出しが細分化されすぎています。", said("H2が13個以上あります。内容の近い節を統合し、各H2を厚くしてください。")),
        Rule("warning", ~t["checklist"], said("チェックリストがありません。"), said("申請前に確認する項目を箇条書きで追加してください。")),
        Rule("warning", ~t["body_action"], said("CTAが弱い可能性があります。"), said("「補助金を探す」「診断する」「専門家に相談する」など次の行動を入れてください。")),
        Rule("fatal", specific & ~route, said("タイトルに具体的な条件があるのに、公式情報で確認する導線が不足しています。"), said("具体的な数字・年度・締切を扱う場合は、公式ページまたは実施機関への確認導線を必ず入れてください。"), 39, "タイトルの具体情報に対する公式確認導線がありません。"),
        Rule("fatal", specific & ~official, said("タイトルに具体的な条件があるのに、suppliedFacts に公式根拠がありません。"), said("補助率・上限額・年度・締切をタイトルに入れる前に、公式ファクトを構造化してください。"), 39, "タイトルの具体情報に対する公式ファクトがありません。", rewrite=True),
        Rule("fatal", offering & (no_end | no_body | no_source), _told("具体的な公募名・制度名の記事として、", _listed(wanting), "が不足しています。"),
             said("制度名を具体的に出す場合は、表に年度、回次、実施機関、公募期間、締切、補助率、上限額、対象者、対象事業、対象経費、対象外経費、公式URL、確認日を整理してください。"), 49, "具体的な公募名・制度名に必要な実施機関・公募期間・公式URL・根拠メモが不足しています。"),
        Rule("fatal", t["study"] & t["body_equipment"] & ~t["body_study_detail"], said("FS調査事業の記事なのに、本文が設備導入・購入中心の説明になっています。"), said("FS調査では、実現可能性調査、市場調査、事業化可能性、調査計画、報告書などの観点を中心に書いてください。"), 49, "FS調査事業と本文内容がズレています。"),
        Rule("fatal", uncertain, said("未確認の補助率・上限額・年度情報を確定情報として書いている可能性があります。"), said("公式情報で確認できない数字は断定せず、「確認が必要です」「公募要領で確認してください」と表現してください。"), 39, "未確認の補助率・上限額・年度情報を断定しています。"),
        Rule("fatal", F.size(unsupported) > 0, _told("公式ファクトで裏付けられない具体的主張があります: ", _listed(unsupported)), said("対象者・対象経費・対象外経費・金額・日付は、suppliedFacts にある範囲だけを書いてください。"), 39, "本文中に根拠不明の金額・日付・対象者・対象経費があります。"),
        Rule("fatal", F.exists(unsupported, lambda c: c.rlike(_A["claimed_field"])), said("根拠のない対象者・対象経費・対象外経費が記載されています。"), said("suppliedFacts にない対象者、対象経費、対象外経費は本文から削除し、missingFacts として管理画面で確認してください。"),
             39, "根拠のない対象者・対象経費・対象外経費があります。", tells=True),
        Rule("fatal", F.size(contradictory) > 0, _told("公式ファクトと矛盾する可能性がある主張があります: ", _listed(contradictory)), said("本文の具体値を公式ファクトに合わせるか、根拠がない場合は削除してください。"), 29, "公式情報と矛盾する可能性がある主張があります。"),
        Rule("cap", ~_excellent(t, detailed, subsidy, started, route, official), said(""), cap=89, reason="90点以上に必要な強条件をすべて満たしていません。"),
        Rule("cap", ~F.col("_human"), said(""), cap=99, reason="人間確認完了が確認できないため100点にはしません。"),
    ]


def _grounding() -> Column:
    many = lambda status: F.size(F.filter("_claims", lambda c: c["status"] == status))
    return quality.grounding_score(many("unsupported"), many("contradictory"), F.col("_official"))


def _excellent(t: Column, detailed: Column, subsidy: Column, started: Column, route: Column, official: Column) -> Column:
    """What a score of 90 or more asks for."""
    sound = (quality.coverage_score(F.col("_missing")) == 100) & (_grounding() == 100) & (F.size("_unsupported") == 0) & (F.size("_contradictory") == 0)
    shape = (F.col("_length") >= GOOD_LENGTH) & (F.col("_n_table") >= 2) & t["checklist"] & (F.size("_own") > 0) & (F.size("_astray") == 0) & t["body_action"] & ~t["memo"]
    return sound & shape & detailed & (~subsidy | started) & route & official & t["body_local"]


def reviewed(articles: DataFrame, profile: str = "editor") -> DataFrame:
    """articles with a column review: scores, grade, lists of faults, warnings, strengths, suggestions and caps, claims, safer titles, and whether the article may be published or must be written again. Null titles and contents are empty ones."""
    table = rule_table(profile)
    server = profile == "server"
    message = lambda r: r.server if server and r.server is not None else r.message
    listed = lambda kind: F.array_compact(F.array(*[F.when(r.when, message(r)) for r in table if r.kind == kind]))
    rows = measured(articles)
    rows = once(
        rows,
        {
            "_fatal": listed("fatal"), "_warned": listed("warning"), "_strong": listed("strength"),
            "_advice": F.array_compact(F.array(*[F.when(r.when, r.suggestion) for r in table if r.suggestion is not None and (not server or r.tells)])),
            "_caps": F.array_compact(F.array(*[F.when(r.when, F.struct(F.lit(r.cap).alias("most"), F.lit(f"{r.cap}点上限: {r.reason}").alias("shown"))) for r in table if r.cap is not None])),
            "_rewrite": F.exists(F.array(*[r.when for r in table if r.rewrite]), lambda x: x), "_coverage": quality.coverage_score(F.col("_missing")), "_grounded": _grounding(),
        },
    )
    base = quality.clamped(100 - FATAL * F.size("_fatal") - WARNING * F.size("_warned"))
    cap = F.coalesce(F.array_min(F.transform("_caps", lambda c: c["most"])), F.lit(100))
    rows = once(rows, {"_left": F.least(base, cap), "_score": F.least(base, cap, "_coverage", "_grounded")})
    f, score = F.col("_facts"), F.col("_score")
    allowed = (score >= PUBLISH) & (F.size("_fatal") == 0) & (F.size("_unsupported") == 0) & (F.size("_contradictory") == 0) & ~F.col("_rewrite") & F.col("_official") & (F.lit(True) if server else F.col("_human"))
    known = facts.replaced(f, unknown_fields=facts.unique(F.concat(f["unknown_fields"], F.col("_missing"))))
    titles = F.when(F.col("_rewrite"), safe_titles(F.col("_title"), f)).otherwise(F.array().cast(_STRINGS))
    review = {
        "quality_score": score, "rule_based_score": score, "source_coverage_score": F.col("_coverage"), "factual_grounding_score": F.col("_grounded"), "content_quality_score": F.col("_left"), "grade": quality.letter(score),
        "article_type": f["article_type"], "article_type_label": _label(f["article_type"], lexicon.ARTICLE_TYPE_LABELS), "facts": known, "missing_facts": F.col("_missing"), "claims": F.col("_claims"), "unsupported_claims": F.col("_unsupported"), "contradictory_claims": F.col("_contradictory"),
        "fatal_issues": facts.unique(F.col("_fatal")), "warnings": facts.unique(F.col("_warned")), "strengths": facts.unique(F.col("_strong")), "suggestions": facts.unique(F.col("_advice")), "caps": facts.unique(F.transform("_caps", lambda c: c["shown"])),
        "title_needs_rewrite": F.col("_rewrite"), "suggested_titles": titles, "publish_allowed": allowed, "human_reviewed": F.col("_human"), "should_regenerate": (F.size("_fatal") > 0) | (score < REGENERATE), "should_human_review": F.lit(True), "machine": machine_review(F.lit(None).cast(MACHINE)),
    }
    return once(rows, {"review": F.struct(*[review[n].alias(n) for n in FIELDS])}).select(*articles.columns, "review")


def whole_score(c: Column) -> Column:
    """A score as a whole number from 0 to 100, 0 where there is none."""
    return F.coalesce(quality.clamped(F.floor(F.nanvl(c.cast("double"), F.lit(0.0)) + 0.5)).cast("int"), F.lit(0))


def machine_review(m: Column, ran: bool = False) -> Column:
    """A language model's part of a review, with what stands for its remarks where it has not been run. ran: it has, whatever m says."""
    remarks = [F.coalesce(text.first_present(m[c]), F.lit(NOT_REVIEWED)).alias(c) for c in ("title_body_alignment", "factual_risk", "search_intent_fit")]
    return F.struct(*[(F.lit(True) if ran else F.coalesce(m[c], F.lit(False))).alias(c) for c in ("enabled", "used_api")], whole_score(m["semantic_score"]).alias("semantic_score"), *remarks, facts.unique(m["reviewer_comments"]).alias("reviewer_comments"))


def least_cap(caps: Column) -> Column:
    """The least of the caps that a review's lines name, 100 where none does."""
    found = F.transform(caps, lambda c: F.regexp_extract(c, r"([0-9]{1,3})\s*点?上限", 1))
    return F.coalesce(F.array_min(F.transform(F.filter(found, lambda x: x != ""), lambda x: F.least(x.cast("int"), F.lit(100)))), F.lit(100))


def normalised(r: Column) -> Column:
    """A review from elsewhere (REVIEW) in order: lists without repeats, scores from 0 to 100 and under its caps, publishing only after a person's review without a fault."""
    lists = [facts.unique(r[c]).alias(c) for c in _LISTS]

    def with_claims(x: Column) -> Column:
        made, own = x["claims"], x["lists"]
        told = {f"{s}_claims": F.when(r[f"{s}_claims"].isNotNull(), own[f"{s}_claims"]).otherwise(claims.of_status(made, s)) for s in ("unsupported", "contradictory")}
        quality_score = whole_score(r["quality_score"])
        score = F.least(whole_score(F.coalesce(r["final_score"], quality_score.cast("double"))), F.when(quality_score == 0, 100).otherwise(quality_score), least_cap(own["caps"]))
        read = F.struct(made.alias("claims"), own.alias("lists"), *[c.alias(n) for n, c in told.items()], score.alias("score"))
        return text.bound(read, lambda y: _ordered(r, y))

    return F.when(r.isNotNull(), text.bound(F.struct(claims.cleaned(r["claims"]).alias("claims"), F.struct(*lists).alias("lists")), with_claims))


def _ordered(r: Column, y: Column) -> Column:
    human = F.coalesce(r["human_reviewed"], F.lit(False))
    clean = (F.size(y["lists"]["fatal_issues"]) == 0) & (F.size(y["unsupported_claims"]) == 0) & (F.size(y["contradictory_claims"]) == 0)
    score = y["score"]
    return F.struct(
        score.alias("quality_score"), whole_score(F.coalesce(r["rule_based_score"], r["quality_score"])).alias("rule_based_score"), *[whole_score(r[c]).alias(c) for c in ("source_coverage_score", "factual_grounding_score", "content_quality_score")], y["claims"].alias("claims"),
        *[(y[c] if c.endswith("_claims") else y["lists"][c]).alias(c) for c in _LISTS], F.coalesce(r["title_needs_rewrite"], F.lit(False)).alias("title_needs_rewrite"), human.alias("human_reviewed"), machine_review(r["machine"]).alias("machine"),
        (F.coalesce(r["publish_allowed"], F.lit(False)) & human & clean & (score >= PUBLISH)).alias("publish_allowed"),
        (F.coalesce(r["should_regenerate"], F.lit(False)) | (F.size(y["lists"]["fatal_issues"]) > 0) | (score < REGENERATE)).alias("should_regenerate"), quality.letter(score).alias("grade"),
    )


def merged(other: Column, own: Column) -> Column:
    """A normalised review from elsewhere merged into the review by rules: without a language model's reading it adds strengths, suggestions and titles only, and its own scores never count; with one, faults and caps join and the lesser score holds."""
    return text.bound(other, lambda o: text.bound(own, lambda w: _merged(o, w)))


def _replaced(own: Column, changed: dict[str, Column]) -> Column:
    return F.struct(*[changed.get(name, own[name]).alias(name) for name in FIELDS])


def _merged(other: Column, own: Column) -> Column:
    both = lambda c: facts.unique(F.concat(other[c], own[c]))

    def join(m: Column) -> Column:
        human = other["human_reviewed"] | own["human_reviewed"]
        faulty = F.size(m["fatal_issues"]) > 0
        clean = ~faulty & (F.size(m["unsupported_claims"]) == 0) & (F.size(m["contradictory_claims"]) == 0) & ~m["title_needs_rewrite"]
        score = F.least(own["quality_score"], other["machine"]["semantic_score"], least_cap(m["caps"]))
        out = {name: m[name] for name in (*_LISTS, "title_needs_rewrite")} | {"claims": claims.cleaned(F.concat(other["claims"], own["claims"])), "human_reviewed": human, "machine": other["machine"]}
        return text.bound(
            score, lambda s: _replaced(own, out | {"quality_score": s, "grade": quality.letter(s), "publish_allowed": own["publish_allowed"] & clean & human & (s >= PUBLISH), "should_regenerate": other["should_regenerate"] | own["should_regenerate"] | faulty | (s < REGENERATE)})
        )

    read = F.struct(*[both(c).alias(c) for c in _LISTS], (other["title_needs_rewrite"] | own["title_needs_rewrite"]).alias("title_needs_rewrite"))
    own_only = _replaced(own, {name: both(name) for name in ("strengths", "suggestions", "suggested_titles")})
    return F.when(other.isNull(), own).when(~other["machine"]["used_api"], own_only).otherwise(text.bound(read, join))


def with_machine(own: Column, payload: Column) -> Column:
    """The review by rules with a language model's payload (REVIEW): claims of one status and text are one, the later one; its score counts where it is above 0, under the caps of the rules."""
    return text.bound(own, lambda w: text.bound(payload, lambda p: _with_machine(w, p)))


def _with_machine(own: Column, payload: Column) -> Column:
    machine = machine_review(payload["machine"], ran=True)
    lists = {c: facts.unique(F.concat(own[c], facts.unique(payload[c]))) for c in ("fatal_issues", "warnings", "strengths", "suggestions")}
    keyed = F.transform(F.concat(own["claims"], claims.cleaned(payload["claims"])), lambda c, i: F.struct(F.concat_ws(":", c["status"], c["claim"]).alias("key"), i.alias("at"), c.alias("claim")))

    def last_of_each(cs: Column) -> Column:
        """The last claim of each key, in the order of the keys' first places. Sorted by key and place, a key's claims stand together."""
        ranked = F.array_sort(cs)
        edge = lambda xs, k, step: F.coalesce(F.get(xs, k + step)["key"] != F.get(xs, k)["key"], F.lit(True))

        def ends(xs: Column) -> Column:
            first = F.filter(F.transform(xs, lambda x, k: F.when(edge(xs, k, -1), x["at"])), lambda at: at.isNotNull())
            last = F.filter(F.transform(xs, lambda x, k: F.when(edge(xs, k, 1), x["claim"])), lambda c: c.isNotNull())
            return F.transform(F.array_sort(F.arrays_zip(first.alias("at"), last.alias("claim"))), lambda x: x["claim"])

        return text.bound(ranked, ends)

    def join(x: Column) -> Column:
        told = {f"{s}_claims": facts.unique(F.concat(own[f"{s}_claims"], facts.unique(payload[f"{s}_claims"]), claims.of_status(x["claims"], s))) for s in ("unsupported", "contradictory")}
        meant = F.when(x["machine"]["semantic_score"] > 0, x["machine"]["semantic_score"]).otherwise(100)
        read = F.struct(F.least(own["rule_based_score"], meant, least_cap(own["caps"])).alias("score"), *[c.alias(n) for n, c in (told | lists).items()])

        def settle(y: Column) -> Column:
            faulty = F.size(y["fatal_issues"]) > 0
            clean = ~faulty & (F.size(y["unsupported_claims"]) == 0) & (F.size(y["contradictory_claims"]) == 0)
            changed = {"quality_score": y["score"], "grade": quality.letter(y["score"]), "claims": x["claims"], "machine": x["machine"], "publish_allowed": own["publish_allowed"] & clean & (y["score"] >= PUBLISH), "should_regenerate": faulty | (y["score"] < REGENERATE)}
            return _replaced(own, changed | {n: y[n] for n in (*told, *lists)})

        return text.bound(read, settle)

    return text.bound(F.struct(text.bound(keyed, last_of_each).alias("claims"), machine.alias("machine")), join)
