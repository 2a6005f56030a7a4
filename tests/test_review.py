"""Article review: planted articles with known faults, facts from pasted blocks, claims beside facts, and merged reviews."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatorium.operators import claims, facts, review

SOURCE = {"id": "source-1", "label": "松山市の公式ページ", "url": "https://www.city.matsuyama.example/reno", "checked_at": "2026年5月20日", "evidence": "タイトル:松山市店舗改装費補助金 機関:松山市産業課 上限:上限50万円 補助率:3分の1以内 締切:2026年9月30日"}
FACTS = {
    "article_type": "single_program", "official_name": "松山市店舗改装費補助金", "fiscal_year": "2026年", "administering_body": "松山市産業課", "application_start": "2026年5月1日", "application_deadline": "2026年9月30日", "subsidy_rate": "3分の1以内", "subsidy_cap": "上限50万円",
    "eligible_applicants": ["市内に店舗を持つ小規模事業者"], "eligible_expenses": ["内装工事費", "看板の製作費"], "ineligible_expenses": ["交付決定前に契約した経費"], "official_sources": [SOURCE],
}
INCENTIVE = {
    "article_type": "single_program", "program_kind": "incentive", "official_name": "西条市工場立地奨励金", "administering_body": "西条市", "application_deadline": "令和9年3月31日", "subsidy_cap": "投資額に応じて交付", "eligible_applicants": ["市内に工場を新設する法人"],
    "eligibility_conditions": ["新設した工場で操業を始めること"], "calculation_method": "投資額の区分による", "payment_conditions": ["操業開始の届出"], "official_sources": [SOURCE | {"label": "西条市", "url": "https://www.city.saijo.example/a", "evidence": "工場立地奨励金の対象者と立地要件、算定方法を定める市の公式情報です。"}],
}
SAID = (
    "市内の小規模事業者が使う松山市店舗改装費補助金は松山市産業課が実施機関で、対象者は市内に店舗を持つ小規模事業者、対象事業は店舗の改装、対象経費は内装工事費と看板の製作費です。補助率は3分の1以内、補助上限は上限50万円、申請締切は2026年9月30日です。"
    "交付決定前に契約した経費は対象外ですから、契約や発注の前に公募要領を確認してください。迷うときは商工会議所に相談できます。"
)
INCENTIVE_SAID = "市内に工場を新設する法人は、西条市の公式ページで立地要件と交付要件を確認し、投資額の区分による算定方法と申請条件を窓口で確かめてください。新設した工場で操業を始めることが交付条件です。愛媛県内の相談先として商工会議所もあります。"


def article(said: str, link: str, times: int = 40) -> str:
    parts = "".join(f"<h2>見出し{k}</h2><p>{said * (times // 10)}</p>" for k in range(10))
    tables = "".join(f"<table><tr><th>項目{k}</th><td>内容</td></tr></table>" for k in range(2))
    return f'<p>確認日 2026年5月20日 <a href="{link}">公式ページ</a></p>{tables}{parts}<h2>チェックリスト</h2><ul><li>要領を読む</li></ul><a href="/ehime-subsidy/">補助金を探す</a> <a href="/search?keyword=店舗">検索</a>'


GOOD = {"id": "good", "title": "松山市店舗改装費補助金｜2026年の補助率・上限額と申請前の確認", "content": article(SAID, SOURCE["url"]), "article_type": "single_program", "facts": FACTS, "human_reviewed": True}
ARTICLES = [
    GOOD,
    {"id": "bad", "title": "愛媛県の廃棄物処理業者向け補助金｜令和8年度の補助率・上限額", "content": "<h2>概要</h2><p>この補助金は廃棄物処理業者が設備投資に使える制度です。必ずもらえます。令和8年度においても実施されています。一定の補助率が適用されます。人件費は対象外です。</p>", "article_type": "column"},
    GOOD | {"id": "equal_yen", "content": GOOD["content"].replace("上限50万円", "上限500,000円")},
    GOOD | {"id": "other_yen", "content": GOOD["content"].replace("上限50万円", "上限80万円")},
    GOOD | {"id": "fiction", "content": GOOD["content"] + "<p>株式会社Bの導入効果は900万円でした。</p>"},
    GOOD | {"id": "unreviewed", "human_reviewed": None},
    GOOD | {"id": "astray", "content": GOOD["content"] + '<a href="/subsidy-list">一覧</a>'},
    GOOD | {"id": "memo", "content": GOOD["content"] + "<!-- qualityScore -->"},
    GOOD | {"id": "many_h2", "content": GOOD["content"] + "<h2>a</h2><h2>b</h2>"},
    GOOD | {"id": "one_table", "content": GOOD["content"].replace("<table>", "<div>", 1)},
    GOOD | {"id": "short", "content": article(SAID, SOURCE["url"], 10)},
    GOOD | {"id": "no_table", "content": GOOD["content"].replace("<table>", "").replace("<th>", "").replace("<td>", "")},
    GOOD | {"id": "other_date", "content": GOOD["content"].replace("2026年9月30日", "2026年12月1日")},
    {"id": "incentive", "title": "西条市工場立地奨励金の対象者と交付条件", "content": article(INCENTIVE_SAID, "https://www.city.saijo.example/a", 60), "article_type": "single_program", "facts": INCENTIVE, "human_reviewed": True},
    {"id": "null", "title": None, "content": None},
]


def frame(spark, rows):
    fields = T._parse_datatype_string(facts.FACTS)
    schema = T.StructType().add("id", "string").add("title", "string").add("content", "string").add("article_type", "string").add("human_reviewed", "boolean").add("facts", fields).add("category", "string").add("subsidies_text", "string").add("subsidy_id", "string")
    full = lambda f: None if f is None else {n: f.get(n) for n in fields.names}
    return spark.createDataFrame([tuple(full(r.get("facts")) if n == "facts" else r.get(n) for n in schema.names) for r in rows], schema)


@pytest.fixture(scope="module")
def reviews(spark):
    rows = review.reviewed(frame(spark, ARTICLES)).collect()
    server = review.reviewed(frame(spark, ARTICLES), "server").collect()
    return {r["id"]: r["review"] for r in rows}, {r["id"]: r["review"] for r in server}


def test_sound_article_may_be_published(reviews):
    r = reviews[0]["good"]
    assert (r.quality_score, r.grade, r.fatal_issues, r.warnings, r.caps, r.publish_allowed, r.should_regenerate, r.should_human_review) == (100, "A", [], [], [], True, False, True)
    assert (r.source_coverage_score, r.factual_grounding_score, r.unsupported_claims, r.contradictory_claims, r.title_needs_rewrite, r.missing_facts) == (100, 100, [], [], False, [])
    assert r.claims and {c.status for c in r.claims} == {"supported"} and len(r.strengths) == 7


def test_unfounded_article_is_refused(reviews):
    r = reviews[0]["bad"]
    assert r.quality_score == 0 and r.grade == "D" and not r.publish_allowed and r.title_needs_rewrite and r.should_regenerate and r.should_human_review
    assert len(r.suggested_titles) == 3 and all("廃棄物" in t for t in r.suggested_titles)
    assert {"対象経費の根拠がない", "対象外経費の根拠がない", "対象者・対象業種の根拠がない"} <= set(r.unsupported_claims) and review.LEAST_LENGTH > 100
    assert any("不足: 正式な制度名、実施機関、公式URL・根拠メモ" in m for m in r.fatal_issues) and any("断定する表現" in m for m in r.fatal_issues)
    assert "39点上限: タイトルの補助率・上限額・金額の約束に本文が答えていません。" in r.caps and r.content_quality_score == 0


def test_amounts_are_compared_in_yen(reviews):
    equal, other = reviews[0]["equal_yen"], reviews[0]["other_yen"]
    assert equal.unsupported_claims == [] and equal.contradictory_claims == [] and equal.quality_score == 100
    assert other.quality_score == 29 and len(other.contradictory_claims) == 1  # the claim itself names the right rate too


def test_caps_and_their_reasons(reviews):
    r = reviews[0]
    assert any("架空・仮名の事例が含まれています: 株式会社B" in c for c in r["fiction"].unsupported_claims) and r["fiction"].quality_score == 39
    assert (r["unreviewed"].quality_score, r["unreviewed"].publish_allowed, r["unreviewed"].caps) == (99, False, ["99点上限: 人間確認完了が確認できないため100点にはしません。"])
    assert r["astray"].quality_score == 59 and r["astray"].fatal_issues == ["存在しない可能性がある内部リンクがあります: /subsidy-list"]
    assert (r["memo"].quality_score, r["many_h2"].quality_score, r["one_table"].quality_score, r["no_table"].quality_score) == (39, 79, 79, 59)
    assert r["short"].quality_score == 79 and any(w.startswith("本文が1") and "4000文字以上" in w for w in r["short"].warnings)
    assert r["other_date"].quality_score == 39 and any("2026年12月" in c for c in r["other_date"].unsupported_claims)


def test_incentive_needs_no_expenses(reviews):
    r = reviews[0]["incentive"]
    assert r.quality_score >= 90 and r.fatal_issues == [] and r.article_type_label == "個別制度記事" and r.facts.program_kind == "incentive"


def test_null_article(reviews):
    r = reviews[0]["null"]
    assert r.quality_score == 4 and r.claims == [] and r.article_type == "feature" and any("本文が0文字です" in m for m in r.fatal_issues)


def test_server_profile(reviews):
    editor, server = reviews
    assert {k: r.quality_score for k, r in editor.items()} == {k: r.quality_score for k, r in server.items()}
    assert not editor["unreviewed"].publish_allowed and server["unreviewed"].publish_allowed
    assert "本文が1,500文字未満です。" in server["bad"].fatal_issues and "H2が10個未満です。" in server["bad"].warnings
    assert "公式ファクトが不足しています: officialSources、officialName、administeringBody、fundingDetails、applicationDeadline" in server["bad"].warnings
    assert len(server["bad"].suggestions) < len(editor["bad"].suggestions)


def test_facts_of_the_chosen_block(spark):
    blocks = "ID:12 | タイトル:制度12 | 機関:愛媛県 | 対象:県内事業者、法人 | 経費:設備費 | 補助率:2分の1以内 | 上限:100万円 | 締切:2026年8月1日 | 公式URL:https://a.example/12\n---\nID:123 | タイトル:制度123 | 機関:松山市 | 上限:200万円 | 公式URL:なし | 参考 https://b.example/123"
    rows = [("a", blocks, "12", "制度12の確認"), ("b", blocks, "123", ""), ("c", blocks, "1", ""), ("d", None, "12", "補助率のまとめ")]
    df = spark.createDataFrame(rows, "id string, subsidies_text string, subsidy_id string, title string").withColumn("kind", F.lit("single_program"))
    got = {r["id"]: r["f"] for r in df.select("id", facts.from_texts({"subsidies_text": F.col("subsidies_text"), "subsidy_id": F.col("subsidy_id"), "title": F.col("title"), "article_type": F.col("kind")}).alias("f")).collect()}
    a = got["a"]
    assert (a.official_name, a.subsidy_rate, a.subsidy_cap, a.application_deadline, a.eligible_applicants, a.eligible_expenses) == ("制度12", "2分の1以内", "100万円", "2026年8月1日", ["県内事業者", "法人"], ["設備費"])
    assert (a.official_sources[0].url, a.official_sources[0].label) == ("https://a.example/12", "制度12") and "https://a.example/12" not in a.official_sources[0].evidence and "制度12" in a.official_sources[0].evidence
    assert got["b"].official_name == "制度123" and got["b"].official_sources[0].url == "https://a.example/12"  # the first address pasted, as the block names none
    assert got["c"].official_name == "制度12"  # no block of this ID: the first
    assert got["d"].official_name == "" and got["d"].official_sources == [] and got["d"].unknown_fields == ["officialName", "administeringBody", "officialSources", "eligibleApplicants", "programDetails", "fundingDetails", "applicationDeadline"]


def test_readiness(spark):
    rows = [{"id": "full", "facts": FACTS}, {"id": "no_expense", "facts": FACTS | {"eligible_expenses": []}}, {"id": "incentive", "facts": INCENTIVE}, {"id": "loan", "facts": INCENTIVE | {"program_kind": "loan"}}, {"id": "thin", "facts": FACTS | {"official_sources": [SOURCE | {"evidence": "短い"}]}}, {"id": "none"}]
    got = {r["id"]: r["r"] for r in frame(spark, rows).select("id", facts.readiness(facts.normalised(F.col("facts"))).alias("r")).collect()}
    assert tuple(got["full"]) == (True, 100, []) and tuple(got["no_expense"]) == (False, 86, ["eligibleExpenses"]) and got["incentive"].ready and got["loan"].ready
    assert got["thin"].missing == ["officialSources"] and got["none"].score == 0 and got["none"].missing[-2:] == ["programDetails", "fundingDetails"]


def test_claim_table(spark):
    rows = review.measured(frame(spark, [GOOD, GOOD | {"id": "x", "content": "<p>補助上限は1,200千円で、受付期間は2027年4月から</p>"}])).withColumn("claims", F.col("_claims"))
    got = claims.table(rows, "id").where("id = 'x'").orderBy("place").collect()
    assert [(r["status"], r["yen"], r["months"]) for r in got[:2]] == [("unsupported", [1_200_000.0], []), ("unsupported", [], ["2027年4月"])]
    assert claims.table(rows, "id").where("id = 'good' and rate = '3分の1'").select("status").distinct().collect() == [("supported",)]


def test_filters_on_reviews(spark):
    """A filter on what a review says is no reason to write its expressions out again."""
    rows = review.reviewed(frame(spark, ARTICLES)).where("review.quality_score between 50 and 99 and size(review.caps) > 0").where("review.title_needs_rewrite = false")
    assert {r["id"] for r in rows.select("id").collect()} >= {"unreviewed", "astray", "many_h2", "one_table"}


OTHER = {"quality_score": 85.0, "final_score": 85.0, "strengths": ["整合しています。", ""], "human_reviewed": True, "machine": {"enabled": True, "used_api": True, "semantic_score": 85}}
PAYLOADS = [
    ("unread", {"quality_score": 0.0, "strengths": ["自己採点"], "machine": {"used_api": False}}), ("read", OTHER), ("capped", OTHER | {"machine": OTHER["machine"] | {"semantic_score": 99}, "caps": ["59点上限: 表がありません。", "79点上限: 他"], "warnings": ["w"]}),
    ("fault", OTHER | {"machine": OTHER["machine"] | {"semantic_score": 95}, "fatal_issues": ["f", "f"]}), ("claim", OTHER | {"claims": [{"claim": "c", "status": "unsupported"}, {"claim": "", "status": "x"}, {"claim": "d", "status": "odd"}]}), ("none", None),
]


def payloads(spark):
    fields = T._parse_datatype_string(review.REVIEW)

    def full(value, kind):
        if isinstance(kind, T.StructType) and value is not None:
            return {f.name: full(value.get(f.name), f.dataType) for f in kind.fields}
        return [full(v, kind.elementType) for v in value] if isinstance(kind, T.ArrayType) and value is not None else value

    schema = T.StructType().add("name", "string").add("other", fields)
    return spark.createDataFrame([(n, full(p, fields)) for n, p in PAYLOADS], schema)


def test_merged_reviews(spark, reviews):
    own = review.reviewed(frame(spark, [GOOD])).select("review")
    rows = payloads(spark).join(own, F.lit(True)).select("name", review.merged(review.normalised(F.col("other")), F.col("review")).alias("r"), review.normalised(F.col("other")).alias("n"))
    got = {r["name"]: (r["r"], r["n"]) for r in rows.collect()}
    assert got["none"][0].quality_score == 100 and got["none"][1] is None
    assert got["unread"][0].quality_score == 100 and got["unread"][0].publish_allowed and "自己採点" in got["unread"][0].strengths
    read = got["read"][0]
    assert (read.quality_score, read.grade, read.publish_allowed, read.machine.semantic_score, read.machine.factual_risk) == (85, "B", False, 85, review.NOT_REVIEWED) and read.strengths[0] == "整合しています。"
    assert got["capped"][0].quality_score == 59 and got["capped"][0].caps[0] == "59点上限: 表がありません。" and got["capped"][1].quality_score == 59
    assert got["fault"][0].quality_score == 95 and got["fault"][0].fatal_issues == ["f"] and got["fault"][0].should_regenerate and not got["fault"][0].publish_allowed
    assert got["claim"][0].unsupported_claims == ["c"] and [(c.claim, c.status) for c in got["claim"][0].claims[:2]] == [("c", "unsupported"), ("d", "unclear")]


def test_review_with_a_language_model(spark):
    own = review.reviewed(frame(spark, [GOOD])).select("review")
    rows = payloads(spark).where("other is not null").join(own, F.lit(True)).select("name", review.with_machine(F.col("review"), F.col("other")).alias("r"))
    got = {r["name"]: r["r"] for r in rows.collect()}
    assert got["unread"].quality_score == 100 and got["unread"].machine.used_api  # a score of 0 is none
    assert got["read"].quality_score == 85 and got["fault"].quality_score == 95 and not got["fault"].publish_allowed and got["claim"].unsupported_claims == ["c"]
    assert len({(c.status, c.claim) for c in got["claim"].claims}) == len(got["claim"].claims)
