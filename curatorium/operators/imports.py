"""Records of a subsidy feed brought to the portal's rows: one for each round of application of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions import dates, expenses, lexicon, money, regions, status, text
from curatorium.operators import dedupe

#: Fields that a round may state anew, and their names in the feed.
OVERRIDDEN = ("target_area_search", "target_area_detail", "acceptance_start_datetime", "acceptance_end_datetime", "project_end_deadline", "target_expense", "subsidy_rate", "subsidy_max_limit")
ROUND = "struct<id:string,fiscal_year_round:string," + ",".join(f"{c}:string" for c in OVERRIDDEN) + ",detail:string>"
FRONT = "https://www.jgrants-portal.go.jp/subsidy/"
NO_INDUSTRY = "業種指定無し"


def _filled(*cs: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(text.first_present(*cs), F.lit(""))


def rounds(details: DataFrame) -> DataFrame:
    """One row for each round of each record (workflow: array of ROUND), with `round` and its `number` from 1; a record without rounds has one, all empty."""
    none = F.array(F.lit(None).cast(ROUND))
    whole = F.when(F.size("workflow") > 0, F.col("workflow").cast(f"array<{ROUND}>")).otherwise(none)
    return details.where(F.coalesce(F.col("id"), F.lit("")) != "").select("*", F.posexplode(whole).alias("number", "round")).withColumn("number", F.col("number") + 1)


def normalised(details: DataFrame, now: Column) -> DataFrame:
    """The portal's rows of a feed's records (all texts, with workflow, search_area and search_keyword of the search that found them); rounds whose place the region gate rejects are left out. now: the instant that decides the status."""
    rows = rounds(details)
    of = {c: _filled(F.col(f"round.{c}"), F.col(c)) for c in OVERRIDDEN}
    area = F.array_join(F.filter(F.array(of["target_area_search"], of["target_area_detail"]), lambda x: x != ""), " / ")
    rows = rows.withColumns(
        {
            "title": text.without_html(_filled(F.col("title"), F.lit("名称不明"))), "organization": text.without_html(F.col("institution_name")),
            "region_raw": _filled(area, F.col("search_area"), F.lit(lexicon.UNKNOWN)), "round_id": _filled(F.col("round.id"), F.col("round.fiscal_year_round"), F.concat(F.lit("workflow-"), F.col("number"))),
            "fiscal_year": text.without_html(_filled(F.col("round.fiscal_year_round"), F.col("fiscal_year"))),
            **{f"own_{c}": x for c, x in of.items()},
        }
    )
    rows = rows.withColumn("gate", regions.gate(F.col("region_raw"), F.col("title"), F.col("organization"), F.col("search_keyword"))).where("gate.keep")
    start, end, finish = (F.try_to_timestamp(F.nullif(F.col(f"own_{c}"), F.lit(""))) for c in ("acceptance_start_datetime", "acceptance_end_datetime", "project_end_deadline"))
    rows = rows.withColumns({"start_at": start, "end_at": end, "project_end_at": finish})
    parts = ("title", "organization", "region_raw", "subsidy_catch_phrase", "detail", "round.detail", "target_expense", "round.target_expense", "subsidy_rate", "round.subsidy_rate", "subsidy_max_limit", "round.subsidy_max_limit")
    rows = rows.withColumn("prose", text.without_html(F.array_join(F.filter(F.array(*[F.col(c) for c in parts]), lambda x: x != ""), "\n")))
    rows = rows.withColumn("period", dates.period_text(F.to_date("start_at"), F.to_date("end_at")))
    limit = money.of_all_digits(F.col("own_subsidy_max_limit"))
    rows = rows.withColumns(
        {
            "amount_max_yen": F.when(limit > 0, limit).otherwise(money.labelled(F.col("prose"))),
            "subsidy_rate_text": expenses.rate(F.col("own_subsidy_rate"), F.col("prose")),
            "target_expenses": F.when(F.col("own_target_expense") != "", expenses.items(F.col("own_target_expense"))).otherwise(expenses.known(F.col("prose"))),
            "municipality": regions.first_contained(F.col("region_raw"), lexicon.MUNICIPALITIES), "purposes": text.listed(F.col("use_purpose"), "/,、，\n"), "industries": text.listed(F.col("industry"), "/,、，\n"),
            "searched": F.contains(F.coalesce("search_keyword", F.lit("")), F.lit("愛媛")) | text.any_contained(F.coalesce("search_keyword", F.lit("")), lexicon.MUNICIPALITIES),
        }
    )
    region = F.when((F.col("region_raw") == lexicon.UNKNOWN) & F.col("searched"), F.lit("愛媛県")).otherwise(F.col("region_raw"))
    titled = F.when((F.col("fiscal_year") != "") & ~F.contains("title", F.col("fiscal_year")), F.concat("title", F.lit("（"), "fiscal_year", F.lit("）"))).otherwise(F.col("title"))
    industries = F.when(F.size("industries") > 0, F.col("industries")).otherwise(F.array(F.lit(NO_INDUSTRY)))
    staff = text.without_html(F.col("target_number_of_employees"))
    url = _filled(F.col("front_subsidy_detail_page_url"), F.concat(F.lit(FRONT), F.url_encode("id")))
    first, last = (F.date_format(c, "yyyy-MM-dd") for c in ("start_at", "end_at"))
    key = dedupe.import_key(F.col("organization"), titled, F.col("fiscal_year"), F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")))
    source = F.concat_ws(":", "id", "round_id")
    return rows.select(
        titled.alias("title"), "organization", region.alias("region_text"),
        F.when(region.rlike("愛媛|四国") | (F.col("municipality") != "") | F.col("searched"), F.lit("愛媛県")).otherwise(F.lit("全国")).alias("prefecture"), "municipality",
        status.by_instants(F.col("start_at"), F.col("end_at"), F.col("period"), now).alias("application_status"), F.col("period").alias("application_period_text"),
        first.alias("application_start_date"), last.alias("application_end_date"), money.display(F.col("amount_max_yen")).alias("amount_text"), "amount_max_yen", "subsidy_rate_text", "target_expenses",
        F.when(staff != "", F.array(F.concat(F.lit("対象従業員数："), staff))).otherwise(F.array().cast("array<string>")).alias("target_entities"), "purposes", industries.alias("industries"),
        F.array_distinct(F.concat("purposes", industries)).alias("tags"), url.alias("official_url"), "fiscal_year", text.without_html(_filled(F.col("detail"), F.col("subsidy_catch_phrase"))).alias("summary"),
        source.alias("source_external_id"), "project_end_at", F.col("gate.reason").alias("keep_reason"), key.alias("dedupe_key"),
    )
