"""Counters of a run, gathered while its rows are written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: What a crawl's log is counted for: rows by action, and sums of columns.
ACTIONS = {
    "publish": "publish", "would_publish": "would_publish", "reject": "reject", "review": "review", "noise": "noise", "errors": "error", "save_candidates": "save", "inserted": "insert", "updated": "update", "not_found_urls": "not_found", "already_existing_urls": "exists",
}
SUMS = ("parsed_pdf", "extracted_links", "external_candidates", "pdf_checked", "pdf_text_extracted", "pdf_ocr_attempted", "pdf_skipped_as_form")


def crawl_counters(columns) -> dict[str, Column]:
    """Aggregates of a crawl's log (action, depth, and what of SUMS it has): attempts, skips, errors, and each action."""
    action = F.col("action")
    found = {"attempted_urls": F.count_if(action != "skip"), "skipped_urls": F.count_if(action == "skip"), "error_urls": F.count_if(action.isin("error", "not_found"))}
    found |= {name: F.count_if(action == value) for name, value in ACTIONS.items()}
    return found | {name: F.coalesce(F.sum(F.col(name).cast("bigint")), F.lit(0).cast("bigint")) for name in SUMS if name in columns}


def observed(rows: DataFrame, counters: Mapping[str, Column], name: str = "run") -> tuple[DataFrame, Observation]:
    """rows, and what their counters come to once they have been written or counted; the rows are passed over once only."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def per_seed(rows: DataFrame, seed: str = "seed_url") -> DataFrame:
    """The counters of each seed, with its final address, status and redirection from the row of depth 0."""
    first = F.col("depth") == 0
    of_first = [F.max(F.when(first, F.col(c))).alias(c) for c in ("final_url", "status_code", "is_redirected") if c in rows.columns]
    return rows.groupBy(seed).agg(*[c.alias(n) for n, c in crawl_counters(rows.columns).items()], *of_first)
