"""A crawl's order: the pages that a queue would visit from its seeds, in the order in which it would, within budgets.

A queue visits level by level, and within a level by its parents' order and the links' places on their pages. So a page's rank is its depth and the path of
places that leads to it, which compare without numbering all pages in one task. Each level is one join of the last level's pages with the links, a minimum of paths for each
page, and an anti-join with what is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatorium.operators.graph import written

VISITED, OVER_RUN, OVER_SEED = "visited", "budget of the run", "budget of the seed"


def crawl(links: DataFrame, seeds: DataFrame, refused: Column | None = None, max_urls: int | None = None, max_per_seed: int | None = None, depth: int = 2) -> DataFrame:
    """(url, seed, found_on, depth, path, outcome) of every page that the queue meets.

    links: source, pos, target; seeds: url, place, and max_depth where a seed's own depth counts instead of `depth`. refused: an expression over `url` that gives the
    reason for which a page is left out, null for none. outcome: VISITED, that reason, or the budget that was used up before the page's turn; only visited pages are
    followed. A page that several links lead to counts at the first. Ordered by (depth, path), the visited pages come as from the queue.
    """
    reason = F.lit(None).cast("string") if refused is None else refused
    own = F.coalesce(F.col("max_depth"), F.lit(depth)) if "max_depth" in seeds.columns else F.lit(depth)
    start = seeds.select("url", F.col("url").alias("seed"), F.lit(None).cast("string").alias("found_on"), F.array(F.col("place").cast("long")).alias("path"), own.cast("int").alias("_most"))
    level, known, left, at = start, None, max_urls, 0
    while True:
        rows = level.groupBy("url").agg(F.min(F.struct("path", "seed", "found_on", "_most")).alias("first")).select("url", "first.*")
        if known is not None:
            rows = rows.join(known.select("url"), "url", "left_anti")
        rows = written(rows.select("*", F.lit(at).alias("depth"), reason.alias("_reason")))
        turn = rows.where("_reason is null")
        if max_per_seed is not None:
            used = known.where(F.col("outcome") == VISITED).groupBy("seed").agg(F.count("*").alias("_used")) if known is not None else None
            turn = turn.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("path")))
            turn = turn.join(used, "seed", "left") if used is not None else turn.withColumn("_used", F.lit(0))
            turn = turn.where(F.col("_n") + F.coalesce("_used", F.lit(0)) <= max_per_seed)
        within_seed = turn.select("url", F.lit(True).alias("_seed_ok"))
        chosen = turn.orderBy("path").limit(left) if left is not None else turn  # no more rows than the run's budget
        rows = rows.join(within_seed, "url", "left").join(chosen.select("url", F.lit(True).alias("_run_ok")), "url", "left")
        outcome = F.coalesce("_reason", F.when(F.col("_run_ok"), VISITED).when(F.col("_seed_ok"), OVER_RUN).otherwise(OVER_SEED))
        rows = written(rows.select("url", "seed", "found_on", "depth", "path", outcome.alias("outcome"), "_most"))
        known = rows if known is None else known.unionByName(rows)
        visited = rows.where(F.col("outcome") == VISITED)
        if left is not None:
            left -= visited.count()
        at += 1
        follow = visited.where(F.col("_most") >= at)
        if follow.isEmpty():
            return known.drop("_most")
        level = links.join(follow.withColumnRenamed("url", "source"), "source").select(F.col("target").alias("url"), "seed", F.col("source").alias("found_on"), F.concat("path", F.array(F.col("pos").cast("long"))).alias("path"), "_most")
