"""Logs of runs as text files: the newest of each kind, their last lines, and the counters that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatorium.operators import rules

NAMES = r"^(manual|weekly)-.*\.log\z"
#: The first expression that a log holds gives the counter.
COUNTERS = {
    "inserted": (r"(?i)inserted\s*[:：]\s*([0-9]+)", r"追加\s*[:：]\s*([0-9]+)"), "updated": (r"(?i)updated\s*[:：]\s*([0-9]+)", r"更新\s*[:：]\s*([0-9]+)"),
    "skipped": (r"(?i)skipped\s*[:：]\s*([0-9]+)", r"スキップ\s*[:：]\s*([0-9]+)"), "errors": (r"(?i)errors\s*[:：]\s*([0-9]+)", r"エラー\s*[:：]\s*([0-9]+)"),
}


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, kind, modified, at, line) of the log files in a folder; at orders a file's lines, in however many parts it is read. A line end at the end of a file begins no further line."""
    rows = spark.read.text(folder).select("value", "_metadata.file_name", "_metadata.file_modification_time", "_metadata.file_block_start")
    rows = rows.where(F.col("file_name").rlike(NAMES)).withColumn("at", F.struct("file_block_start", F.monotonically_increasing_id().alias("id")))
    return rows.select(F.col("file_name").alias("file"), F.regexp_extract("file_name", NAMES, 1).alias("kind"), F.col("file_modification_time").alias("modified"), "at", F.regexp_replace("value", "\r\\z", "").alias("line"))


def newest(rows: DataFrame) -> DataFrame:
    """The lines of each kind's newest file; of several as new, of the one whose name comes last."""
    last = rows.groupBy("kind").agg(F.max(F.struct("modified", "file"))["file"].alias("file"))
    return rows.join(last, ["kind", "file"], "left_semi")  # one row a kind


def tail(rows: DataFrame, n: int = 100) -> DataFrame:
    """The last n lines of each file, with their number from the end."""
    from_end = F.row_number().over(Window.partitionBy("file").orderBy(F.col("at").desc()))
    return rows.withColumn("from_end", from_end).where(F.col("from_end") <= n)


def summary(rows: DataFrame) -> DataFrame:
    """(file, inserted, updated, skipped, errors) of each file: the first number that its lines give for each counter, null where they give none."""
    firsts, of = [], {}
    for name, patterns in COUNTERS.items():
        of[name] = []
        for k, pattern in enumerate(patterns):
            hit = F.col("line").rlike(pattern)
            firsts.append(F.min_by(F.when(hit, F.regexp_extract("line", pattern, 1).cast("long")), F.when(hit, F.col("at"))).alias(f"_{name}{k}"))
            of[name].append(F.col(f"_{name}{k}"))
    return rows.groupBy("file").agg(*firsts).select("file", *[F.coalesce(*cs).alias(name) for name, cs in of.items()])


def line_class(line: Column) -> Column:
    """error, warning, success or info, by the first that a line's signs and words tell."""
    return rules.decision([(line.rlike("❌|エラー|失敗"), "error"), (line.rlike("⏭|スキップ|⚠️|警告"), "warning"), (line.rlike("✨|✅|成功|追加"), "success")], "info")
