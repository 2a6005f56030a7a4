"""Tables written to the folder all executors share, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one set as the checkpoint folder. On one machine a folder of this process will do; on a cluster, whose executors would each write to a disk of their own, an unset folder is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="curatorium-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/curatorium/{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Delete the tables that this application has written; results that read them must have been saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: a cut in the lineage that survives lost executors and has size statistics."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Collect what nothing refers to any more: Spark deletes the shuffle files of a written table's query only once the driver's objects for it are collected, which a long query would otherwise leave to chance."""
    gc.collect()
    spark._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): one row (id, component) for each end of a link, with the smallest id reachable.

    Every round takes the smallest label among neighbours and then the label of that label, so labels travel in
    doubling steps; it ends when a round changes nothing. Self-links and nulls are dropped.
    """
    links = links.where("a <> b").select("a", "b")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        low = written(low)
        step = low.join(low.select(F.col("id").alias("low"), F.col("low").alias("component")), "low").select("id", "component", "was")
        step = written(step)
        labels = step.select("id", "component")
        if step.where("component <> was").isEmpty():
            return labels
