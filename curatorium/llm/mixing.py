"""Mixing sources to target weights by Poisson replication.

A source of n rows and target share s of the mixed rows is repeated s * total / n times in the mean. Each row draws its count from the
Poisson distribution of that mean by inverting it at a number in [0, 1) hashed from the seed, doc_id and text, so that
a lost task draws the same counts again. Rows are exploded by their counts and dealt over all partitions by a
hash, then ordered by it: a global shuffle without a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20240229
MAX_BROADCAST_SOURCES = 100_000
CHUNK = 1000  # copies of a row that are made at a time
_TWO53 = float(1 << 53)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(_TWO53)


def poisson_terms(mean: Column) -> Column:
    """struct(low, terms): probabilities of low, low + 1, ... of the Poisson distribution, out to 12 deviations (below 1e-25 lies outside). Terms are formed in logarithms."""
    low = F.greatest(F.lit(0), F.floor(mean - 12 * F.sqrt(mean)))
    high = F.ceil(mean + 12 * F.sqrt(mean) + 24)
    terms = F.transform(F.sequence(low, high), lambda k: F.exp(k * F.ln(mean) - mean - _ln_factorial(k)))
    return F.when(mean > 0, F.struct(low.alias("low"), terms.alias("terms")))


def poisson_draw(table: Column, u: Column) -> Column:
    """The smallest k with P(X <= k) > u, from poisson_terms of the mean; 0 where the mean is 0."""
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0).cast("bigint").alias("k"))
    found = F.aggregate(table["terms"], start, lambda a, t: F.struct((a["p"] + t).alias("p"), (a["k"] + (a["p"] + t <= u).cast("bigint")).alias("k")))
    return F.coalesce(table["low"] + F.least(found["k"], F.size(table["terms"]) - 1), F.lit(0).cast("bigint"))


def _ln_factorial(k: Column) -> Column:
    """ln k!, by Stirling's series on k + 1 shifted up by 8 (error below 1e-12)."""
    x = k.cast("double") + 9.0
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    shift = F.lit(0.0)
    for j in range(1, 9):
        shift = shift + F.ln(k.cast("double") + float(j))
    return series - shift


def rates(docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(source, n_rows, rate): mean repetitions that bring each source to its share of as many rows as docs has. Sources not in targets get none; without targets all get the same share."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_rows"))
    whole = sizes.agg(F.sum("n_rows").alias("rows"), F.count("*").alias("sources")).first()
    if targets is None:
        sizes = sizes.withColumn("share", F.lit(1.0 / max(1, whole["sources"])))
    else:
        total = sum(targets.values())
        table = docs.sparkSession.createDataFrame([(s, w / total) for s, w in targets.items()], "name string, share double")
        sizes = sizes.join(table, F.col("source").eqNullSafe(F.col("name")), "left").drop("name").fillna(0.0, "share")
    return sizes.select("source", "n_rows", (F.col("share") * (whole["rows"] or 0) / F.col("n_rows")).alias("rate"))


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """docs with each row repeated by its draw, in a global random order, with columns replica (from 0), rate and mix_key added (columns of docs so named, and _of, _terms, _count and _first, are replaced).

    A null source is a source. A row whose doc_id or text is null is drawn by what it has. Equal rows draw equal counts. An empty
    table gives no rows.
    """
    docs = docs.drop("replica", "rate", "mix_key", "_of", "_terms", "_count", "_first")
    table = rates(docs, targets).select(F.col("source").alias("_of"), "rate", poisson_terms(F.col("rate")).alias("_terms"))
    known = docs.select("source").distinct().limit(MAX_BROADCAST_SOURCES + 1).count()
    rated = docs.join(F.broadcast(table) if known <= MAX_BROADCAST_SOURCES else table, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    count = poisson_draw(F.col("_terms"), uniform(F.lit(seed), F.col("doc_id"), F.col("text")))
    drawn = rated.withColumn("_count", count).drop("_terms").where("_count > 0").withColumn("_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1, F.lit(CHUNK).cast("bigint"))))
    if (table.agg(F.max("rate")).first()[0] or 0) > CHUNK:  # rows with many chunks: these are dealt out before they become copies
        drawn = drawn.repartition(F.xxhash64("doc_id", "text", "_first"))
    drawn = drawn.withColumn("replica", F.explode(F.sequence("_first", F.least(F.col("_first") + CHUNK, F.col("_count")) - 1))).drop("_count", "_first")
    keyed = drawn.withColumn("mix_key", F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text"), F.col("replica")))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")
