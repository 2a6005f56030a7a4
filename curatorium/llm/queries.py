"""One query for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm import embedding_dedup, filter_audit, language_id, minhash_dedup, mixing, packing, periodic_runs, pii, quality, secrets, substring_dedup, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.base_spans(F.col("secrets"))
    number = [secrets.number(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *number, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("secrets")).alias("spans"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(_table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string")))
    return out.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), F.array_join(found, ",").alias("entities"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return out.select("doc_id", "n_passages", "n_words", text("passages").alias("passages"), text("repeats").alias("repeats"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    near = F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"].cast("string"), e["toxic"].cast("string")))
    return out.select("doc_id", "held_out", "score", "predicted", F.array_join(near, ",").alias("evidence"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by a hash of doc_id, go on periodically from one of their words. A null doc_id is left as it is."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", words.alias("words"), hashed.alias("h"), F.floor(hashed / 10).alias("g")).withColumn("n", F.size("words").cast("bigint"))
    rows = rows.withColumn("a", F.expr("g % nullif(n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    altered = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), altered).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.collapsed(_planted(_table(spark, sf_dir, "documents")))
    best = F.expr("get(array_sort(runs, (x, y) -> case when x.length <> y.length then if(x.length > y.length, -1, 1) when x.start <> y.start then if(x.start < y.start, -1, 1) else if(x.period < y.period, -1, if(x.period > y.period, 1, 0)) end), 0)")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scans, op2_quality_classifier, op3_minhash_near_dedup, op4_exact_topk, op5_packing, op6_embedding_near_dedup, op7_source_mixing, op8_language_id, op9_pii_surrogates, op10_substring_dedup, op11_toxicity, op12_filter_audit, op13_periodic_runs)
}
_REACHED = """reach(a, b) AS (SELECT a, a FROM (SELECT DISTINCT a FROM links) UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""
ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c.c >= 75 * (p.n + q.n - c.c)),
{_REACHED}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.b, d.doc_id) AS component_id, coalesce(least.b, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id""",
    "op6_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.x, y.x) >= 0.9),
{_REACHED}, many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(many.n, 0) AS n_links, coalesce(least.b, e.vec_id) AS component_id, coalesce(least.b, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN least ON least.a = e.vec_id LEFT JOIN many ON many.a = e.vec_id""",
    "op12_filter_audit": rf"""WITH RECURSIVE w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents)),
m AS (SELECT doc_id, part, (len(w) < 100)::INTEGER + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INTEGER + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INTEGER
  + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INTEGER AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o(filter_order, step, before, own) AS (SELECT '', 0, 0, 0 UNION ALL SELECT o.filter_order || f.letter, o.step + 1, o.before + o.own, f.bit FROM o JOIN f ON o.step < 5 AND (o.before + o.own) & f.bit = 0),
s AS MATERIALIZED (SELECT whole.filter_order, o.step, o.before, o.own FROM o JOIN o AS whole ON whole.step = 5 AND o.step > 0 AND whole.filter_order[1:o.step] = o.filter_order),
r AS MATERIALIZED (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS toxic_lost FROM c CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    "op4_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
}
