"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its words and word pairs, hashed into BINS; a feature's value is its count over the root of the number of
n-grams, so a score is a sparse dot product. Training takes a bounded sample of labelled rows, dealt over SHARDS
independent learners whose weights are averaged; scoring reads every text in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatorium.llm import hashing

BITS = 18
MAX_TRAIN = 40_000  # rows that training reads, in the mean; all labelled rows where there are fewer
SHARDS = 8  # learners at most, each of SHARD_ROWS rows at least
SHARD_ROWS = 2000
PASSES = 4
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.002, 0.001
_PAIR = np.uint64(0x9FB21C651E98DF25)


def features(raw: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each n-gram, index of each text's first n-gram with the total at the end)."""
    words, first = hashing.words(raw, off)
    count = np.diff(first)
    pairs = np.maximum(count - 1, 0)
    begin = np.concatenate(([0], np.cumsum(count + pairs)))
    out = np.zeros(begin[-1], dtype=np.uint64)
    if len(words):
        place = np.arange(len(words)) + np.repeat(begin[:-1] - first[:-1], count)
        out[place] = words
        with np.errstate(over="ignore"):
            joint = hashing.mix(words[:-1] * _PAIR + words[1:])
        inner = np.ones(len(words), dtype=bool)
        inner[first[1:][count > 0] - 1] = False
        at = np.flatnonzero(inner)
        row = np.repeat(np.arange(len(count)), count)[at]
        out[begin[row] + count[row] + at - first[row]] = joint[at]
    return (out >> np.uint64(64 - bits)).astype(np.int64), begin


def _learn(passes: int, bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """FTRL-proximal over a shard's rows in the order of their hashes."""
        rows = rows.sort_values(["order", "doc_id"], kind="stable")
        size = 1 << bits
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        examples = []
        for first, raw, off in hashing.chunks(pa.array(rows["text"], pa.string())):
            bins, begin = features(raw, off, bits)
            for k in range(len(off) - 1):
                own, times = np.unique(bins[begin[k] : begin[k + 1]], return_counts=True)
                value = times / np.sqrt(max(1, begin[k + 1] - begin[k]))
                examples.append((np.append(own, size), np.append(value, 1.0), float(rows["quality"].iloc[first + k])))
        for _ in range(passes):
            for own, value, label in examples:
                zi, ni = z[own], n[own]
                root = np.sqrt(ni)
                w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
                p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
                g = (p - label) * value
                z[own] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
                n[own] = ni + g * g
        w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
        at = np.flatnonzero(w)
        return pd.DataFrame({"bin": at, "weight": w[at]})

    return run


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_TRAIN, shards: int = SHARDS, passes: int = PASSES) -> np.ndarray:
    """Weights of the 2**bits bins and the intercept, learnt from docs (doc_id, text) with labels (doc_id, quality 0 or 1).

    Labels that are null are left out; of several labels of a doc_id the lowest counts. Rows are sampled by a hash of doc_id. Without any labelled row all weights are 0.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = known.count()
    if not rows:
        return np.zeros((1 << bits) + 1)
    if rows > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * max_rows / rows))
    shards = max(1, min(shards, int(min(rows, max_rows) // SHARD_ROWS)))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # some max_rows rows of 12 bytes
    sample = sample.withColumn("order", F.xxhash64("doc_id", F.lit(6))).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)))
    learnt = sample.groupBy("shard").applyInPandas(_learn(passes, bits), "bin long, weight double")
    mean = learnt.groupBy("bin").agg((F.sum("weight") / shards).alias("weight")).toPandas()  # 2**bits + 1 rows at most
    weights = np.zeros((1 << bits) + 1)
    weights[mean["bin"].to_numpy()] = mean["weight"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with a column score, from 0 to 1: the chance of label 1. A null text is scored as an empty one. A column score of docs is replaced."""
    bits = int(np.log2(len(weights) - 1))
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # (2**bits + 1) * 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sums = []
            for _, raw, off in hashing.chunks(batch.column("text")):
                bins, begin = features(raw, off, bits)
                total = np.concatenate(([0.0], np.cumsum(table[bins], dtype=np.float64)))
                sums.append((total[begin[1:]] - total[begin[:-1]]) / np.sqrt(np.maximum(1, np.diff(begin))) + table[-1])
            margin = np.concatenate(sums) if sums else np.zeros(0)
            yield batch.append_column("score", pa.array(1 / (1 + np.exp(-margin))))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, by the modulus; -1 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1))


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learnt from the labels of rows not held out.

    held_out: crc32(doc_id) mod 3 is 1. Null and empty texts are scored by the intercept. A null doc_id is not held out and never learnt
    from. Rows that repeat a doc_id are scored each. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    weights = train(docs, labels.select("doc_id", "quality").where(remainder(3) != 1), max_rows=max_rows)
    rows = score(docs, weights)
    return rows.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
