"""Language identification by the nearest of several centroids.

A text is the TF-IDF vector of its hashed byte n-grams (one to four bytes, letters folded), of unit length. Each language has
CENTROIDS centroids, found by spherical k-means over a bounded sample of its rows; the language of the centroid with the largest
cosine is predicted. A text further from it than nearly all of that centroid's sample was is marked as
rejected. Document frequencies are counted over all rows learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.llm import hashing
from curatorium.llm.quality import remainder

BINS = 1 << 13
CENTROIDS = 4
ROUNDS = 8
MAX_SAMPLE = 1000  # rows of a language that its centroids are fitted on, in the mean
REJECT_QUANTILE = 0.005
UNKNOWN = "und"
_SCALE = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1) for k in range(1, 5)]

_LETTER = np.full(256, 32, dtype=np.uint8)  # digits, signs and white space are one separator
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray


def counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of n-gram counts for each text."""
    rows, n = len(off) - 1, len(raw)
    out = np.zeros(rows * BINS, dtype=np.int32)
    folded = _LETTER[raw].astype(np.uint64)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(off))
    with np.errstate(over="ignore"):
        held = np.zeros(n, dtype=np.uint64)
        for k in range(min(4, n)):
            m = n - k
            held = held[:m] + (folded[k:] + np.uint64(1)) * _SCALE[k]
            bins = (hashing.mix(held) >> np.uint64(64 - 13)).astype(np.int64)
            same = row[:m] == row[k:]
            out += np.bincount((row[:m] * BINS + bins)[same], minlength=len(out)).astype(np.int32)
    return out.reshape(rows, BINS)


def vectors(raw: np.ndarray, off: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(raw, off).astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(BINS, dtype=np.int64)
    for batch in batches:
        for _, raw, off in hashing.chunks(batch.column("text")):
            for a in range(0, len(off) - 1, 256):
                own = off[a : a + 257]
                seen += (counts(raw[own[0] : own[-1]], own - own[0]) > 0).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(seen)], names=["bin", "seen"])


def _cluster(idf: np.ndarray, k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means from the rows with the smallest hashes, spread by farthest-first choice."""
        rows = rows.sort_values(["order", "doc_id"], kind="stable")
        x = np.concatenate([vectors(raw, off, idf) for _, raw, off in hashing.chunks(pa.array(rows["text"], pa.string()))])
        centres = [x.mean(axis=0)]
        for _ in range(min(k, len(x)) - 1):
            centres.append(x[np.argmin(np.max(x @ np.array(centres).T / np.linalg.norm(centres, axis=1), axis=1))])
        centres = np.array(centres)
        for _ in range(ROUNDS):
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
            near = np.argmax(x @ centres.T, axis=1)
            centres = np.array([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        close = x @ centres.T
        near = np.argmax(close, axis=1)
        best = close[np.arange(len(x)), near]
        least = [float(np.quantile(best[near == j], REJECT_QUANTILE)) if (near == j).any() else 1.0 for j in range(len(centres))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "least": least, "centroid": [c.astype(np.float32).tobytes() for c in centres]})

    return run


def train(docs: DataFrame, max_sample: int = MAX_SAMPLE, centroids: int = CENTROIDS) -> Model:
    """A model from docs (doc_id, text, lang). Rows whose lang is null or whose text has no letter are left out. Languages are few: a row for each centroid goes to the driver."""
    docs = docs.select("doc_id", "text", "lang").where(r"lang is not null and text rlike '\\p{L}'")
    seen = docs.select("text").mapInArrow(_document_counts, "bin int, seen long").groupBy("bin").agg(F.sum("seen").alias("seen")).toPandas()  # BINS rows
    df = np.zeros(BINS)
    df[seen["bin"].to_numpy(dtype=np.int64)] = seen["seen"].to_numpy()
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)
    share = F.element_at(F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, int((1 << 30) * min(1.0, max_sample / n)))]), F.col("lang")) if sizes else F.lit(0)
    sample = docs.withColumn("order", F.xxhash64("doc_id", "text", F.lit(8))).where(F.pmod(F.col("order"), F.lit(1 << 30)) < share)
    found = sample.groupBy("lang").applyInPandas(_cluster(idf, centroids), "lang string, least double, centroid binary").orderBy("lang", "centroid").toPandas()
    centres = np.array([np.frombuffer(c, dtype=np.float32) for c in found["centroid"]]).reshape(-1, BINS)
    return Model(idf, list(found["lang"]), centres, found["least"].to_numpy(dtype=np.float64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of docs (doc_id, text).

    score is the cosine with the nearest centroid. A text that is null or has no letter gives `und`, 0 and true, as does every text where no language was learnt.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.langs, model.centroids, model.least))  # BINS * 4 bytes for each centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, learnt, centroids, lowest = shared.value
        langs = np.array([*learnt, UNKNOWN], dtype=object)
        for batch in batches:
            best, near = [], []
            for _, raw, off in hashing.chunks(batch.column("text")):
                for a in range(0, len(off) - 1, 256):
                    own = off[a : a + 257]
                    close = vectors(raw[own[0] : own[-1]], own - own[0], idf) @ centroids.T
                    at = np.argmax(close, axis=1) if learnt else np.zeros(len(own) - 1, np.int64)
                    near.append(at)
                    best.append(close[np.arange(len(at)), at] if learnt else np.zeros(len(at)))
            near = np.concatenate(near) if near else np.zeros(0, np.int64)
            best = np.clip(np.concatenate(best) if best else np.zeros(0), 0, 1).astype(np.float64)
            known = batch.column("has_letter").to_numpy(zero_copy_only=False) & bool(learnt)
            least = np.append(lowest, 1.0)[near]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.where(known, langs[near], UNKNOWN), pa.string()), pa.array(np.where(known, best, 0.0)), pa.array(~known | (best < least))],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of docs (doc_id, text, lang), learnt from rows not held out.

    held_out: crc32(doc_id) mod 4 is 2. A null doc_id is not held out; its row may be learnt from. Rows that repeat a doc_id are judged
    each. An empty table gives no rows.
    """
    model = train(docs.where(remainder(4) != 2))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
