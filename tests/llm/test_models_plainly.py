"""Learnt models against the same arithmetic in plain loops over Python numbers."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import functions as F

from curatorium.llm import hashing, language_id, quality

SMALL = "/root/testdata/sf0.001"
FULL = (1 << 64) - 1


def mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & FULL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & FULL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & FULL
    return x ^ (x >> 31)


def word_hash(word: bytes) -> int:
    return mixed((sum(mixed(b) * pow(hashing._BASE, k, 1 << 64) for k, b in enumerate(word)) + len(word)) & FULL)


def bins(text: str | None, bits: int = quality.BITS) -> list[int]:
    words = [word_hash(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())]
    pairs = [mixed((a * int(quality._PAIR) + b) & FULL) for a, b in zip(words, words[1:], strict=False)]
    return [x >> (64 - bits) for x in words + pairs]


def example(text: str | None) -> dict[int, float]:
    found = bins(text)
    return {b: found.count(b) / math.sqrt(max(1, len(found))) for b in set(found)} | {1 << quality.BITS: 1.0}


def test_quality_equals_plain_loops(spark):
    """One learner's follow-the-regularised-leader updates, and scores as sums over a text's n-grams."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    got = quality.train(docs, labels, shards=1, passes=2)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", F.xxhash64("doc_id", F.lit(6)).alias("order")).orderBy("order", "doc_id").collect()
    assert len(rows) > 50
    z, n = {}, {}

    def weight(b):
        if abs(z.get(b, 0.0)) <= quality.L1:
            return 0.0
        return -(z[b] - math.copysign(quality.L1, z[b])) / ((quality.BETA + math.sqrt(n.get(b, 0.0))) / quality.ALPHA + quality.L2)

    examples = [(example(r["text"]), r["quality"]) for r in rows]
    for _ in range(2):
        for x, label in examples:
            w = {b: weight(b) for b in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[b] * v for b, v in x.items())))))
            for b, v in x.items():
                g, before = (p - label) * v, n.get(b, 0.0)
                z[b] = z.get(b, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / quality.ALPHA * w[b]
                n[b] = before + g * g
    want = np.zeros(len(got))
    for b in z:
        want[b] = weight(b)
    assert np.abs(got - want).max() < 1e-9 and np.count_nonzero(want) > 500
    for r in quality.score(docs, got).limit(60).collect():
        margin = sum(float(np.float32(got[b])) * v for b, v in example(r["text"]).items())
        assert abs(r["score"] - 1 / (1 + math.exp(-margin))) < 1e-6


def test_language_equals_plain_cosines(spark):
    """Predictions as the largest cosine of TF-IDF vectors made n-gram by n-gram."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(docs)
    short = docs.select("doc_id", F.substring("text", 1, 300).alias("text"))
    texts = {r["doc_id"]: r["text"] for r in short.limit(40).collect()}
    assert len(model.langs) >= 4
    for r in language_id.predict(short, model).collect():
        if not (text := texts.get(r["doc_id"])) or r["lang_pred"] == "und":
            continue
        raw, count = [int(language_id._LETTER[b]) for b in text.encode()], {}
        for k in range(1, 5):
            for i in range(len(raw) - k + 1):
                held = sum((raw[i + j] + 1) * int(language_id._SCALE[j]) for j in range(k)) & FULL
                b = mixed(held) >> (64 - 13)
                count[b] = count.get(b, 0) + 1
        x = {b: math.log1p(c) * float(model.idf[b]) for b, c in count.items()}
        long = math.sqrt(sum(v * v for v in x.values()))
        close = [sum(v * float(c[b]) for b, v in x.items()) / long for c in model.centroids]
        assert abs(max(close) - r["score"]) < 1e-4 and (r["lang_pred"] == model.langs[int(np.argmax(close))] or sorted(close)[-1] - sorted(close)[-2] < 1e-4)
