"""Toxicity by the nearest labelled examples, with the examples as evidence.

Texts are TF-IDF vectors, of unit length, over the words that tell the labels apart (by the chi-square statistic of the examples); document
frequencies count all documents. The nearest examples by cosine are found exactly with a block-max inverted index: examples lie in blocks, each
word knows its largest weight in each block, and blocks whose bound cannot reach the nearest so far are left. Neighbours vote with weights
that fall with their distance, and the vote is calibrated by isotonic regression on the examples' own votes, each without itself.
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
from curatorium.llm.shared import written

MAX_EXAMPLES = 20_000  # labelled rows that become examples, in the mean; all where there are fewer
WORDS = 2048  # words at most that span the vectors
LEAST_CHI, LEAST_SEEN = 15.0, 3  # a word's chi-square statistic and number of examples, at least
LIFT = 3.0  # times the general share of toxic examples that the share among a word's own must be: long texts hold more of every word, and more of them are toxic
NEAREST = 15
BLOCK = 64  # examples in a block of the index
NEAR = 0.1  # distance at which a neighbour's weight has halved
DOUBT = 0.5  # weight of the general share of toxic examples in each vote
PREDICT = 0.7
EVIDENCE = "array<struct<doc_id:bigint,cosine:double,toxic:int>>"
_SLACK = 1e-9  # bounds and cosines are sums in different orders

_LETTER = np.full(256, 32, dtype=np.uint8)  # ASCII digits and signs part words
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word)."""
    hashes, first = hashing.words(_LETTER[raw], off)
    return hashes, np.repeat(np.arange(len(off) - 1), np.diff(first))


class Vocabulary:
    """The words of the vectors by hash, and their inverse document frequencies."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray | None = None):
        self.hashes, self.idf = hashes, idf

    def places(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, count) of every word of the vocabulary in each row, by row, then word."""
        if not len(self.hashes):
            return (np.zeros(0, np.int64),) * 3
        found, row = words(raw, off)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        known = self.hashes[at] == found
        pairs, times = np.unique(row[known] * len(self.hashes) + at[known], return_counts=True)
        return pairs // len(self.hashes), pairs % len(self.hashes), times

    def vectors(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place of each row with the total at the end, word, weight) of unit vectors."""
        row, word, times = self.places(raw, off)
        weight = (1 + np.log(times)) * self.idf[word] if len(word) else np.zeros(0)
        begin = np.searchsorted(row, np.arange(len(off)))
        long = np.sqrt(np.add.reduceat(np.append(weight * weight, 0.0), begin[:-1])) if len(off) > 1 else np.zeros(0)
        return begin, word, weight / long[row] if len(word) else weight


@dataclass
class Index:
    """Block-max inverted index of examples, in blocks of BLOCK examples alike."""

    doc_id: np.ndarray
    toxic: np.ndarray
    start: np.ndarray  # place of the first posting of each (word, block); one more block closes each word
    example: np.ndarray  # of each posting, by word, then example
    weight: np.ndarray
    most: np.ndarray  # largest weight of each (word, block)

    @classmethod
    def of(cls, size: int, doc_id: list[int], toxic: list[int], word: list[np.ndarray], weight: list[np.ndarray]) -> Index:
        # Examples with the same heaviest word stand together, so that a block's largest weights are near its usual ones.
        order = sorted(range(len(doc_id)), key=lambda i: (int(word[i][np.argmax(weight[i])]), -float(weight[i].max()), doc_id[i]))
        ids, labels = (np.array([x[i] for i in order], dtype=np.int64) for x in (doc_id, toxic))
        example = np.repeat(np.arange(len(order)), [len(word[i]) for i in order])
        flat, heavy = (np.concatenate([x[i] for i in order]) if order else np.zeros(0) for x in (word, weight))
        blocks, flat = -(-len(order) // BLOCK), flat.astype(np.int64)
        by_word = np.lexsort((example, flat))
        flat, heavy, example = flat[by_word], heavy[by_word], example[by_word]
        start = np.searchsorted(flat * (blocks + 1) + example // BLOCK, np.arange(size * (blocks + 1)))
        most = np.zeros((size, blocks))
        np.maximum.at(most, (flat, example // BLOCK), heavy)
        return cls(ids, labels, start.reshape(size, blocks + 1), example, heavy, most)

    def nearest(self, word: np.ndarray, weight: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k examples with the largest cosines above 0, ties to the smaller doc_id; the example `without` takes no part."""
        bound = weight @ self.most[word]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score = np.zeros(self.most.shape[1] * BLOCK)
        by_block = score.reshape(-1, BLOCK)
        best, floor, done, step = np.zeros(0), 0.0, 0, 4
        while done < len(order) and bound[order[done]] >= floor - _SLACK:
            taken = order[done : done + step]
            taken = np.sort(taken[bound[taken] >= floor - _SLACK])
            for t, w in zip(word.tolist(), weight.tolist(), strict=True):
                first = self.start[t, taken]
                long = self.start[t, taken + 1] - first
                at = np.arange(long.sum()) + np.repeat(first - np.cumsum(long) + long, long)
                score[self.example[at]] += w * self.weight[at]
            if without is not None:
                score[without] = 0.0
            best = np.concatenate((best, by_block[taken].ravel()))
            if len(best) > k:
                best = np.partition(best, -k)[-k:]
                floor = best[0]
            done, step = done + len(taken), 2 * step
        found = np.flatnonzero(score)
        found = found[np.lexsort((self.doc_id[found], -np.round(score[found], 9)))][:k]
        return found, score[found]


@dataclass
class Model:
    vocabulary: Vocabulary
    index: Index
    share: float  # of toxic examples among all
    plain: float  # chance of a text without any word of the vocabulary
    votes: np.ndarray  # calibration: chances[i] holds from votes[i] on
    chances: np.ndarray

    def vote(self, example: np.ndarray, cosine: np.ndarray) -> float:
        weight = NEAR / (NEAR + 1 - np.minimum(cosine, 1.0))
        return float((weight @ self.index.toxic[example] + DOUBT * self.share) / (weight.sum() + DOUBT))

    def chance(self, vote: float) -> float:
        return float(self.chances[max(0, np.searchsorted(self.votes, vote, side="right") - 1)]) if len(self.votes) else vote


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from which vote, chance) of the least-squares chances that never fall as the vote rises. Each step is drawn to the general share by one example."""
    order = np.argsort(votes, kind="stable")
    value, first, last = votes[order], np.flatnonzero(np.r_[True, np.diff(votes[order]) > 0]), None
    total = np.add.reduceat(labels[order].astype(float), first)
    count = np.diff(np.r_[first, len(value)]).astype(float)
    steps = []  # (vote, sum, count)
    for v, s, n in zip(value[first], total, count, strict=True):
        steps.append((v, s, n))
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            (v0, s0, n0), (_, s1, n1) = steps[-2:]
            steps[-2:] = [(v0, s0 + s1, n0 + n1)]
    share = float(labels.mean())
    chances = np.array([(s + share) / (n + 1) for _, s, n in steps])
    return np.array([v for v, _, _ in steps]), np.maximum.accumulate(chances)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the two smallest hashes of their five-word shingles as one number."""
    for batch in batches:
        sketch = [s[[0, min(1, len(s) - 1)]] if len(s) else np.zeros(2, np.uint64) for s in hashing.shingle_sets(batch.column("text"))]
        low = np.array(sketch, dtype=np.uint64).reshape(-1, 2)
        yield batch.append_column("sketch", pa.array(hashing.mix(low[:, 0] ^ hashing.mix(low[:, 1])).view(np.int64)))


def _examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows, or of a sample by a hash of doc_id.

    Copies would lend each other's words a weight that no other text bears out, so rows of equal sketches are one example: the smallest doc_id's, toxic where half of them are.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = known.count()
    if rows > max_examples:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * max_examples / rows))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # some max_examples rows of 12 bytes
    rows = rows.mapInArrow(_sketches, "doc_id long, text string, toxic int, sketch long")
    return rows.groupBy("sketch").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text"))["text"].alias("text"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for first, raw, off in hashing.chunks(batch.column("text")):
            found, row = words(raw, off)
            order = np.lexsort((found, row))
            found, row = found[order], row[order]
            new = np.r_[True, (found[1:] != found[:-1]) | (row[1:] != row[:-1])] if len(found) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(found[new].view(np.int64)), pa.array(toxic[first + row[new]].astype(np.int64))], names=["word", "toxic"])


def _telling_words(examples: DataFrame) -> np.ndarray:
    """Hashes of the words whose presence tells toxic examples from others; WORDS rows at most go to the driver."""
    sizes = examples.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n, t = float(sizes["n"]), float(sizes["toxic"])
    if not 0 < t < n:
        return np.zeros(0, np.uint64)
    seen = examples.select("text", "toxic").mapInArrow(_word_sets, "word long, toxic long").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= LEAST_SEEN)
    away = F.col("t") * (n - t) - (F.col("n") - F.col("t")) * t  # t(n-t) times the difference of the shares
    chi = n * away * away / (t * (n - t) * F.col("n") * F.greatest(F.lit(n) - F.col("n"), F.lit(1.0)))
    telling = F.col("t") * n >= F.col("n") * min(LIFT * t, 0.5 * (n + t))
    best = seen.where(telling).select("word", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.col("chi").desc(), "word").limit(WORDS).toPandas()
    return np.sort(best["word"].to_numpy(dtype=np.int64).view(np.uint64))


def _document_frequency(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value.hashes)
        seen = np.zeros(size + 1, dtype=np.int64)  # the last counts the documents
        for batch in batches:
            seen[size] += batch.num_rows
            for _, raw, off in hashing.chunks(batch.column("text")):
                seen[:size] += np.bincount(shared.value.places(raw, off)[1], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(seen)], names=["place", "seen"])

    found = docs.select("text").mapInArrow(run, "place long, seen long").groupBy("place").agg(F.sum("seen").alias("seen")).toPandas()  # WORDS + 1 rows
    seen = np.zeros(len(vocabulary.hashes) + 1)
    seen[found["place"].to_numpy(dtype=np.int64)] = found["seen"].to_numpy()
    return int(seen[-1]), seen[:-1]


def _example_vectors(examples: DataFrame, vocabulary: Vocabulary) -> pd.DataFrame:
    """(doc_id, toxic, word, weight) of the examples that hold a word of the vocabulary. MAX_EXAMPLES short vectors in the mean."""
    shared = examples.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, off in hashing.chunks(batch.column("text")):
                begin, word, weight = shared.value.vectors(raw, off)
                lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x)) for x in (word, weight)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, len(off) - 1) for c in ("doc_id", "toxic")] + lists, names=["doc_id", "toxic", "word", "weight"])

    rows = examples.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, word array<long>, weight array<double>")
    return rows.where("size(word) > 0").toPandas().sort_values(["doc_id", "toxic"], kind="stable")


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """A model from docs (doc_id, text) with labels (doc_id, toxic 0 or 1), where docs may hold more rows than have labels: they count in the document frequencies.

    Labels that are null are left out; of several labels of a doc_id the highest counts. Without examples of both kinds every text gets the same chance.
    """
    examples = written(_examples(docs, labels, max_examples))  # read several times; some max_examples texts
    vocabulary = Vocabulary(_telling_words(examples))
    size = len(vocabulary.hashes)
    many, seen = _document_frequency(docs, vocabulary) if size else (0, np.zeros(0))
    vocabulary.idf = np.log((1 + many) / (1 + seen)) + 1
    totals = examples.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    share = totals["toxic"] / max(1, totals["n"])
    if not size:
        empty = Index.of(0, [], [], [], [])
        return Model(vocabulary, empty, share, share, np.zeros(0), np.zeros(0))
    found = _example_vectors(examples, vocabulary)
    index = Index.of(size, found["doc_id"].tolist(), found["toxic"].tolist(), *([np.asarray(x) for x in found[c]] for c in ("word", "weight")))
    plain = (totals["toxic"] - int(found["toxic"].sum()) + share) / (totals["n"] - len(found) + 1)
    model = Model(vocabulary, index, share, plain, np.zeros(0), np.zeros(0))
    model.votes, model.chances = isotonic(*_own_votes(examples, model))
    return model


def _own_votes(examples: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(vote, label) of each example of the index by its nearest others."""
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, place = shared.value, {int(d): i for i, d in enumerate(shared.value.index.doc_id)}
        for batch in batches:
            votes, own = [], []
            for first, raw, off in hashing.chunks(pa.array(batch["text"], pa.string())):
                begin, word, weight = model.vocabulary.vectors(raw, off)
                for k in range(len(off) - 1):
                    a, b = begin[k], begin[k + 1]
                    if b > a:
                        votes.append(model.vote(*model.index.nearest(word[a:b], weight[a:b], NEAREST, place[int(batch["doc_id"].iloc[first + k])])))
                        own.append(int(batch["toxic"].iloc[first + k]))
            yield pd.DataFrame({"vote": votes, "toxic": own})

    rows = examples.select("doc_id", "text", "toxic").mapInPandas(run, "vote double, toxic int").toPandas().sort_values(["vote", "toxic"], kind="stable")
    return rows["vote"].to_numpy(dtype=float), rows["toxic"].to_numpy(dtype=int)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence) of every row of docs (doc_id, text): the chance of label 1, and the nearest examples behind it, the nearest first.

    A text without any word of the vocabulary, null and empty ones included, has no neighbours and gets the share of toxic ones among such examples.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS words, MAX_EXAMPLES short vectors, and a bound for each word and block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            scores, evidence = [], []
            for _, raw, off in hashing.chunks(batch.column("text")):
                begin, word, weight = model.vocabulary.vectors(raw, off)
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    near, cosine = model.index.nearest(word[a:b], weight[a:b], NEAREST) if b > a else ((), ())
                    scores.append(model.chance(model.vote(near, cosine)) if len(near) else model.plain)
                    evidence.append([{"doc_id": int(model.index.doc_id[i]), "cosine": float(c), "toxic": int(model.index.toxic[i])} for i, c in zip(near, cosine, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, evidence {EVIDENCE}")


def judged(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of docs, learnt from the labels of rows not held out.

    held_out: crc32(doc_id) mod 3 is 1. A null doc_id is not held out and never learnt from. Rows that repeat a doc_id are scored each; all of them
    are examples where it is labelled. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    model = train(docs, labels.select("doc_id", "toxic").where(remainder(3) != 1), max_examples)
    rows = score(docs, model)
    return rows.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "evidence")
