"""Mixture-controlled packing of documents into token sequences.

Every source is a queue of its documents' tokens. A deficit round-robin with a quantum of QUANTUM tokens serves the queues:
each service adds a queue's weight to its credit, and the queue furthest behind its target is served next.
For fixed weights that order has a closed form: a quantum whose middle is the queue's token m is due at time m / w. So the stream of all
queues is the quanta in the order of their times, deficits carried over from window to window and partition to partition, whatever the number
of queues. Each queue is put off by up to half a quantum, by its hash, or many small queues would all be due at once. Times are cut into buckets of about as many tokens each; with the tokens in each bucket known, every bucket's place in
the stream is, and buckets are sorted and cut into windows of `window` tokens apart from one another.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatorium.llm import hashing
from curatorium.llm.shared import written

WINDOW = 4096
QUANTUM = 256
END = 2
BUCKET_TOKENS = 4_000_000
MOST_BUCKETS = 100_000  # with so many, buckets hold more tokens each
MAX_BROADCAST_ROWS = 200_000  # of the table of offsets (40 bytes a row); a larger one is joined by a shuffle
NO_SHARE = 1e-9  # a queue of target 0 comes after all others
_PARTS_KEPT, _CHARS_KEPT = 400_000, 1 << 24
_CHUNK = 1 << 23

#: Latin letters and then ASCII signs but the apostrophe: the ids are those of the letters in lower case and those of the signs.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
_TOKENS = "doc_id long, queue long, task int, start long, doc_tokens long, ids binary"
_PIECE = "bucket long, due double, queue long, low long, doc_id long, start long, doc_tokens long, ids binary"


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of start[k], ..., start[k] + count[k] - 1, in the order of k."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of whole texts by a vocabulary file.

    Where the vocabulary drops white space, ASCII white space always ends a token and no normalisation crosses it. Then a batch's words are told apart
    by Arrow, most are letters followed by signs, and a part met before is not encoded again; ids are put together by numpy.
    Texts are encoded whole with any other vocabulary.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.by_words = self._ids(" Ab\tb, 1\n") == [i for x in ("Ab", "b,", "1") for i in self._ids(x)]
        # The same model behind simpler steps, for parts: lower case already, parted by spaces.
        self.parts = Tokenizer(self.tokenizer.model)
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain = self.by_words and all(
            self._ids(a + b) == self.parts.encode(f"{a.lower()} {b}", add_special_tokens=False).ids and int(self.last[self._ids(a + b)].sum()) == 2 for a, b in (("Ab", ".,"), ("ÀÖØÞßöøÿ", "!#$%&()*+"), ("Zq", "-./:;<=>?@[\\]^_`{|}~"))
        )
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.chars = 0
        self.begin, self.count, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, self.kind)

    def _add(self, new: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(new, range(len(self.begin), len(self.begin) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(counts) - counts))
        self.count, self.ids = np.concatenate((self.count, counts)), np.concatenate((self.ids, ids.astype(self.kind)))

    def _single(self, new: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        self._add(new, np.array([len(x) for x in found], dtype=np.int64), np.array([i for x in found for i in x], dtype=np.int64))

    def _places(self, parts: pa.Array, plain: bool) -> np.ndarray:
        """The number of each part among the known ones; new ones are encoded."""
        texts = parts.to_pylist()
        at = np.fromiter((self.known.get(x, -1) for x in texts), dtype=np.int64, count=len(texts))
        new = [texts[k] for k in np.flatnonzero(at < 0)]
        if new and plain:
            found = self.parts.encode_batch_fast([" ".join(new[k : k + 64]) for k in range(0, len(new), 64)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype=np.int64) for e in found])
            ends = np.flatnonzero(self.last[ids]) + 1
            self._add(new, np.diff(ends, prepend=0), ids)
        elif new:
            self._single(new)
        if new:
            at[at < 0] = np.arange(len(self.begin) - len(new), len(self.begin))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with END behind it; how many each text has)."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        if not self.by_words:
            found = [[*e.ids, END] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in found for i in x], dtype=self.kind), np.array([len(x) for x in found], dtype=np.int64)
        if len(self.known) > _PARTS_KEPT or self.chars > _CHARS_KEPT:
            self._clear()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        halves = np.zeros((len(words.dictionary), 2), dtype=np.int64)
        some = pc.extract_regex(words.dictionary, _PLAIN) if self.plain else pa.nulls(len(words.dictionary), pa.struct([("letters", pa.string()), ("signs", pa.string())]))
        odd = some.is_null().to_numpy(zero_copy_only=False)
        for k, part in enumerate((pc.utf8_lower(pc.struct_field(some, "letters")), pc.struct_field(some, "signs"))):
            part = part.filter(pa.array(~odd)).dictionary_encode()
            halves[~odd, k] = self._places(part.dictionary, True)[part.indices.to_numpy()]
        halves[odd, 0] = self._places(words.dictionary.filter(pa.array(odd)), False)
        pair = halves.ravel()
        table = self.ids[_ragged(self.begin[pair], self.count[pair])]
        long = self.count[halves].sum(axis=1)
        first, index = np.cumsum(long) - long, words.indices.to_numpy()
        ids = table[_ragged(first[index], long[index])]
        before = np.concatenate(([0], np.cumsum(long[index])))
        edge = before[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return np.insert(ids, edge[1:], END), np.diff(edge) + 1


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker, which keeps what it has learnt from task to task."""
    return Encoder(path)


def _binary(ends: np.ndarray, data: bytes) -> pa.Array:
    """Values that lie in `data` one after the other, up to each of `ends`."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes()), pa.py_buffer(data)])


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        task, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            for first, _, off in hashing.chunks(batch.column("text"), _CHUNK, batch.num_rows):
                part = batch.slice(first, len(off) - 1)
                ids, tokens = own.encode(part.column("text"))
                starts = []
                for queue, n in zip(part.column("queue").to_pylist(), tokens.tolist(), strict=True):
                    starts.append(before.get(queue, 0))
                    before[queue] = starts[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("queue"), pa.array([task] * len(tokens), pa.int32()), pa.array(starts, pa.int64()), pa.array(tokens), _binary(np.cumsum(tokens) * own.kind.itemsize, ids.tobytes())],
                    names=["doc_id", "queue", "task", "start", "doc_tokens", "ids"],
                )

    return run


def _quanta(quantum: int, groups: list[tuple[float, float]], buckets: int, whole: bool):
    """Documents cut into their queues' quanta, each with its time and bucket; without `whole`, only the tokens in each bucket.

    groups: (tokens, end) of queues that end at one time; the tokens served until a time follow from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, weight = batch.column("doc_tokens").to_numpy(), batch.column("weight").to_numpy()
            begin = batch.column("start").to_numpy() + batch.column("base").to_numpy()
            count = (begin + tokens - 1) // quantum - begin // quantum + 1
            row = np.repeat(np.arange(len(tokens)), count)
            n = _ragged(begin // quantum, count)
            low, high = np.maximum(n * quantum, begin[row]), np.minimum((n + 1) * quantum, (begin + tokens)[row])
            total = batch.column("total").to_numpy()[row]
            off = (hashing.mix(batch.column("queue").to_numpy().view(np.uint64)) >> np.uint64(11)).astype(np.float64)[row] / (1 << 53) - 0.5
            due = ((n * quantum + np.minimum((n + 1) * quantum, total)) / 2 + off * np.minimum(quantum, total)) / weight[row]
            served = sum(t * np.minimum(1.0, due / end) for t, end in groups) / sum(t for t, _ in groups)
            bucket = np.minimum((served * buckets).astype(np.int64), buckets - 1)
            if not whole:
                own, at = np.unique(bucket, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, high - low).astype(np.int64))], names=["bucket", "tokens"])
                continue
            ids = batch.column("ids").cast(pa.binary())
            _, off, data = ids.buffers()
            off = np.frombuffer(off, dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            width = (off[1] - off[0]) // tokens[0]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(due), batch.column("queue").take(take), pa.array(low), batch.column("doc_id").take(take), pa.array(low - begin[row]), pa.array(tokens[row]), _binary(np.cumsum(high - low) * width, data[off[0] : off[-1]])],
                names=["bucket", "due", "queue", "low", "doc_id", "start", "doc_tokens", "ids"],
            )

    return run


def _cut(first: np.ndarray, base: np.ndarray, window: int, width: int):
    """Pieces in the order of (bucket, due, queue, low) to their places; first and base: the buckets in use and the place of each one's first token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("ids").cast(pa.binary())
            _, off, data = ids.buffers()
            off = np.frombuffer(off, dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            flat = memoryview(np.frombuffer(data, dtype=f"<u{width}", count=(off[-1] - off[0]) // width, offset=off[0]).astype("<u4")).cast("B")
            length, bucket, start = np.diff(off) // width, batch.column("bucket").to_numpy(), batch.column("start").to_numpy()
            total = np.cumsum(length)
            new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            inside = total - length - np.repeat((total - length)[new], np.diff(np.append(new, len(bucket))))
            inside += np.where(bucket == last, done, 0)
            last, done = int(bucket[-1]), int(inside[-1] + length[-1])
            at = base[np.searchsorted(first, bucket)] + inside
            low, edge = total - length, (at // window + 1) * window - at
            over = np.flatnonzero(edge < length)
            row = np.sort(np.concatenate((np.arange(len(at)), over)))
            second = np.concatenate(([False], row[1:] == row[:-1]))
            cut = np.where(second, edge[row], 0)
            end = np.where(~second & (edge < length)[row], edge[row], length[row])
            a, b = ((low[row] + x).tolist() for x in (cut, end))
            sums = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(a, b, strict=True)]
            place, take = at[row] + cut, pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), pa.array(start[row] + cut), pa.array(end - cut), pa.array(sums, pa.int64()), batch.column("doc_tokens").take(take), pa.array(place // window), pa.array(place % window)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM, vocabulary: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of docs (doc_id, text, source; others are ignored).

    targets: share of tokens wanted for each source while its queue lasts; sources without one, and all sources where it is None, get
    a share by their size, so that all queues end together. Only the last sequence is short. A null or empty text is
    its end id alone. A null source is a source. Rows that repeat a doc_id, or have none, are packed each. An empty table gives no rows.
    """
    spark, quantum, path = docs.sparkSession, min(quantum, window), vocabulary or default_vocabulary()
    rows = docs.select("doc_id", "text", F.xxhash64("source").alias("queue"))
    tokens = written(rows.mapInArrow(_tokenise(path), _TOKENS))
    parts = written(tokens.groupBy("queue", "task").agg(F.sum("doc_tokens").alias("n")))
    wanted = spark.createDataFrame([(s, float(w)) for s, w in (targets or {}).items()], "source string, share double")
    wanted = wanted.groupBy(F.xxhash64("source").alias("queue")).agg(F.greatest(F.sum("share"), F.lit(NO_SHARE)).alias("share"))
    totals = parts.groupBy("queue").agg(F.sum("n").alias("total")).join(F.broadcast(wanted), "queue", "left")  # a row for each target
    named = [(r["total"], r["share"]) for r in totals.where("share is not null").select("total", "share").collect()]  # likewise
    everything = parts.agg(F.sum("n")).first()[0] or 0
    rest = everything - sum(n for n, _ in named)
    free = max(1 - sum(w for _, w in named), NO_SHARE)
    groups = [(float(n), n / w) for n, w in named] + ([(float(rest), rest / free)] if rest else [])
    weights = totals.select("queue", "total", F.coalesce("share", F.col("total") * F.lit(free / max(1, rest))).alias("weight"))
    before = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = written(parts.select("queue", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(weights, "queue"))
    placed = tokens.join(F.broadcast(base) if base.count() <= MAX_BROADCAST_ROWS else base, ["queue", "task"])
    buckets = max(1, min(MOST_BUCKETS, -(-everything // BUCKET_TOKENS)))
    sizes = placed.select("queue", "start", "base", "total", "weight", "doc_tokens").mapInArrow(_quanta(quantum, groups, buckets, False), "bucket long, tokens long")
    sizes = sorted((r["bucket"], r["tokens"]) for r in sizes.groupBy("bucket").agg(F.sum("tokens").alias("tokens")).collect())  # MOST_BUCKETS rows at most
    first, held = np.array([b for b, _ in sizes], dtype=np.int64), np.array([n for _, n in sizes], dtype=np.int64)
    quanta = placed.select("doc_id", "queue", "start", "base", "total", "weight", "doc_tokens", "ids").mapInArrow(_quanta(quantum, groups, buckets, True), _PIECE)
    stream = quanta.repartition(buckets, "bucket").sortWithinPartitions("bucket", "due", "queue", "low")
    cut = _cut(first, np.cumsum(held) - held, window, encoder(path).kind.itemsize)
    return stream.select("bucket", "doc_id", "start", "doc_tokens", "ids").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
