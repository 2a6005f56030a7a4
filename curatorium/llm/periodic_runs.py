"""Periodic runs of words, found with a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of words that repeats with a smallest period q, over at least MIN_WORDS words and MIN_TIMES * q, and that no
neighbouring word extends. All words of such a stretch occur at least MIN_TIMES times in it, so a word that is rarer ends every run and
the automaton is built over the stretches between rare words only. Two end positions that become neighbours in a state's set are
d words apart and the words before them agree for the state's length exactly; where d is not more than that length a square is found. Its left end
is maximal by the state's length; the right end is extended word by word.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

MIN_WORDS, MIN_TIMES = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_CHUNK = 512  # positions held in one piece of an ordered set
_OUT_BYTES = 8 << 20  # texts returned in one batch
_ROUNDS = 4  # times that rare words cut a text; more cuts would save work but never change a result


class Ends:
    """An ordered set of positions in pieces of at most 2 * _CHUNK, so that a member of a long set is put in by moving a short piece."""

    __slots__ = ("heads", "parts")

    def __init__(self, first: int):
        self.heads, self.parts = [first], [[first]]

    def near(self, x: int) -> tuple[int | None, int | None]:
        """The members before and after x, which is none itself."""
        k = bisect(self.heads, x) - 1
        if k < 0:
            return None, self.heads[0]
        part = self.parts[k]
        i = bisect(part, x)
        return part[i - 1], part[i] if i < len(part) else self.heads[k + 1] if k + 1 < len(self.heads) else None

    def add(self, x: int) -> None:
        k = max(bisect(self.heads, x) - 1, 0)
        part = self.parts[k]
        insort(part, x)
        self.heads[k] = part[0]
        if len(part) > 2 * _CHUNK:
            self.parts[k : k + 1] = [part[:_CHUNK], part[_CHUNK:]]
            self.heads[k : k + 1] = [part[0], part[_CHUNK]]


def _stretches(words: Sequence[Hashable]) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) without a word that occurs in them fewer than MIN_TIMES times: every run lies in one of them."""
    waiting = [(0, len(words), 0)]
    while waiting:
        lo, hi, rounds = waiting.pop()
        if hi - lo < MIN_WORDS:
            continue
        own = words[lo:hi]
        count = Counter(own)
        rare = {w for w, n in count.items() if n < MIN_TIMES}
        if not rare or rounds == _ROUNDS:
            yield lo, hi
            continue
        begin = lo
        for at, w in enumerate(own, lo):
            if w in rare:
                if at - begin >= MIN_WORDS:
                    waiting.append((begin, at, rounds + 1))
                begin = at + 1
        waiting.append((begin, hi, rounds + 1))


def _automaton(words: Sequence[Hashable]) -> tuple[list[int], list[int], list[int]]:
    """(link, length, end position or -1 for a copied state) of each state of the suffix automaton."""
    step, link, length, end = [{}], [-1], [0], [-1]
    last = 0
    for at, w in enumerate(words):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(at)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(-1)
                link[q] = link[new] = copy
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
        last = new
    return link, length, end


def _in_stretch(words: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one stretch."""
    link, length, end = _automaton(words)
    n, held, found = len(words), {}, {}
    farthest = n // MIN_TIMES  # no run has a longer period

    def square(i: int, j: int, agree: int) -> None:
        d, start = j - i, i - agree + 1
        if d <= agree and d <= farthest and (start, d) not in found:
            stop = j + 1
            while stop < n and words[stop] == words[stop - d]:
                stop += 1
            found[start, d] = stop

    for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        u = link[v]
        mine = held.pop(v, None)
        if u == 0:
            continue  # nothing agrees at the root
        mine = mine or (1, Ends(end[v]))
        theirs = held.get(u) or ((1, Ends(end[u])) if end[u] >= 0 else None)
        if theirs is None:
            held[u] = mine
            continue
        (few, small), (many, large) = sorted((mine, theirs), key=lambda x: x[0])
        agree = length[u]
        moved = [x for part in small.parts for x in part]
        for x in moved:
            before, after = large.near(x)
            if before is not None:
                square(before, x, agree)
            if after is not None:
                square(x, after, agree)
        for x in moved:
            large.add(x)
        held[u] = (few + many, large)
    least = {}
    for (start, d), stop in found.items():
        least[start, stop] = min(d, least.get((start, stop), d))
    return [(start, stop - start, d) for (start, stop), d in least.items() if stop - start >= max(MIN_WORDS, MIN_TIMES * d)]


def runs(words: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start, then period."""
    out = [(lo + start, length, period) for lo, hi in _stretches(words) for start, length, period in _in_stretch(words[lo:hi])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words: Sequence[bytes], found: list[tuple[int, int, int]]) -> Sequence[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    out, done = [], 0
    for lo, hi in sorted((start + period, start + length) for start, length, period in found):
        if lo > done:
            out += words[done:lo]
        done = max(done, hi)
    return out + list(words[done:])


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of docs (doc_id, text): the runs of its words, and its words with one period kept of each run, joined by one space.

    Words are what ASCII white space parts. A null, empty or blank text has no runs and collapses to an empty text. Rows are independent of each other: repeated
    rows and ties give equal results, a null doc_id stays null, other columns are not read, an empty table gives no rows. Memory is
    bounded by one batch of rows and a small multiple of the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, texts, first, held = batch.column("doc_id"), [], [], 0, 0
            column = batch.column("text").cast(pa.large_binary())
            for row in range(batch.num_rows):
                words = (column[row].as_py() or b"").split()
                own = runs(words)
                text = b" ".join(kept(words, own))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                texts.append(text)
                held += len(text)
                if held > _OUT_BYTES or row == batch.num_rows - 1:
                    typed = pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([ids.slice(first, row + 1 - first), typed, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])
                    found, texts, first, held = [], [], row + 1, 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")
