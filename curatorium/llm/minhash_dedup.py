"""MinHash near-duplicate documents by fast similarity sketching.

Each text's set of five-word shingles is put into SKETCH bins in rounds: in round i every shingle falls into the bin
its i-th hash names, and only bins still empty take the round's smallest value; from round SKETCH on, round i fills bin
i - SKETCH from all shingles, so every coordinate fills after at most 2 * SKETCH rounds. A coordinate agrees for two sets with
a probability equal to their Jaccard similarity. BANDS bands of SKETCH / BANDS coordinates name buckets; pairs that meet in
a bucket are confirmed on their full shingle sets.

Texts with equal sets are one class before banding. Every class is first compared with the smallest class (the lead) of each of its buckets, and
the links so confirmed are closed to components. Classes that share a bucket share its lead, so what is left to compare are members of
one lead's group that lie in different components; a group meets in pairs of blocks, each in a task group of its own, which
returns links only. Jaccard distance is a metric, so members whose distances from the lead differ by more than the
allowed distance are not compared. No pair inside one component is needed for the result, and no pair across components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.llm import hashing
from curatorium.llm.shared import components, forest, written

WIDTH = 5
PERCENT = 75
SKETCH = 128
BLOCK = 512  # members of a group that meet in a task, and their shingles
BLOCK_SHINGLES = 400_000
BANDS = 32  # of 4 coordinates: a pair of similarity 0.75 meets in no bucket with probability (1 - 0.75**4)**32 < 1e-5

_BIN_SHIFT = np.uint64(64 - 7)
_SEEDS = hashing.mix(np.arange(2 * SKETCH, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_COLUMN = hashing.mix(np.arange(100, 100 + SKETCH // BANDS, dtype=np.uint64)) | np.uint64(1)
_BAND = hashing.mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))


def sketch(values: np.ndarray) -> np.ndarray:
    """The SKETCH coordinates of a non-empty set of 64-bit hashes."""
    out = np.zeros(SKETCH, dtype=np.uint64)
    empty = np.ones(SKETCH, dtype=bool)
    left, i = SKETCH, 0
    many = len(values) > 24
    while left and i < SKETCH:
        if many:
            drawn = np.sort(hashing.mix(values ^ _SEEDS[i]))
            bins = (drawn >> _BIN_SHIFT).astype(np.int64)
            first = np.ones(len(bins), dtype=bool)
            first[1:] = bins[1:] != bins[:-1]
            bins, drawn = bins[first], drawn[first]
            new = empty[bins]
            bins, drawn = bins[new], drawn[new]
            out[bins] = drawn + _SEEDS[i]
            empty[bins] = False
            left -= len(bins)
            i += 1
            continue
        drawn = hashing.mix(values[None, :] ^ _SEEDS[:SKETCH, None])  # all rounds of a small set at once
        bins = (drawn >> _BIN_SHIFT).astype(np.int64)
        rounds = np.repeat(np.arange(SKETCH), len(values))
        order = np.lexsort((drawn.ravel(), rounds, bins.ravel()))
        flat = bins.ravel()[order]
        first = np.ones(len(flat), dtype=bool)
        first[1:] = flat[1:] != flat[:-1]
        out[flat[first]] = drawn.ravel()[order][first] + _SEEDS[rounds[order][first]]
        empty[flat[first]] = False
        break
    for j in np.flatnonzero(empty):
        out[j : j + 1] = hashing.mix(values ^ _SEEDS[SKETCH + j]).min(keepdims=True) + _SEEDS[SKETCH + j]
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            size, low, high, bands = [], [], [], []
            for values in hashing.shingle_sets(batch.column("text"), WIDTH):
                size.append(len(values))
                low.append(hashing.mix(values ^ np.uint64(11)).sum(dtype=np.uint64).view(np.int64))
                high.append(hashing.mix(values ^ np.uint64(17)).sum(dtype=np.uint64).view(np.int64))
                if len(values):
                    rows = sketch(values).reshape(BANDS, -1)
                    bands.append(hashing.mix((rows * _COLUMN).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64))
                else:
                    bands.append(np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n_shingles", "low", "high", "bands"],
            )


def _common(left: np.ndarray, right: np.ndarray) -> int:
    small, large = (left, right) if len(left) < len(right) else (right, left)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(large) else 0


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b), neighbours often sharing a, to (a, b, distance, linked) by the full sets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column("a").to_pylist(), batch.column("text_a")
        news = [k for k, x in enumerate(ids) if not k or x != ids[k - 1]]
        lefts = hashing.shingle_sets(texts.take(pa.array(news, pa.int64())), WIDTH)
        distance, linked, last, left = [], [], None, None
        for a, right in zip(ids, hashing.shingle_sets(batch.column("text_b"), WIDTH), strict=True):
            if left is None or a != last:
                last, left = a, next(lefts)
            common = _common(left, right)
            union = len(left) + len(right) - common
            distance.append(1 - common / max(1, union))
            linked.append(common > 0 and 100 * common >= PERCENT * union)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(distance), pa.array(linked, pa.bool_())], names=["a", "b", "distance", "linked"])


def _across(key: tuple, table: pa.Table) -> pa.Table:
    """Links that connect members of different components within a block of a group, or in its blocks left and right."""
    _, left, right = (x.as_py() for x in key)
    sets = list(hashing.shingle_sets(table.column("text").combine_chunks(), WIDTH))
    ids, component, main, distance, block = (table.column(c).to_numpy() for c in ("id", "component", "main", "distance", "block"))
    size = np.array([len(x) for x in sets])
    vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    owner, start = owner[order], np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
    begin = np.concatenate(([0], np.cumsum(size)))
    slack = 1 - PERCENT / 100 + 1e-9
    a, b = [], []
    for x in np.flatnonzero(component != main):
        near = (component != component[x]) & (np.abs(distance - distance[x]) <= slack) & (100 * np.minimum(size, size[x]) >= PERCENT * np.maximum(size, size[x]))
        near &= (block == right) if block[x] == left else (block == left)
        near &= (component == main) | (ids > ids[x])
        if not near.any():
            continue
        own = code[begin[x] : begin[x + 1]]
        count = start[own + 1] - start[own]
        at = np.repeat(start[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for y in np.flatnonzero(near & (100 * common >= PERCENT * (size + size[x] - common))):
            a.append(ids[x])
            b.append(ids[y])
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    keep = forest(a, b)
    return pa.table({"a": pa.array(a[keep]), "b": pa.array(b[keep])})


def _rest(grouped: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """Links across components in the groups (lead, id, distance, n_shingles) of the leads."""
    placed = grouped.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.join(found.select(F.col("id").alias("lead"), F.col("component").alias("main")), "lead", "left").withColumn("main", F.coalesce("main", "lead"))
    placed = written(placed)
    away = F.col("component") != F.col("main")

    def blocks(which):
        return F.ceil(F.greatest(F.count_if(which) / BLOCK, F.sum(F.when(which, F.col("n_shingles"))) / BLOCK_SHINGLES)).cast("int")

    few = (F.count("*") <= BLOCK) & (F.sum("n_shingles") <= BLOCK_SHINGLES)  # one block holds the whole group
    sizes = placed.groupBy("lead").agg(F.count("*").alias("members"), few.alias("few"), blocks(away).alias("apart"), F.when(few, 0).otherwise(F.coalesce(blocks(~away), F.lit(0))).alias("rest"))
    sizes = sizes.where("apart > 0 and members > 1").drop("members")
    rows = placed.join(sizes, "lead")  # members apart have blocks of their own; only these meet others, so the rest are sent to few
    own = F.when(F.col("few"), 0).when(away, F.pmod(F.xxhash64("id"), F.col("apart"))).otherwise(F.col("apart") + F.pmod(F.xxhash64("id"), F.greatest("rest", F.lit(1))))
    rows = rows.withColumn("block", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("apart") + F.when(away, F.col("rest")).otherwise(0) - 1)))
    rows = rows.select("lead", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "id", "component", "main", "distance").join(texts, "id")
    return written(rows.groupBy("lead", "left", "right").applyInArrow(_across, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id, text; other columns are ignored).

    Null and empty texts, and texts of white space, have n_shingles 0 and stand alone. A text of one to four words has one
    shingle. Each row that repeats a doc_id gets the component of its own text (a class whose smallest id is so repeated also
    takes the links of that id's other texts); a row whose doc_id is null links with nothing and has a null
    component_id and kept true. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    marks = written(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, low long, high long, bands array<long>"))
    usable = marks.where("n_shingles > 0 and doc_id is not null")
    classes = written(usable.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    entries = classes.select("id", F.explode("bands").alias("bucket"))
    leaders = entries.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("bucket", "lead")
    shared = written(entries.join(leaders, "bucket"))
    met = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    texts = written(docs.select(F.col("doc_id").alias("id"), "text").join(shared.select("id").distinct(), "id", "left_semi"))
    pairs = met.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")  # a may be hot, b is not
    tested = written(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long, distance double, linked boolean"))
    links = tested.where("linked").select("a", "b")
    found = components(links)
    grouped = tested.select(F.col("a").alias("lead"), F.col("b").alias("id"), "distance").join(classes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), "id")
    more = _rest(grouped, texts, found)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    by_class = classes.select("low", "high", "n_shingles", "id").join(found, "id", "left").select("low", "high", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = marks.join(by_class, ["low", "high", "n_shingles"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

