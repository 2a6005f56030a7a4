"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are brought to unit length, so that cosine 0.9 is a distance of root 0.2. In each of several tables, a vector's bucket is
the tuple floor((a.x + b) / W) over random Gaussian directions a and shifts b. Vectors that meet in a bucket are compared by exact cosine, a
pair in the first table it meets in only. Equal vectors are one point of a weight. A bucket of more than BLOCK points
is compared in pairs of blocks, each in a group of its own, so no task holds a whole bucket; tasks return counts of links and a
spanning forest of the links of a block, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.llm import hashing
from curatorium.llm.shared import components, forest, written

COSINE = 0.9
WIDTH = 2.0
MISS = 0.01  # chance that a pair right at the threshold meets in no table; closer pairs are missed far less
APART = 64  # wanted number of unrelated points that meet a point in a table
BLOCK = 1024
FEW = 48  # points of a group whose pairs are formed together with those of other groups
SEED = 77


def _meet(distance: float) -> float:
    """Chance that two points at that distance share a value of one hash."""
    r = WIDTH / distance
    return 1 - 2 * (0.5 * math.erfc(r / math.sqrt(2))) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(points: int, cosine: float = COSINE) -> tuple[int, int]:
    """(hashes to a table, tables) for so many points: unrelated points are taken to stand at right angles."""
    near, far = _meet(math.sqrt(2 - 2 * cosine)), _meet(math.sqrt(2))
    hashes = max(8, math.ceil(math.log(max(1, points) / APART) / -math.log(far)))
    return hashes, math.ceil(math.log(MISS) / math.log(1 - near**hashes))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, x): eight bytes a component, of unit length; x is null where the row links with nothing."""
    for batch in batches:
        xs = []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            x = np.array(v, dtype=np.float64) if i is not None and v and None not in v else np.zeros(1)
            norm = np.linalg.norm(x / (np.abs(x).max() or 1.0)) if np.isfinite(x).all() else 0.0
            x = x / (np.abs(x).max() * norm) if norm else None
            xs.append(None if x is None else x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(xs, pa.binary())], names=["vec_id", "x"])


@lru_cache(maxsize=2)
def _directions(size: int, hashes: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of all tables, drawn once for each worker."""
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((size, tables * hashes)), rng.uniform(0, WIDTH, tables * hashes)


def _keys(x: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """One row of table keys for each point; a key holds its table's number."""
    a, b = _directions(x.shape[1], hashes, tables)
    out = np.empty((len(x), tables), dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 4096):
            h = np.floor((x[k : k + 4096] @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, tables, hashes)
            key = np.tile(np.arange(tables, dtype=np.uint64), (len(h), 1))
            for j in range(hashes):
                key = hashing.mix(key * np.uint64(0x9E3779B97F4A7C15) + h[:, :, j])
            out[k : k + 4096] = key.view(np.int64)
    return out


def _hashed(hashes: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1)
                keys = _keys(x, hashes, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "weight", "x")], lists], names=["id", "weight", "x", "keys"])

    return run


def _tree(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what the symmetric matrix `linked` connects."""
    left, out = np.ones(len(linked), dtype=bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start], open_ = False, [start]
        while open_:
            a = open_.pop()
            new = np.flatnonzero(linked[a] & left)
            left[new] = False
            open_ += new.tolist()
            out.append((np.full(len(new), a), new))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x[a] . x[b] by equal steps for every pair (a sum in another order could fall on the other side of the threshold), a slice at a time."""
    step = max(1, (1 << 22) // x.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", x[a[k : k + step]], x[b[k : k + step]]) for k in range(0, max(1, len(a)), step)])


def _compare(hashes: int, tables: int, cosine: float):
    """Rows in the order of (bucket, left, right) to counts of links (id, n) and links that connect the same (id, 0, other). A group is a bucket, or two of its blocks; groups are at most two blocks long."""

    def large(bucket: int, x: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
        one, two = np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])
        two = two if len(two) else one
        keys, linked = _keys(x, hashes, tables), np.zeros((len(x), len(x)), dtype=bool)
        close = x[one] @ x[two].T
        near = close >= cosine - 1e-9
        for u in range(int(np.argmax(keys[0] == bucket))):  # what has met in an earlier table is counted there
            if not near.any():
                break
            near &= keys[one, u][:, None] != keys[two, u][None, :]
        a, b = np.nonzero(near & (close <= cosine + 1e-9))
        near[a, b] = _dots(x, one[a], two[b]) >= cosine
        linked[np.ix_(one, two)] |= near
        linked |= linked.T
        np.fill_diagonal(linked, False)
        return linked, *_tree(linked)

    def small(bucket: np.ndarray, ends: np.ndarray, x: np.ndarray, block: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = ends - np.arange(len(ends)) - 1
        a = np.repeat(np.arange(len(ends)), count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + a + 1
        meet = ~cross[a] | (block[a] != block[b])
        a, b = a[meet], b[meet]
        sure = _dots(x, a, b) >= cosine
        a, b = a[sure], b[sure]
        if len(a):
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = _keys(x[used], hashes, tables)
            own = np.ones(len(a), dtype=bool)
            for k in range(0, len(a), 65536):
                ka, kb = keys[at[k : min(k + 65536, len(a))]], keys[at[len(a) + k : len(a) + k + 65536]]
                own[k : k + 65536] = ka[np.arange(len(ka)), np.argmax(ka == kb, axis=1)] == bucket[a[k : k + 65536]]
            a, b = a[own], b[own]
        return a, b

    def told(rows: list[np.ndarray]) -> pa.RecordBatch:
        bucket, left, right, block, ids, weight, x = rows
        first = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
        ends = np.append(first[1:], len(ids))
        n, links = np.zeros(len(ids)), [(np.zeros(0, np.int64),) * 2]
        few = np.repeat(ends - first <= FEW, ends - first)
        if few.any():
            at = np.flatnonzero(few)
            stop = np.cumsum((ends - first)[ends - first <= FEW])
            a, b = small(bucket[at], np.repeat(stop, np.diff(stop, prepend=0)), x[at], block[at], left[at] != right[at])
            n[at] += np.bincount(a, weight[at][b], len(at)) + np.bincount(b, weight[at][a], len(at))
            keep = forest(a, b)
            links.append((at[a[keep]], at[b[keep]]))
        for k in np.flatnonzero(ends - first > FEW):
            own = slice(first[k], ends[k])
            linked, a, b = large(bucket[first[k]], x[own], block[own] if left[first[k]] != right[first[k]] else np.zeros(ends[k] - first[k]))
            n[own] += linked @ weight[own]
            links.append((first[k] + a, first[k] + b))
        a, b = (np.concatenate(z) for z in zip(*links, strict=True))
        some, at = np.unique(ids, return_inverse=True)
        n = np.bincount(at, n, len(some)).astype(np.int64)
        none = np.concatenate((np.ones(len(some), dtype=bool), np.zeros(len(a), dtype=bool)))
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((some, ids[a]))), pa.array(np.concatenate((n, np.zeros(len(a), np.int64)))), pa.array(np.concatenate((some, ids[b])), mask=none)], names=["id", "n", "other"]
        )
        return out.filter(pa.array(~none | (np.append(n, np.zeros(len(a))) > 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("bucket", "left", "right", "block", "id", "weight")]
            rows.append(np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1))
            if held is not None:
                rows = [np.concatenate(z) for z in zip(held, rows, strict=True)]
            last = len(rows[0]) - 1
            begin = np.flatnonzero((rows[0] == rows[0][last]) & (rows[1] == rows[1][last]) & (rows[2] == rows[2][last]))[0]
            if begin:
                yield told([z[:begin] for z in rows])
            held = [z[begin:].copy() for z in rows]
        if held is not None:
            yield told(held)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors (vec_id, embedding; other columns are ignored).

    Vectors that are null, empty, zero, or hold null or non-finite components have no links. Rows with equal vectors, as they stand after
    scaling to unit length, link with one another. Rows that repeat a vec_id count as vectors each, and share the
    component of their own vector; a row whose vec_id is null has no links, a null component and kept true. All vectors have one length. An empty table gives no rows.
    """
    rows = written(vectors.select("vec_id", "embedding").mapInArrow(_unit, "vec_id long, x binary"))
    usable = rows.where("x is not null")
    points = written(usable.groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    hashes, tables = parameters(points.count(), cosine)
    hashed = written(points.mapInArrow(_hashed(hashes, tables), "id long, weight long, x binary, keys array<long>"))
    sizes = hashed.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    entries = hashed.select("id", "weight", "x", F.explode("keys").alias("bucket")).join(sizes, "bucket")
    entries = entries.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id", "x"), F.col("blocks")).cast("int"))
    with_block = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = entries.withColumn("other", F.explode(with_block)).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    placed = pairs.select("bucket", "left", "right", "block", "id", "weight", "x").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    found = written(placed.mapInArrow(_compare(hashes, tables, cosine), "id long, n long, other long"))
    linked = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    by_point = points.join(counts, "id", "left").join(linked, "id", "left").select("x", F.coalesce("component", "id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(by_point, "x", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
