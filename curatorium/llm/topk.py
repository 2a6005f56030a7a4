"""Exact top-k inner products through a pivot-distance index.

Every vector is keyed by its nearest pivot and by the annulus of that pivot its distance falls into; a cell (pivot, annulus) keeps its
range of distances to every pivot and its largest squared norm. For a query q and a vector x of a cell, q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, and by
the triangle inequality |q - x| >= max(d(q, p) - far, near - d(q, p)) for each pivot p, which bounds every score in the cell. Each query first
searches its cells in the order of their bounds until FIRST vectors are seen; the k-th score found is its floor. It then
expands to just the cells whose bound reaches the floor. Bounds are exact up to rounding, which SLACK covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatorium.llm.shared import written

PIVOTS = 24
ANNULI = 8
BLOCK = 2048  # vectors of a cell that meet queries in one group
QUERY_BLOCK = 1024
FIRST = 256
K = 10
SLACK, RELATIVE = 1.0, 1e-11  # what rounding may take from a bound
SCALE = 1024


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, x): eight bytes a component, within 2**62 on either side. Vectors that are null, empty or hold null or non-finite components are left out."""
    for batch in batches:
        ids, xs = [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if i is not None and v and None not in v and np.isfinite(x := np.array(v, dtype=np.float64)).all():
                ids.append(i)
                xs.append(np.clip(np.floor(SCALE * x), -float(1 << 62), float(1 << 62)).astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.binary())], names=["vec_id", "x"])


def _matrix(xs) -> np.ndarray:
    return np.frombuffer(b"".join(xs), dtype=np.int64).reshape(len(xs), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, from differences, so that small ones keep their digits."""
    x = x.astype(np.float64)
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots.astype(np.float64)], axis=1))


def _place(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x").to_pylist())
                d = _distances(x, pivots)
                near = np.argmin(d, axis=1)
                norm = (x.astype(np.float64) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near]), pa.array(norm), pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), len(pivots)).cast(pa.list_(pa.float64()))], names=["vec_id", "x", "pivot", "distance", "norm2", "far"])

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, norm2, far) to each cell's ranges in a batch, a row for each pivot."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d = batch.column("far").flatten().to_numpy().reshape(batch.num_rows, -1)
        cell, norm = batch.column("cell").to_numpy(), batch.column("norm2").to_numpy()
        order = np.argsort(cell, kind="stable")
        own, first, n = np.unique(cell[order], return_index=True, return_counts=True)
        low, high, most = np.minimum.reduceat(d[order], first), np.maximum.reduceat(d[order], first), np.maximum.reduceat(norm[order], first)
        many = d.shape[1]
        columns = [np.repeat(own, many), np.tile(np.arange(many, dtype=np.int32), len(own)), low.ravel(), high.ravel(), np.repeat(most, many), np.repeat(n, many)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "of", "near", "far", "norm2", "n"])


def _cells(pivots: np.ndarray, cells: pd.DataFrame):
    """For each query its cells with the bounds of their scores, the first ones marked. cells: one row for each cell and pivot, in that order."""
    near, far = (cells[c].to_numpy().reshape(-1, len(pivots)) for c in ("near", "far"))
    numbers, most, n = (cells[c].to_numpy()[:: len(pivots)] for c in ("cell", "norm2", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                q = _matrix(batch.column("x").to_pylist())
                d = _distances(q, pivots)[:, None, :]
                gap = np.maximum(0, np.maximum(d - far, near - d)).max(axis=2)
                norms = (q.astype(np.float64) ** 2).sum(axis=1)[:, None] + most
                bound = (norms * (1 + RELATIVE) - gap**2 * (1 - RELATIVE)) / 2 + SLACK
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(first, order, before < FIRST, axis=1)
                row = pa.array(np.repeat(np.arange(len(q)), len(n)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(row), pa.array(np.tile(numbers, len(q)), pa.int32()), pa.array(bound.ravel()), pa.array(first.ravel())], names=["query_id", "cell", "bound", "first"]
                )

    return run


def _best(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        """The k highest scores of each query of a block within a block of a cell."""
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        vectors = vectors.sort_values("vec_id")
        ids, x, q = vectors["vec_id"].to_numpy(), _matrix(vectors["x"]), _matrix(queries["x"])
        out = []
        most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
        for query, own in zip(queries["query_id"].to_numpy(), q, strict=True):
            if most < 2**53:
                scores = np.rint(x.astype(np.float64) @ own.astype(np.float64)).astype(np.int64)
            else:
                scores = x @ own if most < 2**62 else np.clip(x.astype(object) @ own.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)
            other = ids != query
            keep, found = ids[other], scores[other]
            if len(found) > k:
                least = np.partition(found, len(found) - k)[len(found) - k]
                at = np.flatnonzero(found >= least)
                at = at[np.lexsort((keep[at], -found[at]))][:k]
            else:
                at = np.arange(len(found))
            out.append(pd.DataFrame({"query_id": query, "vec_id": keep[at], "score": found[at]}))
        return pd.concat(out)

    return run


def _search(pairs: DataFrame, queries: DataFrame, index: DataFrame, k: int, query_blocks: int) -> DataFrame:
    """Scores (query_id, vec_id, score) of the k best in each block of the cells that pairs (query_id, cell, blocks) name. A cell's vectors go to the parts of the queries that ask for it only."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
    asked = pairs.join(queries.select(F.col("vec_id").alias("query_id"), "x"), "query_id")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "part", "query_id", "x")
    wanted = pairs.select(F.col("cell").alias("of"), F.col("part").alias("to")).distinct()
    held = index.join(wanted, F.col("cell") == F.col("of")).withColumnRenamed("to", "part").select("cell", "block", "part", "vec_id", "x")
    keys = ["cell", "block", "part"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_best(k), "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, pivots: int = PIVOTS, annuli: int = ANNULI) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest integer inner products with all other rows, ties to the smaller vec_id.

    vectors has vec_id and embedding, all of one length; queries (the rows whose vec_id is divisible by 100, where None) is a
    part of the same table. Components are scaled to floor(1024 x). Rows whose vec_id is null, or whose embedding is null, empty or
    holds null or non-finite components, take no part; other columns are ignored. Repeated rows are candidates each; a row with its
    query's vec_id is none, and of several vectors of a query's vec_id the one with the least bytes asks. Components are held within 2**62 and scores within 64 bits. Pivots are the PIVOTS vectors with the smallest hashes, annuli equal shares of a pivot's rows. An empty table gives no rows.
    """
    vectors = vectors.select("vec_id", "embedding")
    queries = vectors.where("vec_id % 100 = 0") if queries is None else queries.select("vec_id", "embedding")
    scaled = vectors.mapInArrow(_scaled, "vec_id long, x binary")
    own = F.xxhash64("x")  # eight bytes for each different vector are shuffled, and the vectors of the chosen hashes
    hashes = [r[0] for r in scaled.select(own.alias("h")).groupBy("h").count().orderBy("h").limit(pivots).select("h").collect()]
    chosen = scaled.where(own.isin(hashes)).groupBy(own.alias("h")).agg(F.min("x").alias("x")).orderBy("h").collect()  # pivots rows
    empty = scaled.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not chosen:
        return empty
    points = _matrix([bytes(r["x"]) for r in chosen])
    placed = written(scaled.mapInArrow(_place(points), "vec_id long, x binary, pivot int, distance double, norm2 double, far array<double>"))
    edges = placed.groupBy("pivot").agg(F.percentile_approx("distance", [j / annuli for j in range(1, annuli)]).alias("edges"))  # one row a pivot
    keyed = placed.join(F.broadcast(edges), "pivot").withColumn("annulus", F.size(F.filter("edges", lambda e: e < F.col("distance")))).withColumn("cell", F.col("pivot") * annuli + F.col("annulus"))
    ranges = keyed.select("cell", "norm2", "far").mapInArrow(_ranges, "cell int, of int, near double, far double, norm2 double, n long")
    cells = ranges.groupBy("cell", "of").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.max("norm2").alias("norm2"), F.sum("n").alias("n")).orderBy("cell", "of").toPandas()  # pivots * pivots * annuli rows
    blocks = {int(c): -(-int(n) // BLOCK) for c, n in zip(cells["cell"], cells["n"], strict=True)}
    of_cell = F.element_at(F.create_map(*[F.lit(x) for c, b in blocks.items() for x in (c, b)]), F.col("cell"))
    index = keyed.withColumn("block", F.pmod(F.xxhash64("vec_id", "x", F.lit(3)), of_cell).cast("int")).select("cell", "block", "vec_id", "x")
    asking = written(queries.mapInArrow(_scaled, "vec_id long, x binary").groupBy("vec_id").agg(F.min("x").alias("x")))
    parts = max(1, -(-asking.count() // QUERY_BLOCK))
    pairs = written(asking.mapInArrow(_cells(points, cells), "query_id long, cell int, bound double, first boolean")).withColumn("blocks", of_cell)
    near = written(_ranked(_search(pairs.where("first"), asking, index, k, parts), k))
    floor = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = pairs.where("not first").join(floor, "query_id", "left").where("floor is null or bound >= floor")
    far = _search(rest, asking, index, k, parts)
    return _ranked(near.select("query_id", "vec_id", "score").unionByName(far), k).select("query_id", "rank", "vec_id", "score")
