"""What the order of document filters changes: counts for every order of five filters, from counters of failure masks.

Exact duplicates are found by sorting: rows are dealt out by ranges of (fingerprint, doc_id), so that a group of copies of any size spreads over
tasks, and sorted by fingerprint, full text and doc_id. A row whose text equals its predecessor's and whose doc_id is
larger than the first one's fails. A group at the edge of a range may go on in the next: its first rows there are held back with
their range's smallest doc_id and settled when the edges of all ranges are compared, text by text. Everything else
follows from additive counters: how many documents of a part fail just the filters of a mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    fails = (n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * F.length(text), text.rlike(SIGNS))
    return sum((f.cast("int") * F.lit(1 << k) for k, f in enumerate(fails)), F.lit(0))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in their order, with `later`: whether a row of the same text with a smaller doc_id precedes it, and for the rows that another range may overrule the text and the smallest doc_id seen here."""
    first_print = last = None  # the range's first fingerprint; the last row's (fingerprint, text, smallest doc_id)

    def columns(batch, later, least, edge):
        text = pc.if_else(pa.array(edge), batch.column("text"), pa.scalar(None, batch.column("text").type))
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "mask", "fingerprint")] + [pa.array(later), least, text], names=["doc_id", "part", "mask", "fingerprint", "later", "least", "text"])

    waiting = []  # rows of the last fingerprint, which may be the range's last
    for batch in batches:
        if not batch.num_rows:
            continue
        prints, texts = batch.column("fingerprint").to_numpy(), batch.column("text")
        first_print = int(prints[0]) if first_print is None else first_print
        same = np.zeros(len(prints), dtype=bool)
        same[1:] = (prints[1:] == prints[:-1]) & pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        goes_on = last is not None and last[0] == int(prints[0]) and last[1] == texts[0].as_py()
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(prints))))
        ids = batch.column("doc_id")
        least = ids.take(pa.array(head))
        if goes_on:
            least = pc.if_else(pa.array(head == 0), pa.scalar(last[2], pa.int64()), least)
        later = pc.fill_null(pc.greater(ids, least), False).to_numpy(zero_copy_only=False)
        last = (int(prints[-1]), texts[-1].as_py(), least[-1].as_py())
        open_rows = ~later & ids.is_valid().to_numpy(zero_copy_only=False)
        ending = open_rows & (prints == prints[-1])
        opening = open_rows & (prints == first_print)
        if waiting and waiting[0][0] != int(prints[-1]):
            yield from (columns(b, lt, le, np.full(b.num_rows, p == first_print)) for p, b, lt, le in waiting)
            waiting = []
        settled = pa.array(~ending)
        if not ending.all():
            yield columns(batch.filter(settled), later[~ending], least.filter(settled), opening[~ending])
        if ending.any():
            chosen = pa.array(ending)
            waiting.append((int(prints[-1]), batch.filter(chosen), later[ending], least.filter(chosen)))
    yield from (columns(b, lt, le, np.ones(b.num_rows, bool)) for _, b, lt, le in waiting)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of a doc_id and part fail just the filters of a mask. part is lang, null as empty."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumn("fingerprint", F.xxhash64("text"))
    # Rows that repeat both are parted by a draw, seeded so that a task run again draws the same.
    rows = rows.withColumn("draw", F.rand(12)).repartitionByRange("fingerprint", "doc_id", "draw").drop("draw").sortWithinPartitions("fingerprint", "text", F.col("doc_id").asc_nulls_last())
    rows = rows.withColumn("mask", text_mask(F.col("text"))).mapInArrow(_later, "doc_id long, part string, mask int, fingerprint long, later boolean, least long, text string")
    key = ["doc_id", "part", "mask", "later", "fingerprint", "least", "text"]
    at_edge = F.col("text").isNotNull()
    rows = rows.withColumns({c: F.when(at_edge, F.col(c)) for c in ("fingerprint", "least")}).groupBy(key).agg(F.count("*").alias("n"))
    # A range sends its first and last text's first doc_ids at most, so a window holds two rows a range; all others are alone in theirs.
    lone = F.when(at_edge, F.lit(0)).otherwise(F.xxhash64("doc_id", "part", "mask", "later"))
    overall = F.min("least").over(Window.partitionBy("fingerprint", "text", lone))
    fails = F.col("later") | F.coalesce(at_edge & (overall < F.col("least")), F.lit(False))
    return rows.withColumn("fails", fails).select("doc_id", "part", (F.col("mask") + F.when(F.col("fails"), DUPLICATE).otherwise(0)).alias("mask"), "n")


def counters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those among them labelled of good quality and toxic. A doc_id with several labels counts as good, or toxic, where any of them says so."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = masks(docs).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    rows = rows.join(known.where("good + toxic > 0"), F.col("doc_id") == F.col("labelled"), "left")
    total = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good"), total("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the filter) of each step of each order."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [("".join(order), k + 1, sum(bit[f] for f in order[:k]), bit[order[k]]) for order in permutations(FILTERS) for k in range(len(order))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with what the step's filter removes there.

    docs (doc_id, text, lang), labels (doc_id, quality, toxic). A null text is an empty one, a null lang the part ''. A row with a null doc_id neither
    is a duplicate nor makes one; of rows that repeat doc_id and text none is a duplicate of the other. Labels of rows without a
    document are left out. Empty docs give no rows; other columns are not read.
    """
    held = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # 32 masks at most
    parts = counters(docs, labels).groupBy("part").agg(held.alias("held"))
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("own")) for o, s, b, f in steps()])
    rows = parts.select("part", "held", F.explode(plan).alias("at")).select("part", "held", "at.*")
    before, own, zero = F.col("before"), F.col("own"), F.lit(0).cast("bigint")

    def total(test, of: str = "n") -> Column:
        return F.aggregate("held", zero, lambda a, m: a + F.when(test(m["mask"]), m[of]).otherwise(zero))

    survives = lambda m: m.bitwiseAND(before) == 0
    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: survives(m) & fails(m)
    # Of the filters that a document fails each comes first in the same number of orders.
    orders = len(list(permutations(FILTERS)))
    share = F.aggregate("held", zero, lambda a, m: a + F.when(fails(m["mask"]), m["n"] * (F.lit(orders) / F.bit_count(m["mask"])).cast("bigint")).otherwise(zero))
    return rows.select(
        "part", "filter_order", "step", total(lambda m: survives(m) & ~fails(m)).alias("kept"), total(gone).alias("removed"), total(lambda m: ~survives(m) & fails(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"), total(gone, "good").alias("good_lost"), total(gone, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )
