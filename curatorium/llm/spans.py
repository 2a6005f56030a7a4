"""Places of regular-expression matches as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def none() -> Column:
    return F.array().cast(SPANS)


def spans(kind: str, place: int, found: Column, gaps: Column, keep: Column | None = None) -> Column:
    """Spans (start, place, end, kind) in code points, end exclusive, of the matches `found`; `gaps` are the texts between them, so running sums of lengths give the places.

    keep: an array as long as found, whether each match counts.
    """
    kept = F.transform(found, lambda _: F.lit(True)) if keep is None else keep
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), F.arrays_zip(found.alias("match"), kept.alias("keep")), lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["match"]).alias("long"), m["keep"].alias("keep")))
    zero = F.struct(F.lit(0).alias("at"), none().alias("spans"))

    def step(acc, x):
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["long"]
        one = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.when(x["keep"], one).otherwise(none())).alias("spans"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["spans"])


def rebuilt(text: Column, changes: Column) -> Column:
    """text with changes, an array of (start, end, new) in order of start, put in; a change that begins inside an earlier one is left out."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, c):
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["new"])
        after = c["start"] >= acc["at"]
        return F.struct(F.when(after, c["end"]).otherwise(acc["at"]).alias("at"), F.when(after, put).otherwise(acc["out"]).alias("out"))

    return F.aggregate(changes, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
