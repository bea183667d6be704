"""Set algebra of ranges: reduce, intersect, set difference, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import islands, next_position, running_sums

SEQ_STRAND = ("seqname", "strand")


def reduce_ranges(df: DataFrame, min_gap: int = 1, keys: Sequence[str] = SEQ_STRAND, members: str | None = None) -> DataFrame:
    """Merge ranges of a key whose gap is under `min_gap`: 1 also merges adjacent ones, 0 only those that share a base.

    With `members`, the name of a column, `revmap` lists its values in each merged range.
    """
    more = [] if members is None else [F.sort_array(F.collect_list(members)).alias("revmap")]
    found = islands(df, keys, min_gap)
    return found.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *more).drop("island")


def _events(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, F.col("e.at").alias("at"), F.col("e.d").alias(name))


def _sweep(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments between breakpoints with the depths of a and b."""
    events = _events(a, keys, "a").withColumn("b", F.lit(0)).unionByName(_events(b, keys, "b").withColumn("a", F.lit(0)))
    events = events.groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return next_position(running_sums(events, keys, "at", ["a", "b"]), keys, "at", "next").filter("next IS NOT NULL").select(*keys, F.col("at").alias("start"), (F.col("next") - 1).alias("end"), "a", "b")


def intersect_ranges(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("seqname",)) -> DataFrame:
    """The bases in both, as merged ranges."""
    return reduce_ranges(_sweep(a, b, keys).filter("a > 0 AND b > 0"), 1, keys)


def setdiff_ranges(a: DataFrame, b: DataFrame, keys: Sequence[str] = SEQ_STRAND) -> DataFrame:
    """The bases in a but not in b, as merged ranges."""
    return reduce_ranges(_sweep(a, b, keys).filter("a > 0 AND b = 0"), 1, keys)


def union_ranges(a: DataFrame, b: DataFrame, keys: Sequence[str] = SEQ_STRAND) -> DataFrame:
    return reduce_ranges(a.select(*keys, "start", "end").unionByName(b.select(*keys, "start", "end")), 1, keys)


def coverage(df: DataFrame, weight: str, keys: Sequence[str] = SEQ_STRAND) -> DataFrame:
    """Segments (start, end, value) of the summed integer weights, zero segments left out."""
    events = df.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.col(weight).alias("d")), F.struct((F.col("end") + 1).alias("at"), (-F.col(weight)).alias("d")))).alias("e"))
    events = events.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("value")).filter("value != 0")
    swept = next_position(running_sums(events, keys, "at", ["value"]), keys, "at", "next")
    return swept.filter("value != 0 AND next IS NOT NULL").select(*keys, F.col("at").alias("start"), (F.col("next") - 1).alias("end"), "value")


def slice_above(segments: DataFrame, cutoff: int, value: str = "value", keys: Sequence[str] = SEQ_STRAND) -> DataFrame:
    """Maximal runs of bases with a value over the cutoff."""
    return reduce_ranges(segments.filter(F.col(value) > cutoff), 1, keys)
