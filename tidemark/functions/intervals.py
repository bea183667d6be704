"""Interval arithmetic as Column expressions; intervals are 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width(start: Column, end: Column) -> Column:
    return end - start + 1


def promoter(start: Column, end: Column, strand: Column, upstream: int, downstream: int) -> tuple[Column, Column]:
    """The region around the 5' end: `upstream` bases before it and `downstream` from it on."""
    minus = strand == "-"
    return F.when(minus, end - downstream + 1).otherwise(start - upstream), F.when(minus, end + upstream).otherwise(start + downstream - 1)


def five_prime(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", end).otherwise(start)


def center(start: Column, end: Column) -> Column:
    """The middle base, the left one of two."""
    return start + F.floor((end - start) / 2)


def expand(start: Column, end: Column, by: int) -> tuple[Column, Column]:
    return start - by, end + by


def extend(start: Column, end: Column, strand: Column, upstream: int, downstream: int) -> tuple[Column, Column]:
    """The interval with flanks on its 5' and 3' sides."""
    minus = strand == "-"
    return start - F.when(minus, downstream).otherwise(upstream), end + F.when(minus, upstream).otherwise(downstream)


def hull(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return F.least(a[0], b[0]), F.greatest(a[1], b[1])


def overlap(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return F.greatest(a[0], b[0]), F.least(a[1], b[1])


def gap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Bases between two intervals; negative by the bases they share."""
    return F.greatest(a[0], b[0]) - F.least(a[1], b[1]) - 1


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.greatest(F.lit(0), gap(a, b))


def within(inner: tuple[Column, Column], outer: tuple[Column, Column]) -> Column:
    return (inner[0] >= outer[0]) & (inner[1] <= outer[1])


def narrow(start: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """The part from the first to the last base, counted from 1."""
    return start + first - 1, start + last - 1


def invert_strand(strand: Column) -> Column:
    return F.translate(strand, "+-", "-+")


def trim(df: DataFrame, seqinfo: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Clip to 1 .. seqlength; sequences without a known length are clipped on the left."""
    lengths = seqinfo.select(F.col("seqname").alias("__seq"), F.col("seqlength").alias("__length"))
    out = df.join(lengths, df["seqname"] == F.col("__seq"), "left").drop("__seq")
    out = out.withColumn("start", F.greatest(F.lit(1), "start")).withColumn("end", F.when(F.col("__length").isNull(), F.col("end")).otherwise(F.least("end", "__length"))).drop("__length")
    return out.filter("start <= end") if drop_empty else out


def tiles(seqinfo: DataFrame, n: int | None = None, width: int | None = None) -> DataFrame:
    """The genome in tiles: `n` of nearly equal width over all sequences together, or of one width in each sequence."""
    if (n is None) == (width is None):
        raise ValueError("give either the number of tiles or their width")
    if n is not None:
        total = seqinfo.agg(F.sum("seqlength")).first()[0]
        width = max(1, -(-total // n))
    starts = F.sequence(F.lit(1).cast("long"), F.col("seqlength").cast("long"), F.lit(width).cast("long"))
    return seqinfo.select("seqname", "seq_rank", "seqlength", F.explode(starts).alias("start")).select("seqname", "seq_rank", "start", F.least(F.col("start") + width - 1, F.col("seqlength")).alias("end"))
