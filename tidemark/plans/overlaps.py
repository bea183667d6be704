"""Overlap joins as equi-joins on bins.

Both sides are exploded into the bins they touch and joined on (sequence, bin); each pair is kept in the one bin where
the later of the two starts lies, so a pair appears once.  Nothing is a nested loop, and AQE splits skewed bins or
broadcasts a side that turns out small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 4096


def _flat(df: DataFrame, side: str) -> DataFrame:
    """The columns under names of the side; they become a struct after the join, so that what nobody reads is not shuffled."""
    return df.select(*[F.col(f"`{c}`").alias(f"__{side}_{c}") for c in df.columns])


def _whole(df: DataFrame, side: str) -> Column:
    return F.struct(*[F.col(f"`__{side}_{c}`").alias(c) for c in df.columns]).alias(side)


def _bins(df: DataFrame, side: str, pad: int, width: int) -> DataFrame:
    """The columns, and a row for every bin of the interval."""
    low, high = F.col(f"__{side}_start") - pad, F.col(f"__{side}_end") + pad
    return _flat(df, side).withColumn(f"__{side}__bin", F.explode(F.sequence(F.floor(low / width), F.floor(F.greatest(low, high) / width))))


def _match(p: Column, s: Column) -> Column:
    return (p == s) | (p == "*") | (s == "*")


def overlap_pairs(query: DataFrame, subject: DataFrame, max_gap: int = -1, ignore_strand: bool = False, width: int = BIN) -> DataFrame:
    """Pairs of rows whose gap is `max_gap` at most (-1: they share a base), as structs `q` and `s`."""
    q, s = _bins(query, "q", max_gap + 1, width), _bins(subject, "s", 0, width)
    pairs = q.join(s, (F.col("__q_seqname") == F.col("__s_seqname")) & (F.col("__q__bin") == F.col("__s__bin")))
    once = F.col("__q__bin") == F.floor(F.greatest(F.col("__q_start") - (max_gap + 1), "__s_start") / width)
    near = F.greatest("__q_start", "__s_start") - F.least("__q_end", "__s_end") - 1 <= max_gap
    strand = F.lit(True) if ignore_strand else _match(F.col("__q_strand"), F.col("__s_strand"))
    return pairs.filter(once & near & strand).select(_whole(query, "q"), _whole(subject, "s"))


def overlapping(query: DataFrame, subject: DataFrame, key: str, anti: bool = False, max_gap: int = -1, ignore_strand: bool = False, width: int = BIN) -> DataFrame:
    """The rows of `query`, told apart by `key`, that overlap a row of `subject`; with `anti` those that do not."""
    hits = overlap_pairs(query.select("seqname", "start", "end", "strand", key), subject.select("seqname", "start", "end", "strand"), max_gap, ignore_strand, width)
    return query.join(hits.select(F.col(f"q.{key}").alias(key)).distinct(), key, "left_anti" if anti else "left_semi")


def score_overlaps(query: DataFrame, subject: DataFrame, key: str, score: str = "score", output: str = "score", **options) -> DataFrame:
    """Adds the sum of the scores of overlapping subjects, 0 if there are none."""
    hits = overlap_pairs(query.select("seqname", "start", "end", "strand", key), subject.select("seqname", "start", "end", "strand", score), **options)
    sums = hits.groupBy(F.col(f"q.{key}").alias(key)).agg(F.sum(f"s.{score}").alias("__sum"))
    return query.join(sums, key, "left").withColumn(output, F.coalesce("__sum", F.lit(0))).drop("__sum")


def points_in(points: DataFrame, intervals: DataFrame, width: int = 1024) -> DataFrame:
    """Pairs of one-base points `p` and intervals `s` that hold them, on compatible strands, and the point's `bin`.

    A point has one bin only, so it is not exploded; pairs stay dealt by sequence and bin of the point.
    """
    p, s = _flat(points, "p").withColumn("__p__bin", F.floor(F.col("__p_start") / width)), _bins(intervals, "s", 0, width)
    pairs = p.join(s, (F.col("__p_seqname") == F.col("__s_seqname")) & (F.col("__p__bin") == F.col("__s__bin")))
    inside = (F.col("__p_start") >= F.col("__s_start")) & (F.col("__p_start") <= F.col("__s_end")) & _match(F.col("__p_strand"), F.col("__s_strand"))
    return pairs.filter(inside).select(_whole(points, "p"), _whole(intervals, "s"), F.col("__p__bin").alias("bin"))
