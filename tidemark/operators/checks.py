"""Checks of formats; each raises ValueError with what is wrong, and warns of what is suspicious."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Features, features_of
from ..plans.tiles import islands


def is_disjoint(df: DataFrame) -> bool:
    """Whether no two ranges of a sequence and strand share a base."""
    merged = islands(df.select("seqname", "strand", "start", "end"), ["seqname", "strand"], 0)
    return merged.filter("island != start").isEmpty() and df.groupBy("seqname", "strand", "start").count().filter("count > 1").isEmpty()


def _columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in ("seqname", "start", "end", "strand", *names) if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def check_ctss(x: Features) -> bool:
    """Positions of width 1 with whole scores, each once."""
    df = features_of(x)
    _columns(df, "score")
    wide, part, unstranded, rows = df.agg(F.count_if(F.col("start") != F.col("end")), F.count_if(F.col("score") % 1 != 0), F.count_if(F.col("strand") == "*"), F.count(F.lit(1))).first()
    if wide:
        raise ValueError(f"{wide} ranges are wider than one base")
    if part:
        raise ValueError(f"{part} scores are not whole numbers")
    if not df.groupBy("seqname", "strand", "start").count().filter("count > 1").isEmpty():  # all are one base wide
        raise ValueError("positions occur more than once")
    if not rows:
        warnings.warn("there are no positions", stacklevel=2)
    if unstranded:
        warnings.warn(f"{unstranded} positions have no strand", stacklevel=2)
    return True


def check_pooled(x: Features, seqinfo: DataFrame) -> bool:
    """Scored positions of width 1, each once, on sequences of known length."""
    df = features_of(x)
    _columns(df, "score")
    if dict(df.dtypes)["score"] not in ("double", "float", "int", "bigint"):
        raise ValueError("the score is not a number")
    if not df.filter("start != end").isEmpty():
        raise ValueError("ranges are wider than one base")
    if not df.groupBy("seqname", "strand", "start").count().filter("count > 1").isEmpty():
        raise ValueError("positions occur more than once")
    known = seqinfo.filter("seqlength IS NOT NULL").select("seqname")
    if not df.join(known, "seqname", "left_anti").isEmpty():
        raise ValueError("sequences have no known length")
    return True


def check_peaked(x: Features) -> bool:
    """An interval column thick within each range."""
    df = features_of(x)
    _columns(df, "thick")
    if not dict(df.dtypes)["thick"].startswith("struct<start:"):
        raise ValueError("thick does not hold intervals")
    if not df.filter("NOT (thick.start >= start AND thick.end <= end)").isEmpty():
        raise ValueError("thick is not within the range")
    return True


def check_genomes(a: DataFrame, b: DataFrame) -> bool:
    """Sequences that both genomes have must be equally long."""
    other = b.select("seqname", F.col("seqlength").alias("__other"))
    wrong = [r.seqname for r in a.join(other, "seqname").filter("seqlength != __other").select("seqname").limit(5).collect()]
    if wrong:
        raise ValueError(f"sequences differ in length: {', '.join(wrong)}")
    return True
