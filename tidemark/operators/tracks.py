"""Tracks for genome browsers, as rows; drawing is left to the browser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.balance import balance_bc
from ..model import Features, features_of
from .bidirectional import balance_segments
from .cluster import scored


def track_ctss(pooled: Features) -> DataFrame:
    """Signal of both strands at each position, that of the minus strand negated."""
    pivoted = scored(pooled).groupBy("seqname", "start").agg(*[F.sum(F.when(F.col("strand") == s, F.col("score_n") * k / 1e9)).alias(n) for s, k, n in (("+", 1, "plus"), ("-", -1, "minus"))])
    return pivoted.select("seqname", "start", F.col("start").alias("end"), F.coalesce("plus", F.lit(0.0)).alias("plus"), F.coalesce("minus", F.lit(0.0)).alias("minus"))


def track_clusters(clusters: Features) -> DataFrame:
    """Each cluster as its thick peak and the thin parts before and behind it."""
    rows, peak = features_of(clusters), F.col("thick")
    parts = F.array(
        F.struct(F.col("start").alias("a"), (peak.start - 1).alias("b"), F.lit("thin").alias("kind")),
        F.struct(peak.start.alias("a"), peak.end.alias("b"), F.lit("thick").alias("kind")),
        F.struct((peak.end + 1).alias("a"), F.col("end").alias("b"), F.lit("thin").alias("kind")),
    )
    strand = F.when(F.col("strand") == "+", "Plus").when(F.col("strand") == "-", "Minus").otherwise("Unstranded")
    pieces = rows.select("feature_id", "seqname", "strand", strand.alias("__s"), F.explode(parts).alias("p")).filter("p.a <= p.b")
    name = F.col("feature_id")
    return pieces.select("seqname", F.col("p.a").alias("start"), F.col("p.b").alias("end"), "strand", F.concat("p.kind", "__s").alias("feature"), name.alias("transcript"), name.alias("gene"), name.alias("symbol"))


def track_balance(pooled: Features, seqinfo: DataFrame, window: int = 199, balance=balance_bc) -> DataFrame:
    """Windowed signal upstream and downstream on both strands, and the balance, of all positions."""
    return balance_segments(pooled, seqinfo, window, balance, prefilter=False)


def track_links(links: DataFrame, features: Features) -> DataFrame:
    """Links with the ranges of both anchors."""
    rows = features_of(features)
    for n in (1, 2):
        side = rows.select(F.col("feature_id").alias(f"anchor{n}"), F.col("seqname").alias(f"seqname{n}"), F.col("start").alias(f"start{n}"), F.col("end").alias(f"end{n}"))
        links = links.join(side, f"anchor{n}")
    return links
