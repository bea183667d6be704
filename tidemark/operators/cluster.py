"""Unidirectional clusters, their statistics, trimming and tuning.

Signals are the integers `score_n`, so sums, running sums and comparisons are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import center, overlap, promoter
from ..model import UNIT, Features, features_of, signal
from ..plans.overlaps import points_in
from ..plans.tiles import ends_of_runs, islands, running_sums

CLUSTER = ("feature_id", "seqname", "start", "end", "strand", "score", "score_n", "thick")


def cluster_id() -> Column:
    return F.concat(F.col("seqname"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"), F.lit(";"), F.col("strand"))


def scored(pooled: Features) -> DataFrame:
    return features_of(pooled).select("seqname", "start", "strand", "score_n").filter("score_n != 0")


def _with_run_ends(pooled: Features) -> DataFrame:
    """Positions and whether the run of neighbouring positions with the same value ends there."""
    return ends_of_runs(scored(pooled), ["seqname", "strand"], "start", "score_n", "run_ends")


def _summed(points: DataFrame, key: list[str], ends: Column, *more: Column) -> DataFrame:
    """score_n and peak of groups of positions (pos, v), in one pass: of the largest values the first position, and the first
    position at which a run of them ends."""
    value = F.struct(F.col("v"), (-F.col("pos")).alias("pos"))
    found = points.groupBy(*key).agg(F.sum("v").alias("score_n"), F.max(value).alias("__first"), F.max(F.when(ends, value)).alias("__last"), *more)
    return found.withColumn("peak", center(-F.col("__first.pos"), -F.col("__last.pos"))).drop("__first", "__last")


def _named(ranges: DataFrame) -> DataFrame:
    return ranges.withColumns({"feature_id": cluster_id(), "score": signal(F.col("score_n")), "thick": F.struct(F.col("peak").alias("start"), F.col("peak").alias("end"))}).select(*CLUSTER)


def tc_stats(ranges: DataFrame, pooled: Features) -> DataFrame:
    """Score and peak of ranges (seqname, start, end, strand), by all positions in them.

    The peak is the center of the first run of neighbouring positions with the largest value.
    """
    key = ["seqname", "start", "end", "strand"]
    found = points_in(_with_run_ends(pooled), ranges.select(*key))
    points = found.filter("p.strand = s.strand").select(*[F.col(f"s.{k}").alias(k) for k in key], F.col("p.start").alias("pos"), F.col("p.score_n").alias("v"), "p.run_ends")
    stats = _summed(points, key, F.col("run_ends") | (F.col("pos") == F.col("end")))
    out = ranges.select(*key).join(stats, key, "left")
    return _named(out.withColumn("score_n", F.coalesce("score_n", F.lit(0).cast("long"))).withColumn("peak", F.coalesce("peak", "start")))


def cluster_unidirectionally(pooled: Features, cutoff: float = 0, merge_dist: int = 20) -> DataFrame:
    """Clusters of positions over the cutoff that are `merge_dist` bases apart at most."""
    if cutoff < 0 or merge_dist < 0:
        raise ValueError("cutoff and merge distance must be 0 or more")
    key = ["seqname", "strand", "island"]
    if cutoff > 0:  # positions up to the cutoff count for the clusters they lie in
        over = scored(pooled).filter(F.col("score_n") > round(cutoff * UNIT)).withColumn("end", F.col("start"))
        ranges = islands(over, ["seqname", "strand"], merge_dist).groupBy(*key).agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return tc_stats(ranges.drop("island"), pooled)
    points = scored(pooled).filter("score_n > 0").withColumn("end", F.col("start"))
    points = islands(points, ["seqname", "strand"], merge_dist, runs=("score_n", "run_ends")).withColumns({"pos": F.col("start"), "v": F.col("score_n")})
    # without a merge distance neighbouring positions are clusters of their own
    return _named(_summed(points, key, F.col("run_ends") if merge_dist else F.lit(True), F.min("pos").alias("start"), F.max("pos").alias("end")))


def tune_thresholds(pooled: Features, steps: int = 10, method: str = "minUnique", max_exponent: float = 1) -> list[int]:
    """The thresholds to try, as exact scores: 0, and either the smallest distinct scores or powers of two of the smallest."""
    values = scored(pooled).select("score_n").distinct()
    if method == "minUnique":
        return [0, *[r.score_n for r in values.orderBy("score_n").limit(steps).collect()]]
    if method == "exponential":
        least = values.agg(F.min("score_n")).first()[0]
        return [0, *[round(least * 2 ** (max_exponent * i / max(1, steps - 1))) for i in range(steps)]] if least else [0]
    raise ValueError("the search method is minUnique or exponential")


def tune_tag_clustering(pooled: Features, steps: int = 10, merge_dist: int = 20, method: str = "minUnique", max_exponent: float = 1) -> DataFrame:
    """Number of clusters at every threshold, in one job."""
    thresholds = tune_thresholds(pooled, steps, method, max_exponent)
    over = scored(pooled).withColumn("threshold_n", F.explode(F.array(*[F.lit(t).cast("long") for t in thresholds]))).filter("score_n > threshold_n").withColumn("end", F.col("start"))
    # islands are counted where they begin
    counted = islands(over, ["threshold_n", "seqname", "strand"], merge_dist).filter("island = start").groupBy("threshold_n").agg(F.count(F.lit(1)).alias("nTCs"))
    named = features_of(pooled).sparkSession.createDataFrame([(t,) for t in sorted(set(thresholds))], "threshold_n long")
    return named.join(counted, "threshold_n", "left").select(signal(F.col("threshold_n")).alias("threshold"), F.coalesce("nTCs", F.lit(0)).cast("long").alias("nTCs"))


#: Parts of a cluster's signal by which the order of its positions is dealt out.
PARTS = 64


def profile(clusters: DataFrame, pooled: Features) -> DataFrame:
    """Every position of every stranded cluster with running sums from both ends and the total, dealt by tile."""
    stranded = clusters.filter("strand != '*'").select("feature_id", "seqname", "start", "end", "strand")
    found = points_in(scored(pooled), stranded).filter("p.strand = s.strand").select("s.feature_id", F.col("p.start").alias("pos"), F.col("p.score_n").alias("v"))
    summed = running_sums(found.withColumn("fwd", F.col("v")), ["feature_id"], "pos", ["fwd"], totals=True).withColumnRenamed("total_fwd", "total")
    return summed.withColumn("rev", F.col("total") - F.col("fwd") + F.col("v"))


def trim_to_percentiles(clusters: Features, pooled: Features, percentile: float = 0.1, symmetric: bool = False) -> DataFrame:
    """Clusters without the ends that hold `percentile` of their signal; those without strand are dropped.

    Symmetric: half of it at either end.  Asymmetric: positions go in the order of the smaller of the sums from either end,
    until more than the percentile is gone.
    """
    if not 0 < percentile <= 1:
        raise ValueError("the percentile must be over 0 and 1 at most")
    clusters = features_of(clusters)
    rows = profile(clusters, pooled)
    part = F.col("total") * F.lit(float(percentile))
    if symmetric:
        kept = rows.groupBy("feature_id").agg(F.min(F.when(F.col("fwd") >= part / 2, F.col("pos"))).alias("a"), F.max(F.when(F.col("rev") >= part / 2, F.col("pos"))).alias("b"))
    else:
        # at most two positions have one sum, one from either end
        ordered = rows.select("feature_id", "pos", "total", F.least("fwd", "rev").alias("least"), F.col("v").alias("gone")).withColumn("order", F.struct("least", "pos"))
        summed = running_sums(ordered, ["feature_id"], "order", ["gone"], tile=F.floor(F.col("least") / F.col("total") * 2 * PARTS))
        kept = summed.filter(F.col("gone") > part).groupBy("feature_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    trimmed = clusters.filter("strand != '*'").select("feature_id", "seqname", "start", "end", "strand").join(kept, "feature_id", "left")
    return tc_stats(trimmed.select("seqname", F.coalesce("a", "start").alias("start"), F.coalesce("b", "end").alias("end"), "strand"), pooled)


def trim_to_peak(clusters: Features, pooled: Features, upstream: int, downstream: int) -> DataFrame:
    """Clusters cut to the surroundings of their peaks; those without strand are dropped."""
    if upstream < 1 or downstream < 1:
        raise ValueError("upstream and downstream must be 1 or more")
    rows = features_of(clusters).filter("strand != '*'")
    near = promoter(F.col("thick.start"), F.col("thick.end"), F.col("strand"), upstream, downstream)
    start, end = overlap((F.col("start"), F.col("end")), near)
    return tc_stats(rows.select("seqname", start.alias("start"), end.alias("end"), "strand"), pooled)
