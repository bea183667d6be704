"""Shape statistics of clusters: one number from the signal along each cluster, from left to right."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import width
from ..model import UNIT, Features, features_of, same_kind
from ..plans.overlaps import points_in
from .cluster import profile, scored


def _points(clusters: Features, pooled: Features) -> DataFrame:
    stranded = features_of(clusters).filter("strand != '*'").select("feature_id", "seqname", "start", "end", "strand")
    found = points_in(scored(pooled), stranded).filter("p.strand = s.strand")
    return found.select(F.col("s.feature_id").alias("feature_id"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("p.start").alias("pos"), F.col("p.score_n").alias("v"))


def _attached(clusters: Features, stats: DataFrame, output: str) -> Features:
    rows = features_of(clusters).drop(output)
    return same_kind(clusters, rows.join(stats.select("feature_id", F.col("__stat").cast("double").alias(output)), "feature_id", "left"))


def shape_iqr(clusters: Features, pooled: Features, lower: float = 0.25, upper: float = 0.75, output: str = "IQR") -> Features:
    """Distance between the positions where the running share of the signal reaches two quantiles."""
    running = profile(features_of(clusters), pooled)

    def first(q: float) -> Column:
        return F.min(F.when(F.col("fwd") >= F.col("total") * F.lit(float(q)), F.col("pos")))

    return _attached(clusters, running.groupBy("feature_id").agg((first(upper) - first(lower)).alias("__stat")), output)


def shape_entropy(clusters: Features, pooled: Features, output: str = "entropy") -> Features:
    """Shannon entropy of the signal, in bits."""
    points = _points(clusters, pooled)
    totals = points.groupBy("feature_id").agg(F.sum("v").alias("total"))
    share = F.col("v") / F.col("total")
    return _attached(clusters, points.join(totals, "feature_id").groupBy("feature_id").agg((-F.sum(share * F.log2(share))).alias("__stat")), output)


def shape_mean(clusters: Features, output: str = "mean") -> Features:
    """The mean of the positions 1 .. width, whatever the signal."""
    stats = features_of(clusters).filter("strand != '*'").select("feature_id", ((width(F.col("start"), F.col("end")) + 1) / 2).alias("__stat"))
    return _attached(clusters, stats, output)


def shape_weighted_mean(clusters: Features, pooled: Features, output: str = "weighted_mean") -> Features:
    """The mean position, from 1, weighted by the signal."""
    points = _points(clusters, pooled)
    stats = points.groupBy("feature_id").agg((F.sum((F.col("pos") - F.col("start") + 1) * F.col("v").cast("double")) / F.sum(F.col("v").cast("double"))).alias("__stat"))
    return _attached(clusters, stats, output)


def calc_shape(clusters: Features, pooled: Features, shape: Callable[..., float], output: str = "shape", **arguments) -> Features:
    """Any function from the dense signal of a cluster, as an array, to a number.  Clusters without strand get null.

    Clusters are dealt out and sorted, and a task reads them one after the other: what meets in memory is one cluster's
    positions, an array as long as the cluster is wide.
    """

    def run(batches):
        held = None
        for batch in _ended(batches):
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            names = batch["feature_id"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
            # the last cluster may go on in the next batch; the end is a row without name
            first, last, at, v = (batch[c].to_numpy() for c in ("start", "end", "pos", "v"))
            out = []
            for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):
                x = np.zeros(last[low] - first[low] + 1)
                x[at[low:high] - first[low]] = v[low:high] / UNIT
                out.append((names[low], float(shape(x, **arguments))))
            held = batch.iloc[cuts[-2] :]
            yield pd.DataFrame(out, columns=["feature_id", "__stat"])

    points = _points(clusters, pooled).repartition("feature_id").sortWithinPartitions("feature_id", "pos")
    return _attached(clusters, points.mapInPandas(run, "feature_id string, __stat double"), output)


def _ended(batches):
    yield from (b for b in batches if len(b))
    yield pd.DataFrame({"feature_id": [""], "start": [0], "end": [0], "pos": [0], "v": [0]})


def isotonic_rss(y: np.ndarray) -> np.ndarray:
    """For every prefix of y the residual sum of squares of its isotonic fit, pooling adjacent violators once."""
    out, blocks, rss = np.zeros(len(y)), [], 0.0
    for i, v in enumerate(y):
        blocks.append((1, float(v), 0.0))  # size, mean, own sum of squares
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            n2, m2, s2 = blocks.pop()
            n1, m1, s1 = blocks.pop()
            n = n1 + n2
            more = n1 * n2 / n * (m1 - m2) ** 2
            rss += more
            blocks.append((n, (n1 * m1 + n2 * m2) / n, s1 + s2 + more))
        out[i] = rss
    return out


def multimodality(x: np.ndarray) -> float:
    """How far a signal is from rising to one mode and falling from it: the least residual sum of squares over all modes."""
    return float((isotonic_rss(x) + isotonic_rss(x[::-1])[::-1]).min())


def shape_multimodality(clusters: Features, pooled: Features, output: str = "multimodality") -> Features:
    return calc_shape(clusters, pooled, multimodality, output)
