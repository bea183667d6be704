"""Isotonic calibration over binned scores, and sums of arrays over partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool_adjacent(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to `means` in weighted squares."""
    blocks: list[list[float]] = []
    for w, m in zip(weights, means, strict=True):
        blocks.append([float(w), float(m), 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks]) if blocks else np.zeros(0)


class Isotonic:
    """A non-decreasing map from a raw score to a probability, linear between the fitted points.

    A thousandth of the result is the raw score's place in its range, so that equal probabilities keep their order.
    """

    def __init__(self, x, weights, means, prior: float = 0.5) -> None:
        x, weights, means = (np.asarray(v, dtype=float) for v in (x, weights, means))
        order = np.argsort(x)
        self.x, self.prior = x[order], prior
        # each point is drawn towards the prior by half a row
        self.y = pool_adjacent(weights[order] + 0.5, (weights[order] * means[order] + 0.5 * prior) / (weights[order] + 0.5))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        raw = np.asarray(raw, dtype=float)
        if not len(self.x):
            return np.full(len(raw), self.prior)
        low, high = self.x[0], self.x[-1]
        place = np.clip((raw - low) / max(high - low, 1e-9), 0, 1)
        return np.clip(0.999 * np.interp(raw, self.x, self.y) + 0.001 * place, 0.0, 1.0)


def fit_isotonic(scored: DataFrame, low: float, high: float, bins: int = 2000) -> Isotonic:
    """`scored` has raw and y, and weight if rows stand for more than themselves; rows are counted by bin where they lie, and at
    most `bins` + 1 rows reach the driver."""
    step = (high - low) / bins
    binned = scored.select(F.round((F.greatest(F.lit(low), F.least(F.lit(high), F.col("raw"))) - low) / step).cast("int").alias("bin"), "y", F.col("weight") if "weight" in scored.columns else F.lit(1.0).alias("weight"))
    rows = binned.groupBy("bin").agg(F.sum("weight").alias("n"), (F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("mean")).toPandas()
    prior = float((rows["n"] * rows["mean"]).sum() / rows["n"].sum()) if len(rows) else 0.5
    return Isotonic(low + step * rows["bin"].to_numpy(dtype=float), rows["n"], rows["mean"], prior)


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Adds up `parts` (key int, value binary of doubles) by key; the keys and lengths must not depend on the data's size."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(frame["value"].iloc[0]).copy()
        for v in frame["value"].iloc[1:]:
            total += np.frombuffer(v)
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "value": [total.tobytes()]})

    return {r.key: np.frombuffer(bytes(r.value)) for r in parts.groupBy("key").applyInPandas(add, "key int, value binary").collect()}
