"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (lengths, character classes, repetition of words, word pairs and lines) are
standardised with their means and deviations over all documents and mapped to `FOURIER` cosine features whose
inner products approximate a Gaussian kernel.  Each partition of labelled rows adds up its normal equations for
every fold; only the sums, of fixed size, reach the driver.  A row's raw score for the calibration comes from
the folds it is not in; isotonic regression turns raw scores into probabilities.

Defined results: null text is empty; all texts, the empty one too, get a score; several labels of a document
count by their mean, null labels not at all; without labels every score is 0.5; without an id a row is
not held out and has no label; further columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import fit_isotonic, summed
from .common import fold_column, materialize, narrowed, row_key, whole_text, without

FOURIER, FOLDS, RIDGE, WIDTH, SEED = 256, 4, 1.0, 1.0, 20_240_501
#: Partitions of labelled rows, hence the number of partial sums.
SUM_PARTITIONS = 64
ROW_BLOCK = 32
MARKS = {"pipe": b"|", "bang": b"!", "symbols": b"*%$#&@^~=+<>\\", "stops": b".,;:?", "quotes": b"\"'()[]{}", "tabs": b"\t", "lines": b"\n", "spaces": b" "}
CLASSES = np.zeros((256, len(MARKS) + 4))
for _i, _chars in enumerate(MARKS.values()):
    CLASSES[list(_chars), _i] = 1
CLASSES[ord("a") : ord("z") + 1, -4] = 1
CLASSES[ord("A") : ord("Z") + 1, -3] = 1
CLASSES[ord("0") : ord("9") + 1, -2] = 1
CLASSES[128:, -1] = 1
N_STATISTICS = CLASSES.shape[1] + 14


def statistics(text: str) -> np.ndarray:
    """What the classifier knows of a text; all are finite for every text."""
    out = np.zeros(N_STATISTICS, dtype=np.float32)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    share = counts / counts.sum()
    k = CLASSES.shape[1]
    out[:k] = np.sqrt(share @ CLASSES)
    words, lines = text.split(), text.split("\n")
    n, pairs = max(1, len(words)), list(zip(words, words[1:], strict=False))
    alike = sum(map(eq, words, words[1:]))
    several = [x for x in lines if len(x) > 3]
    used = share[share > 0]
    letters = share @ CLASSES[:, -4:-2]
    lengths = list(map(len, words)) or [0]
    distinct = len(set(words))
    out[k:] = (
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n if len(text) < 40 * n else 40, min(max(lengths), 60), distinct / n, np.log1p(distinct) / np.log1p(n), len(set(pairs)) / max(1, len(pairs)),
        np.sqrt(alike / n), len(set(several)) / max(1, len(several)), np.log1p(len(text) / len(lines)), -(used * np.log2(used)).sum(), letters[1] / max(1e-9, letters.sum()), sum(x == 1 for x in lengths) / n,
        np.sqrt(sum(not w[-1].isalnum() for w in words) / n),
    )
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "key": batch.key, "x": [statistics(t) for t in batch.text]})

    rows = narrowed(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), whole_text(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, key long, x array<float>")


def fourier_map(mean: np.ndarray, deviation: np.ndarray, features: int = FOURIER, width: float = WIDTH):
    """Statistics to features: an intercept, then cosines of random projections."""
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((len(mean), features)) / (width * np.sqrt(len(mean)))
    b = rng.uniform(0, 2 * np.pi, features)
    scale = np.where(deviation > 1e-9, deviation, 1.0)

    def apply(x: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / features) * np.cos(z @ w + b)])

    return apply


def normal_equations(train: DataFrame, phi, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every fold the sums of phi'phi and phi'y, as arrays [fold, size, size] and [fold, size]."""
    blocks = -(-size // ROW_BLOCK)

    def run(batches):
        a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            f, y, part = phi(np.stack(batch.x.to_list())), batch.y.to_numpy(dtype=float), batch["part"].to_numpy()
            for k in range(FOLDS):
                a[k] += f[part == k].T @ f[part == k]
                b[k] += f[part == k].T @ y[part == k]
        whole = np.concatenate([a, b[:, :, None]], axis=2)
        yield pd.DataFrame({"key": range(FOLDS * blocks), "value": [whole[k, i * ROW_BLOCK : (i + 1) * ROW_BLOCK].tobytes() for k in range(FOLDS) for i in range(blocks)]})

    found = summed(train.coalesce(SUM_PARTITIONS).mapInPandas(run, "key int, value binary"))
    whole = np.stack([np.vstack([found[k * blocks + i].reshape(-1, size + 1) for i in range(blocks)]) for k in range(FOLDS)])
    return whole[:, :, :size], whole[:, :, size]


def solve(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    penalty = ridge * np.eye(len(b))
    penalty[0, 0] = 1e-6
    return np.linalg.solve(a + penalty, b)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out_mod: int = 5, held_out_is: int = 0, threshold: float = 0.3, ridge: float = RIDGE) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, key.  Labels of held-out rows are never read."""
    seen = materialize(with_statistics(docs, id_col, text_col), "statistics")
    own = narrowed(labels, [id_col, label_col]).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("y"))
    own = own.filter(F.col("y").isNotNull() & (fold_column("doc_id", held_out_mod) != held_out_is)).groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = seen.join(own, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("part"))
    train = materialize(train, "labelled")
    held = F.coalesce(fold_column("doc_id", held_out_mod) == held_out_is, F.lit(False))
    if train.isEmpty():
        return seen.select("doc_id", held.alias("held_out"), F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"), "key")
    moments = seen.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(N_STATISTICS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    phi = fourier_map(np.array([moments[f"m{i}"] for i in range(N_STATISTICS)]), np.array([moments[f"s{i}"] for i in range(N_STATISTICS)]))
    a, b = normal_equations(train, phi, FOURIER + 1)
    weights = solve(a.sum(0), b.sum(0), ridge)
    others = np.stack([solve(a.sum(0) - a[k], b.sum(0) - b[k], ridge) for k in range(FOLDS)])

    def out_of_fold(batches):
        for batch in batches:
            f = phi(np.stack(batch.x.to_list()))
            yield pd.DataFrame({"raw": (f * others[batch["part"].to_numpy()]).sum(1), "y": batch.y})

    calibrated = fit_isotonic(train.mapInPandas(out_of_fold, "raw double, y double"), -0.5, 1.5)

    def score(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"doc_id": batch.doc_id, "key": batch.key, "score": calibrated(phi(np.stack(batch.x.to_list())) @ weights)})

    scored = seen.mapInPandas(score, "doc_id long, key long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "key")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that the classifier rejects."""
    return without(docs, score_quality(docs, labels, id_col, text_col).filter("predicted = 0"), id_col, text_col)
