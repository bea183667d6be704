"""Toxic passages by maximum-scoring segments over token log-odds, with extreme-value calibration.

A token's units are its word and the word's first five, six and seven letters.  For every unit the log-odds of
occurring in a toxic rather than a clean document has an informative Dirichlet prior, centred on the unit's rate
in all training documents, and is taken at its lower confidence bound; a token scores as its best unit, all other
tokens cost `DRIFT`.  A linear scan finds every maximal segment.  Chance segments of clean documents follow an
extreme-value law: with lambda from E[exp(lambda s)] = 1 over clean tokens and K from clean documents, a segment
of score S among n tokens has E = K n exp(-lambda S).  A document's value is log(1/P) of its best r distinct segments
together, P by the sum statistic of the same law, for the r that makes it largest: passages that are repeated word
for word count once.  Isotonic regression turns it into a probability.  The training rows are dealt into `FOLDS`
folds, and lambda, K and the probabilities come from rows scored by log-odds of the other folds; other documents are
scored by the mean of the folds' log-odds.

The training rows are bounded: of either class `MOST_TRAIN` rows at most, by hash of the id.  A training row weighs as
many labelled rows of its class as it stands for, in the prior and in the calibration, so that the bound leaves the
classes' ratio as it is.  The vocabulary has no bound but theirs: units are counted and weighed where they lie, and all
whose bound is above 0 are kept.  All documents are scored, whole.

Defined results: null text is empty; every text gets a score, the empty one the lowest; several labels of a
document count as toxic if any is; without toxic labels every score is 0; without an id a row is not held out
and has no label; rows given twice get the same score; empty tables give none; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import fit_isotonic
from .common import fold_column, materialize, narrowed, whole_text

MOST_TRAIN, LEAST_TOXIC, FOLDS = 20_000, 3, 5
#: Entries of a task's counts before they are passed on.
HELD = 400_000
PRIOR, PRIOR_SHARE, BOUND, DRIFT, EVALUE = 300.0, 0.1, 2.5, 0.08, 0.1
WORD = re.compile(r"\w+")
PREFIXES = (5, 6, 7)


def units(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def log_odds(toxic: Column, clean: Column, n_toxic: float, n_clean: float, prior: float = PRIOR, bound: float = BOUND, weigh: tuple[float, float] = (1.0, 1.0)) -> Column:
    """The lower bound of each unit's log-odds of toxic against clean; 0 where it is not above 0 or the unit is in too few toxic documents.

    The prior counts as `prior` documents, or PRIOR_SHARE of the training documents if those are few.  `weigh` has the
    labelled documents that one of the clean and of the toxic training documents stands for.
    """
    prior = min(prior, PRIOR_SHARE * (n_toxic + n_clean))
    a = prior * (weigh[1] * toxic + weigh[0] * clean) / max(1.0, weigh[1] * n_toxic + weigh[0] * n_clean)
    rate = lambda y, n: F.log((y + a) / F.greatest(n + prior - y - a, F.lit(0.5)))
    low = rate(toxic, n_toxic) - rate(clean, n_clean) - bound * F.sqrt(1 / (toxic + a) + 1 / (clean + a))
    return F.when((toxic >= LEAST_TOXIC) & (low > 0), F.round(low, 3)).otherwise(F.lit(0.0))


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [first, last] of a sequence that costs `drift` at every place not listed.

    Every held segment knows the next one to its left that begins at a lower sum, so that those in between, which
    can never be joined to a later one, are passed over at once: the time is linear in the places listed.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []  # the sum before the segment
    high: list[float] = []  # the sum with it
    lower: list[int] = []  # the nearest held segment to the left with a lower sum before it, or -1
    total, at = 0.0, -1
    for i, s in scores:
        before = total - drift * (i - at - 1)
        total, at = before + s, i
        begin, left, j = i, before, len(low) - 1
        while j >= 0:
            if low[j] >= left:
                j = lower[j]
            elif high[j] >= total:
                break
            else:
                begin, left = first[j], low[j]
                for x in (first, last, low, high):
                    del x[j:]
                j = lower[j]
                del lower[len(low) :]
        first.append(begin)
        last.append(i)
        low.append(left)
        high.append(total)
        lower.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, low, high, strict=True)]


class TokenScores(dict):
    """Word to score, found once a process and word; the memory is emptied when it grows large."""

    def __init__(self, weights: dict[str, float], most: int = 1_000_000) -> None:
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        s = self[word] = max(self.weights.get(u, 0.0) for u in units(word))
        return s


def scan(text: str, scores: TokenScores) -> tuple[int, list[tuple[int, int, float]], list[float]]:
    """The number of tokens, the segments, and the scores of those that differ in their words."""
    tokens = words(text)
    s = np.fromiter(map(scores.__getitem__, tokens), dtype=float, count=len(tokens))
    at = np.flatnonzero(s)
    if not len(at):
        return len(tokens), [], []
    found = segments(list(zip(at.tolist(), s[at].tolist(), strict=True)))
    return len(tokens), found, list({tuple(tokens[a : b + 1]): x for a, b, x in found}.values())


def value(n: int, scores: list[float], lam: float, k: float) -> float:
    """log(1/P) of the best r of the distinct segments' scores together, r as makes it largest; -20 without any.

    With x = lambda S - log(K n), the r best have P = exp(-T) T^(r-1) / (r! (r-1)!) for their sum T; the choice of r
    costs log(r + 1).
    """
    if not len(scores):
        return -20.0
    x = np.sort(lam * np.asarray(scores, dtype=float) - np.log(k * n))[::-1]
    best, total = x[0], 0.0
    for r, v in enumerate(x.tolist(), 1):
        if v <= 1:
            break
        total += v
        if r > 1:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - math.log(r + 1))
    return float(np.clip(best, -20.0, 60.0))


def fit_lambda(histogram: Counter, drift: float = DRIFT) -> float:
    """The positive root of E[exp(lambda s)] = 1 over clean tokens, by bisection."""
    total = sum(histogram.values())
    s = np.array([-drift if x == 0 else x for x in histogram], dtype=float)
    p = np.array(list(histogram.values()), dtype=float) / max(1, total)
    if not total or (s * p).sum() >= 0 or s.max() <= 0:
        return 1.0
    low, high = 1e-6, 1e-3
    while (p * np.exp(np.minimum(high * s, 600))).sum() < 1 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 600))).sum() < 1 else (low, mid)
    return float(np.clip(low, 0.05, 10.0))


def count_units(rows: DataFrame) -> DataFrame:
    """From (text, y, fold) the documents of each class and fold that hold each unit: unit, and n, one number for every
    fold and class.  Each task passes its counts on before they grow large."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def held() -> pd.DataFrame:
            return pd.DataFrame({"unit": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype=object)})

        for batch in batches:
            for text, y, fold in zip(batch.text, batch.y.tolist(), batch.fold.tolist(), strict=True):
                for u in {u for w in set(words(text)) for u in units(w)}:
                    if (n := counts.get(u)) is None:
                        n = counts[u] = [0] * (2 * FOLDS)
                    n[2 * fold + y] += 1
                if len(counts) > HELD:
                    yield held()
                    counts.clear()
        yield held()

    n = [F.sum(F.col("n")[i]).cast("double").alias(f"n{i}") for i in range(2 * FOLDS)]
    return rows.select("text", "y", "fold").mapInPandas(run, "unit string, n array<long>").groupBy("unit").agg(*n)


def fit_scores(train: DataFrame) -> list[dict[str, float]]:
    """Token units with their log-odds, from rows (text, y, weight, fold): learnt without each of the folds, and last the mean of these,
    which lies where they lie, so that what is calibrated on them holds for it."""
    sizes = {(r.y, r.fold): (r.n, r.weight) for r in train.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")).collect()}
    weigh = tuple(max((w for (y, _), (_, w) in sizes.items() if y == want), default=1.0) for want in (0, 1))
    odds = []
    for without in range(FOLDS):
        kept = [f for f in range(FOLDS) if f != without]
        clean, toxic = (sum((F.col(f"n{2 * f + y}") for f in kept), F.lit(0.0)) for y in (0, 1))
        n_clean, n_toxic = (float(sum(sizes.get((y, f), (0, 1))[0] for f in kept)) for y in (0, 1))
        odds.append(log_odds(toxic, clean, n_toxic, n_clean, weigh=weigh).alias(f"s{len(odds)}"))
    toxic = sum(F.col(f"n{2 * f + 1}") for f in range(FOLDS))
    found = count_units(train).filter(toxic >= LEAST_TOXIC).select("unit", *odds).filter(F.greatest(*[f"s{i}" for i in range(FOLDS)]) > 0).collect()
    return [*({r.unit: r[f"s{i}"] for r in found if r[f"s{i}"] > 0} for i in range(FOLDS)), {r.unit: round(sum(r[1:]) / FOLDS, 3) for r in found}]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, mod: int, held: int) -> DataFrame:
    own = narrowed(labels, [id_col, label_col]).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    own = own.filter(F.col("y").isin(0, 1) & (fold_column("doc_id", mod) != held)).groupBy("doc_id").agg(F.max("y").alias("y"))
    place = F.xxhash64("doc_id", F.lit(7))
    sizes = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = [own.filter(F.col("y") == y).orderBy(place, "doc_id").limit(MOST_TRAIN).withColumn("weight", F.lit(max(1.0, sizes.get(y, 0) / MOST_TRAIN))) for y in (0, 1)]
    sample = F.broadcast(sample[0].unionByName(sample[1]))  # 2 * MOST_TRAIN rows of three numbers at most
    return docs.join(sample, "doc_id").select("doc_id", "text", "y", "weight", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_mod: int = 3, held_out_is: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, n_passages and passages (first and last token, score).

    Labels of held-out rows are never read.
    """
    spark = docs.sparkSession
    rows = narrowed(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    held = F.coalesce(fold_column("doc_id", held_out_mod) == held_out_is, F.lit(False))
    train = materialize(labelled(rows, labels, id_col, label_col, held_out_mod, held_out_is), "labelled")
    weights = fit_scores(train)
    if not any(weights):
        return rows.select("doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(int(threshold <= 0)).alias("predicted"), F.lit(0).alias("n_passages"), F.lit("").alias("passages"))
    shared = spark.sparkContext.broadcast(weights)  # what the bounded training rows show to be toxic

    def clean_tokens(batches):
        scores, histogram = [TokenScores(w) for w in shared.value], Counter()
        for batch in batches:
            for text, fold in zip(batch.text, batch.fold.tolist(), strict=True):
                histogram.update(map(scores[fold].__getitem__, words(text)))
        yield pd.DataFrame({"s": list(histogram), "n": list(histogram.values())}).astype({"s": "float64", "n": "int64"})

    clean = train.filter("y = 0").select("text", "fold")
    histogram = Counter({r.s: r.n for r in clean.mapInPandas(clean_tokens, "s double, n long").groupBy(F.round("s", 1).alias("s")).agg(F.sum("n").alias("n")).collect()})
    lam = fit_lambda(histogram)

    def outcomes(batches):
        """Of a training row its best segment's lambda S - log n, the number of its tokens, and its distinct segments' scores."""
        scores = [TokenScores(w) for w in shared.value]
        for batch in batches:
            done = [scan(t, scores[f]) for t, f in zip(batch.text, batch.fold.tolist(), strict=True)]
            best = [lam * max(s) - np.log(n) if s else None for n, _, s in done]
            yield pd.DataFrame({"best": pd.array(best, dtype="Float64"), "n": [n for n, *_ in done], "s": [s for *_, s in done], "y": batch.y.astype(float), "weight": batch.weight})

    scanned = materialize(train.select("text", "fold", "y", "weight").mapInPandas(outcomes, "best double, n long, s array<double>, y double, weight double"), "scanned")
    mean = scanned.filter("y = 0").agg(F.avg("best")).first()[0]
    k = float(np.exp(mean - 0.5772156649)) if mean is not None else 1.0

    def raw(batches):
        for batch in batches:
            yield pd.DataFrame({"raw": [value(n, s, lam, k) for n, s in zip(batch.n, batch.s, strict=True)], "y": batch.y, "weight": batch.weight})

    calibrated = fit_isotonic(scanned.mapInPandas(raw, "raw double, y double, weight double"), -20.0, 60.0, 800)

    def score(batches):
        scores = TokenScores(shared.value[-1])
        for batch in batches:
            done = [scan(t, scores) for t in batch.text]
            kept = [[x for x in f if lam * x[2] - math.log(k * n) > -math.log(EVALUE)] for n, f, _ in done]
            yield pd.DataFrame(
                {"doc_id": batch.doc_id, "score": calibrated(np.array([value(n, s, lam, k) for n, _, s in done])), "n_passages": [len(f) for f in kept], "passages": [";".join(f"{a}:{b}:{s:.2f}" for a, b, s in f) for f in kept]}
            )

    scored = rows.mapInPandas(score, "doc_id long, score double, n_passages int, passages string")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "passages")
