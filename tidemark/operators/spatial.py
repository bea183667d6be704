"""Stretches of features, links between them, and the correlation of their expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import center, gap
from ..functions.stats import METHODS
from ..model import Experiment, Features, features_of
from ..plans.overlaps import overlap_pairs
from ..plans.tiles import islands


def _members(features: DataFrame, merge_dist: int) -> DataFrame:
    return islands(features.select("feature_id", "seqname", "start", "end"), ["seqname"], merge_dist)


def find_stretches(x: Features, merge_dist: int = 10_000, min_size: int = 3) -> DataFrame:
    """Groups of at least `min_size` features, whatever their strands, with gaps under `merge_dist`.

    revmap lists their members by start and end.
    """
    found = _members(features_of(x), merge_dist).groupBy("seqname", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).cast("int").alias("nClusters"), F.sort_array(F.collect_list(F.struct("start", "end", "feature_id"))).alias("m")
    )
    name = F.concat(F.col("seqname"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    return found.filter(F.col("nClusters") >= min_size).select("seqname", "start", "end", F.lit("*").alias("strand"), name.alias("feature_id"), F.col("m.feature_id").alias("revmap"), "nClusters")


def vectors(exp: Experiment, assay: str) -> DataFrame:
    """feature_id and its values in all samples, in the order of sample_rank; zeros are filled in.

    A vector is as long as the stated number of samples, so it fits a row.
    """
    names = [r.sample for r in exp.samples.select("sample", "sample_rank").orderBy("sample_rank").collect()]
    held = exp.expr.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", F.col(assay).cast("double")))).alias("__m"))
    rows = exp.features.select("feature_id").join(held, "feature_id", "left")
    value = [F.coalesce(F.try_element_at(F.col("__m"), F.lit(n)), F.lit(0.0)) for n in names]
    return rows.select("feature_id", F.array(*value).alias("vec"))


def pearson_column(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays, null for constant ones."""
    n = F.size(a).cast("double")

    def mean(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def centred(v: Column) -> Column:
        m = mean(v)
        return F.transform(v, lambda x: x - m)

    x, y = centred(a), centred(b)
    scale = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(scale > 0, dot(x, y) / scale)


def _orientation() -> Column:
    one, two = center(F.col("a.start"), F.col("a.end")), center(F.col("b.start"), F.col("b.end"))
    return F.when(F.when(F.col("a.strand") == "+", one >= two).otherwise(one <= two), "upstream").otherwise("downstream")


def find_links(x: Features, max_dist: int = 10_000, directional: str | None = None, levels: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of features on compatible strands with a gap of at most `max_dist`, each once, and their distance.

    With `directional`, a column of two values, only pairs of the two: anchor1 has the first of `levels`, and
    `orientation` says on which side of it anchor2 lies.
    """
    features = features_of(x)
    if directional is None:
        rows = features.select("seqname", "start", "end", "strand", "feature_id")
        pairs = overlap_pairs(rows, rows, max_dist).select(F.col("q").alias("a"), F.col("s").alias("b"))
        order = lambda v: F.struct(F.col(f"{v}.start"), F.col(f"{v}.end"), F.col(f"{v}.strand"), F.col(f"{v}.feature_id"))
        pairs, more = pairs.filter(order("a") < order("b")), []
    else:
        if levels is None:
            levels = tuple(r[0] for r in features.select(directional).distinct().orderBy(directional).limit(3).collect())
        if len(levels) != 2:
            raise ValueError(f"{directional} must have exactly two values")
        rows = features.select("seqname", "start", "end", "strand", "feature_id", directional)
        pairs = overlap_pairs(rows.filter(F.col(directional) == levels[0]), rows.filter(F.col(directional) == levels[1]), max_dist).select(F.col("q").alias("a"), F.col("s").alias("b"))
        more = [_orientation().alias("orientation")]
    far = gap((F.col("a.start"), F.col("a.end")), (F.col("b.start"), F.col("b.end")))
    return pairs.select(F.col("a.feature_id").alias("anchor1"), F.col("b.feature_id").alias("anchor2"), far.alias("distance"), *more)


def link_correlations(links: DataFrame, exp: Experiment, assay: str, method: str | Callable = "pearson", values: tuple[str, ...] = ("estimate", "p_value")) -> DataFrame:
    """Adds the statistics of each link's two vectors.

    Pearson's estimate alone is computed with SQL functions; `method` may also be a function of two arrays that returns as many
    numbers as `values` names.
    """
    vec = vectors(exp, assay)
    one, two = vec.select(F.col("feature_id").alias("anchor1"), F.col("vec").alias("__a")), vec.select(F.col("feature_id").alias("anchor2"), F.col("vec").alias("__b"))
    joined = links.join(one, "anchor1").join(two, "anchor2")
    if method == "pearson" and values == ("estimate",):
        return joined.withColumn("estimate", pearson_column(F.col("__a"), F.col("__b"))).drop("__a", "__b")
    test = METHODS[method] if isinstance(method, str) else method

    @F.pandas_udf(", ".join(f"{v} double" for v in values))
    def tested(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [np.atleast_1d(np.array(test(np.asarray(x), np.asarray(y)), dtype=object)) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({v: pd.array([None if g[i] is None or g[i] != g[i] else float(g[i]) for g in got], dtype="Float64") for i, v in enumerate(values)})

    return joined.withColumn("__t", tested("__a", "__b")).select("*", *[F.col(f"__t.{v}").alias(v) for v in values]).drop("__a", "__b", "__t")


def find_links_with_correlation(exp: Experiment, assay: str, max_dist: int = 10_000, directional: str | None = None, levels: tuple[str, str] | None = None, method: str | Callable = "pearson", values: tuple[str, ...] = ("estimate", "p_value")) -> DataFrame:
    return link_correlations(find_links(exp, max_dist, directional, levels), exp, assay, method, values)


def mean_pearson(exp: Experiment, assay: str, merge_dist: int) -> DataFrame:
    """Mean correlation of all pairs of a stretch's members, as feature_id of the stretch and aveCor, in one grouped pass.

    With vectors centred and of unit length, the sum of all m members' vectors has the squared length m + 2 sum(r), so
    no pair is ever a row.
    """
    n = exp.samples.count()
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    mean = size(F.col("vec")) / n
    rows = vectors(exp, assay).withColumn("vec", F.transform("vec", lambda x: x - mean))
    norm = F.sqrt(size(F.transform("vec", lambda x: x * x)))
    unit = F.when(norm > 0, F.transform("vec", lambda x: x / norm))
    rows = _members(exp.features, merge_dist).join(rows.select("feature_id", unit.alias("vec")), "feature_id")
    sums = [F.sum(F.element_at("vec", i + 1)).alias(f"s{i}") for i in range(n)]
    found = rows.groupBy("seqname", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("m"), F.count_if(F.col("vec").isNull()).alias("constant"), *sums)
    m = F.col("m")
    length = sum((F.col(f"s{i}") ** 2 for i in range(n)), F.lit(0.0))
    name = F.concat(F.col("seqname"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    return found.filter("m > 1").select(name.alias("feature_id"), F.when(F.col("constant") == 0, (length - m) / (m * (m - 1))).alias("aveCor"))


def find_stretches_with_correlation(exp: Experiment, assay: str, merge_dist: int = 10_000, min_size: int = 3, method: str | Callable = "pearson") -> DataFrame:
    """Stretches with aveCor, the mean correlation of their pairs, null where any pair has none."""
    stretches = find_stretches(exp, merge_dist, min_size)
    if method == "pearson":
        return stretches.join(mean_pearson(exp, assay, merge_dist), "feature_id", "left")
    member = stretches.select(F.col("feature_id").alias("stretch"), F.posexplode("revmap").alias("i", "feature_id"))
    one = member.select("stretch", "i", F.col("feature_id").alias("anchor1"))
    two = member.select("stretch", F.col("i").alias("j"), F.col("feature_id").alias("anchor2"))
    pairs = one.join(two, "stretch").filter("i < j")
    of_pairs = link_correlations(pairs, exp, assay, method)
    mean = of_pairs.groupBy("stretch").agg(F.when(F.count_if(F.col("estimate").isNull()) == 0, F.avg("estimate")).alias("aveCor"))
    return stretches.join(mean.withColumnRenamed("stretch", "feature_id"), "feature_id", "left")
