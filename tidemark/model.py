"""The data model: features, samples and expression as DataFrames.

A feature table has `seqname`, `start`, `end` (1-based, both inclusive) and `strand` (`+`, `-` or `*`), and any
further columns.  Expression is long: one row for a feature and sample that is not zero.  An absent row is a zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRANDS = ("+", "-", "*")
#: Signals are compared and summed as integers of this many decimal digits.
DIGITS = 9
UNIT = 10**DIGITS
CTSS_KEY = ("seqname", "start", "strand")


@dataclass(frozen=True)
class Experiment:
    """Features with the expression of samples.

    `key` names the columns that tell features apart, in `features` and in `expr`; `expr` also has `sample` and
    one column for every assay; `samples` has `sample`, `sample_rank` and the design; `seqinfo` has `seqname`,
    `seqlength` and `seq_rank`.
    """

    features: DataFrame
    samples: DataFrame
    expr: DataFrame
    seqinfo: DataFrame
    key: tuple[str, ...] = ("feature_id",)
    metadata: tuple = field(default=())
    #: The features are the keys of `expr`, without columns of their own.
    plain: bool = False

    def with_(self, **changes) -> Experiment:
        return replace(self, **({"plain": False} if "features" in changes or "expr" in changes else {}) | changes)

    @property
    def assays(self) -> list[str]:
        return [c for c in self.expr.columns if c not in (*self.key, "sample")]


Features = DataFrame | Experiment


def features_of(x: Features) -> DataFrame:
    return x.features if isinstance(x, Experiment) else x


def same_kind(x: Features, features: DataFrame, narrow: bool = False) -> Features:
    """`features` in place of x's own; with `narrow` the expression keeps only what is left."""
    if not isinstance(x, Experiment):
        return features
    if narrow:
        return x.with_(features=features, expr=x.expr.join(features.select(*x.key), list(x.key), "left_semi"))
    return x.with_(features=features)


def endomorphic(f: Callable) -> Callable:
    """Lets a function from features to features with the same rows take an Experiment too."""

    def wrapped(x: Features, *args, **kwargs) -> Features:
        return same_kind(x, f(features_of(x), *args, **kwargs))

    wrapped.__doc__, wrapped.__name__ = f.__doc__, f.__name__
    return wrapped


def exact(signal: Column) -> Column:
    """A signal as an integer of DIGITS decimal digits."""
    return F.round(signal * UNIT).cast("long")


def signal(score_n: Column) -> Column:
    return score_n / F.lit(float(UNIT))


def strand_rank(strand: Column | str = "strand") -> Column:
    strand = F.col(strand) if isinstance(strand, str) else strand
    return F.when(strand == "+", 1).when(strand == "-", 2).otherwise(3)


def strands_match(a: Column, b: Column, ignore: bool = False) -> Column:
    return F.lit(True) if ignore else (a == b) | (a == "*") | (b == "*")


def with_columns_first(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])
