"""Annotation of features with transcript and gene models, and combination of clusters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import distance, five_prime, hull, invert_strand, promoter, trim
from ..model import Experiment, Features, endomorphic, features_of, same_kind
from ..plans.overlaps import overlap_pairs, overlapping

CATEGORIES = ("promoter", "proximal", "fiveUTR", "threeUTR", "CDS", "exon", "intron", "antisense")
RANGE = ("seqname", "start", "end", "strand")


@dataclass(frozen=True)
class TranscriptModels:
    """Tables (tx_id, gene_id, seqname, start, end, strand), exons and the like with one row for each part."""

    transcripts: DataFrame
    exons: DataFrame
    cds: DataFrame
    utr5: DataFrame
    utr3: DataFrame

    def genes(self) -> DataFrame:
        """One range for each gene, sequence and strand."""
        return self.transcripts.groupBy("gene_id", "seqname", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))

    def introns(self) -> DataFrame:
        """What lies between neighbouring exons of a transcript."""
        of_tx = Window.partitionBy("tx_id").orderBy("start")
        spaced = self.exons.withColumn("__next", F.lead("start").over(of_tx))
        return spaced.filter(F.col("__next") > F.col("end") + 1).select("tx_id", "seqname", (F.col("end") + 1).alias("start"), (F.col("__next") - 1).alias("end"), "strand")


def _around_tss(df: DataFrame, seqinfo: DataFrame, upstream: int, downstream: int) -> DataFrame:
    start, end = promoter(F.col("start"), F.col("end"), F.col("strand"), upstream, downstream)
    return trim(df.select("seqname", start.alias("start"), end.alias("end"), "strand"), seqinfo)


def simplify_models(models: TranscriptModels, seqinfo: DataFrame, tss_upstream: int = 100, tss_downstream: int = 100, proximal_upstream: int = 1000, detailed_antisense: bool = False) -> DataFrame:
    """The models as ranges of ordered categories: `category` and `hierarchy`, the rank that wins first."""
    parts = {
        "promoter": _around_tss(models.transcripts, seqinfo, tss_upstream, tss_downstream),
        "proximal": _around_tss(models.transcripts, seqinfo, proximal_upstream, 0),
        "fiveUTR": models.utr5, "threeUTR": models.utr3, "CDS": models.cds, "exon": models.exons, "intron": models.introns(),
    }
    listed = [(name, df.select(*RANGE)) for name, df in parts.items()]
    turned = lambda df: df.select("seqname", "start", "end", invert_strand(F.col("strand")).alias("strand"))
    if detailed_antisense:
        listed += [(f"antisense_{name}", turned(df)) for name, df in listed]
    else:
        listed.append(("antisense", turned(models.transcripts.select(*RANGE))))
    return reduce(DataFrame.unionByName, (df.withColumns({"category": F.lit(name), "hierarchy": F.lit(i)}) for i, (name, df) in enumerate(listed)))


def _query(features: DataFrame, swap: str | None) -> DataFrame:
    """The ranges to look up: the features' own, or those of an interval column."""
    if swap is None:
        return features.select("feature_id", *RANGE)
    return features.select("feature_id", "seqname", F.col(f"{swap}.start").alias("start"), F.col(f"{swap}.end").alias("end"), "strand")


@endomorphic
def assign_tx_type(features: DataFrame, categories: DataFrame, output: str = "txType", swap: str | None = None, no_overlap: str = "intergenic") -> DataFrame:
    """Adds the first category, in their order, that a feature overlaps."""
    hits = overlap_pairs(_query(features, swap), categories.select(*RANGE, "category", "hierarchy"))
    best = hits.groupBy(F.col("q.feature_id").alias("feature_id")).agg(F.min_by("s.category", "s.hierarchy").alias("__category"))
    return features.drop(output).join(best, "feature_id", "left").withColumn(output, F.coalesce("__category", F.lit(no_overlap))).drop("__category")


def assign_tx_type_from_models(x: Features, models: TranscriptModels, seqinfo: DataFrame, output: str = "txType", swap: str | None = None, no_overlap: str = "intergenic", **reach) -> Features:
    return assign_tx_type(x, simplify_models(models, seqinfo, **reach), output, swap, no_overlap)


@endomorphic
def assign_gene_id(features: DataFrame, genes: DataFrame, seqinfo: DataFrame, output: str = "geneID", swap: str | None = None, upstream: int = 1000, downstream: int = 100) -> DataFrame:
    """Adds the gene whose range, with the surroundings of its start, a feature overlaps.

    Of several the one whose start is nearest to the feature's whole range, then the first by `row_idx`.
    """
    own = (F.col("start"), F.col("end"))
    start, end = hull(own, promoter(*own, F.col("strand"), upstream, downstream))
    tss = five_prime(*own, F.col("strand"))
    wide = trim(genes.select("gene_id", "row_idx", "seqname", "strand", tss.alias("tss"), start.alias("start"), end.alias("end")), seqinfo)
    whole = features.select("feature_id", F.struct("start", "end").alias("whole"))
    hits = overlap_pairs(_query(features, swap).join(whole, "feature_id") if swap else _query(features, None).withColumn("whole", F.struct("start", "end")), wide)
    far = distance((F.col("q.whole.start"), F.col("q.whole.end")), (F.col("s.tss"), F.col("s.tss")))
    best = hits.groupBy(F.col("q.feature_id").alias("feature_id")).agg(F.min_by("s.gene_id", F.struct(far, F.col("s.row_idx"))).alias("__gene"))
    return features.drop(output).join(best, "feature_id", "left").withColumnRenamed("__gene", output)


def assign_gene_id_from_models(x: Features, models: TranscriptModels, seqinfo: DataFrame, **options) -> Features:
    """The same from transcript models; genes are numbered by their ids."""
    genes = models.genes()
    return assign_gene_id(x, genes.withColumn("row_idx", F.col("gene_id")), seqinfo, **options)


@endomorphic
def assign_tx_id(features: DataFrame, transcripts: DataFrame, output: str = "txID", swap: str | None = None) -> DataFrame:
    """Adds the ids of all overlapping transcripts (tx_id, row_idx), in the order of row_idx, joined by semicolons."""
    hits = overlap_pairs(_query(features, swap), transcripts.select("tx_id", "row_idx", *RANGE))
    names = hits.groupBy(F.col("q.feature_id").alias("feature_id")).agg(F.sort_array(F.collect_list(F.struct("s.row_idx", "s.tx_id"))).alias("__ids"))
    joined = names.select("feature_id", F.array_join(F.col("__ids.tx_id"), ";").alias("__names"))
    return features.drop(output).join(joined, "feature_id", "left").withColumnRenamed("__names", output)


def assign_tx_id_from_models(x: Features, models: TranscriptModels, seqinfo: DataFrame, output: str = "txID", swap: str | None = None, upstream: int = 1000, downstream: int = 0, compat: bool = False) -> Features:
    """The same from transcript models widened by the surroundings of their starts.  `compat` leaves `swap` out of account."""
    own = (F.col("start"), F.col("end"))
    start, end = hull(own, promoter(*own, F.col("strand"), upstream, downstream))
    wide = trim(models.transcripts.select("tx_id", "seqname", "strand", start.alias("start"), end.alias("end")), seqinfo)
    return assign_tx_id(x, wide.withColumn("row_idx", F.col("tx_id")), output, None if compat else swap)


def combine_clusters(a: Features, b: Features, remove: str = "none") -> Features:
    """Rows of both, with the columns and assays they share.  `remove` names the side whose overlapping rows go."""
    if remove not in ("none", "object1", "object2"):
        raise ValueError("remove is none, object1 or object2")
    left, right = features_of(a), features_of(b)
    if remove == "object1":
        left = overlapping(left, right, "feature_id", anti=True)
    elif remove == "object2":
        right = overlapping(right, left, "feature_id", anti=True)
    shared = [c for c in left.columns if c in right.columns]
    rows = left.select(*shared).unionByName(right.select(*shared))
    if not (isinstance(a, Experiment) and isinstance(b, Experiment)):
        return rows
    if a.key != b.key or a.samples.columns != b.samples.columns or not a.samples.exceptAll(b.samples).isEmpty() or not b.samples.exceptAll(a.samples).isEmpty():
        raise ValueError("both experiments must have the same samples")
    assays = [x for x in a.assays if x in b.assays]
    ones = same_kind(a, left, narrow=True).expr.select(*a.key, "sample", *assays)
    twos = same_kind(b, right, narrow=True).expr.select(*a.key, "sample", *assays)
    return a.with_(features=rows, expr=ones.unionByName(twos), metadata=tuple(dict.fromkeys(a.metadata + b.metadata)))
