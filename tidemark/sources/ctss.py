"""Experiments over positions from files with the counts of each sample and strand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Experiment
from ..operators.assay import ctss_experiment
from .bedgraph import read_bedgraph
from .bigwig import read_bigwig
from .genomes import check_bigwigs, check_compatible, check_files, common_genome


def clean_design(spark: SparkSession, names: list[str], design: DataFrame | None = None) -> DataFrame:
    """The samples in order; a design must name the same samples in the same order."""
    ranked = [(n, i + 1) for i, n in enumerate(names)]
    if design is None:
        return spark.createDataFrame(ranked, "sample string, sample_rank int")
    given = [r.sample for r in (design.orderBy("sample_rank") if "sample_rank" in design.columns else design).select("sample").collect()]
    if given != names:
        raise ValueError("the design must have the samples of the files, in their order")
    return design.drop("sample_rank").join(F.broadcast(spark.createDataFrame(ranked, "sample string, sample_rank int")), "sample")


def _strand(spark: SparkSession, files: dict[str, str], read, strand: str) -> DataFrame:
    rows = [read(spark, path, strand).withColumn("sample", F.lit(name)) for name, path in files.items()]
    return reduce(DataFrame.unionByName, rows)


def _experiment(spark, plus: dict[str, str], minus: dict[str, str], read, design, seqinfo: DataFrame, whole: bool = False) -> Experiment:
    if list(plus) != list(minus):
        raise ValueError("both strands must have files of the same samples, in the same order")
    rows = _strand(spark, plus, read, "+").unionByName(_strand(spark, minus, read, "-"))
    wide = F.raise_error(F.concat(F.lit("wider than one base: "), F.col("path")))
    rows = rows.withColumn("start", F.when(F.col("start") == F.col("end"), F.col("start")).otherwise(wide.cast("long")))
    if whole:
        rows = rows.withColumn("score", F.col("score").cast("long"))  # towards zero
    known = rows.join(F.broadcast(seqinfo.select("seqname")), "seqname", "left_semi")  # one row a sequence
    expr = known.groupBy("seqname", "start", "strand", "sample").agg(F.sum("score").alias("counts"))
    return ctss_experiment(expr, clean_design(spark, list(plus), design), seqinfo)


def ctss_from_bigwig(spark: SparkSession, plus: dict[str, str], minus: dict[str, str], design: DataFrame | None = None, seqinfo: DataFrame | None = None, tile_width: int | None = None, whole: bool = False) -> Experiment:
    """Positions and counts from BigWig files of each sample and strand; tasks read stretches of files, of whole tiles
    where a width is given.

    `whole` cuts scores to whole numbers.
    """
    check_bigwigs(plus)
    check_bigwigs(minus)
    if seqinfo is None:
        seqinfo = common_genome(spark, plus, minus)
    else:
        check_compatible(plus, minus, seqinfo)
    return _experiment(spark, plus, minus, lambda s, p, strand: read_bigwig(s, p, strand, tile_width), design, seqinfo, whole)


def ctss_from_bigwig_tiles(spark: SparkSession, plus: dict[str, str], minus: dict[str, str], design: DataFrame | None = None, seqinfo: DataFrame | None = None, tile_width: int = 100_000_000) -> Experiment:
    """The former import: always by tiles, with whole counts."""
    return ctss_from_bigwig(spark, plus, minus, design, seqinfo, tile_width, whole=True)


def ctss_from_bedgraph(spark: SparkSession, plus: dict[str, str], minus: dict[str, str], seqinfo: DataFrame, design: DataFrame | None = None) -> Experiment:
    """The same from bedGraph files, which do not say how long sequences are."""
    check_files(plus, ".bedGraph")
    check_files(minus, ".bedGraph")
    return _experiment(spark, plus, minus, read_bedgraph, design, seqinfo)
