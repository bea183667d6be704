"""Conversions between formats.

Each checks that its sources can be read and that the data are counts of single positions; extensions other than the usual
ones only give warnings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import check_ctss
from ..plans.settle import settled
from .bam import read_bam, reads_to_ctss
from .bedgraph import read_bed, read_bedgraph, write_bed, write_bedgraph
from .bigwig import read_bigwig, write_bigwig
from .genomes import check_extensions, check_source


def _checked(df: DataFrame) -> DataFrame:
    check_ctss(df)
    return df


def _files(sources: list[str], extension: str, targets: list[str], target_extension: str) -> None:
    check_source(sources, extension)
    check_extensions(targets, target_extension)


def _split(df: DataFrame, plus: str, minus: str, write) -> None:
    for strand, path in (("+", plus), ("-", minus)):
        write(df.filter(F.col("strand") == strand), path)


def bed_to_bigwig(spark: SparkSession, source: str, plus: str, minus: str, seqinfo: DataFrame) -> None:
    _files([source], ".bed", [plus, minus], ".bw")
    _split(_checked(read_bed(spark, source)), plus, minus, lambda df, path: write_bigwig(df, seqinfo, path))


def bed_to_bedgraph(spark: SparkSession, source: str, plus: str, minus: str) -> None:
    _files([source], ".bed", [plus, minus], ".bedGraph")
    _split(_checked(read_bed(spark, source)), plus, minus, write_bedgraph)


def bedgraph_to_bigwig(spark: SparkSession, source: str, target: str, seqinfo: DataFrame) -> None:
    _files([source], ".bedGraph", [target], ".bw")
    write_bigwig(_checked(read_bedgraph(spark, source, "+")), seqinfo, target)


def bigwig_to_bedgraph(spark: SparkSession, source: str, target: str) -> None:
    _files([source], ".bw", [target], ".bedGraph")
    write_bedgraph(_checked(read_bigwig(spark, source, "+")), target)


def _both(plus: DataFrame, minus: DataFrame, target: str) -> None:
    write_bed(_checked(plus.unionByName(minus)), target)


def bigwig_to_bed(spark: SparkSession, plus: str, minus: str, target: str) -> None:
    _files([plus, minus], ".bw", [target], ".bed")
    _both(read_bigwig(spark, plus, "+"), read_bigwig(spark, minus, "-"), target)


def bedgraph_to_bed(spark: SparkSession, plus: str, minus: str, target: str) -> None:
    _files([plus, minus], ".bedGraph", [target], ".bed")
    _both(read_bedgraph(spark, plus, "+"), read_bedgraph(spark, minus, "-"), target)


def bam_to_bigwig(spark: SparkSession, source: str, plus: str, minus: str, seqinfo: DataFrame, min_length: int = 1, where: str = "true") -> tuple[int, int]:
    """Returns the numbers of positions and of reads.  `where` selects reads by quality, flag or place."""
    _files([source], ".bam", [plus, minus], ".bw")
    ends = settled(reads_to_ctss(read_bam(spark, source).filter(where), min_length))
    _split(_checked(ends), plus, minus, lambda df, path: write_bigwig(df, seqinfo, path))
    positions, reads = ends.agg(F.count(F.lit(1)), F.sum("score")).first()
    return positions, reads or 0


def ranges_to_positions(df: DataFrame) -> DataFrame:
    """One row for each base of disjoint scored ranges; each has the range's score."""
    return df.withColumn("start", F.explode(F.sequence("start", "end"))).withColumn("end", F.col("start"))
