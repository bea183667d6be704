"""bedGraph and BED: text with 0-based half-open ranges, read and written as 1-based closed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = r"^(track|browser|#)"


def _lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Tab-separated rows without track, browser and comment lines; `path` says where each came from."""
    text = spark.read.text(paths).filter(~F.col("value").rlike(HEADER) & (F.trim("value") != "")).select("value", F.input_file_name().alias("path"))
    parsed = text.select("path", F.from_csv("value", schema, {"sep": "\t", "mode": "FAILFAST"}).alias("r"))
    return parsed.select("path", "r.*")


def read_bedgraph(spark: SparkSession, paths: str | list[str], strand: str) -> DataFrame:
    """seqname, start, end, strand, score and path."""
    rows = _lines(spark, paths, "chrom string, start0 long, end long, score double")
    return rows.select(F.col("chrom").alias("seqname"), (F.col("start0") + 1).alias("start"), "end", F.lit(strand).alias("strand"), "score", "path")


def read_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """seqname, start, end, strand, name, score and path; a missing strand is *."""
    rows = _lines(spark, paths, "chrom string, start0 long, end long, name string, score double, strand string")
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("*")
    return rows.select(F.col("chrom").alias("seqname"), (F.col("start0") + 1).alias("start"), "end", strand.alias("strand"), "name", "score", "path")


def _number(name: str):
    """Whole numbers are written without a fraction."""
    v = F.col(name).cast("double")
    return F.when(v % 1 == 0, v.cast("long").cast("string")).otherwise(v.cast("string"))


def write_bedgraph(df: DataFrame, path: str, mode: str = "error") -> None:
    """One strand's ranges and scores, sorted within each part; the parts are ranges of the genome in order."""
    rows = df.select("seqname", (F.col("start") - 1).alias("start0"), "end", "score").repartitionByRange("seqname", "start0").sortWithinPartitions("seqname", "start0")
    rows.select("seqname", "start0", "end", _number("score").alias("score")).write.mode(mode).csv(path, sep="\t")


def write_bed(df: DataFrame, path: str, mode: str = "error") -> None:
    name = F.col("name") if "name" in df.columns else F.lit(".")
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".")
    rows = df.withColumn("start0", F.col("start") - 1).repartitionByRange("seqname", "start0").sortWithinPartitions("seqname", "start0")
    rows.select("seqname", "start0", "end", F.coalesce(name, F.lit(".")).alias("name"), _number("score").alias("score"), strand.alias("strand")).write.mode(mode).csv(path, sep="\t")
