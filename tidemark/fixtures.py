"""The star-schema tables read as genomic inputs: counts of positions, a genome, gene and transcript models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Experiment
from .operators.annotate import TranscriptModels
from .operators.assay import ctss_experiment
from .plans.settle import file_bytes

LENGTH = 10_000
#: Bytes of a line item file whose rows one task holds.
TASK_BYTES = 8 << 20


def ctss(spark: SparkSession, sf_dir: str) -> Experiment:
    """Suppliers are sequences, line numbers samples, line status the strand, quantities the counts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # few lines share a position, so sums before the shuffle would only hold memory; the number of tasks follows the file
    tasks = max(spark.sparkContext.defaultParallelism, -(-file_bytes(lines) // TASK_BYTES))
    rows = lines.select(
        F.concat(F.lit("chr"), "l_suppkey").alias("seqname"),
        (1 + (F.col("l_orderkey") * 37 + F.col("l_partkey") * 11 + F.col("l_linenumber")) % LENGTH).alias("start"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.concat(F.lit("s"), "l_linenumber").alias("sample"),
        "l_quantity",
    )
    expr = rows.repartition(tasks, "seqname", "start", "strand").groupBy("seqname", "start", "strand", "sample").agg(F.sum("l_quantity").cast("long").alias("counts"))
    return ctss_experiment(expr, samples(spark), seqinfo(spark, sf_dir))


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"s{i}", i) for i in range(1, 8)], "sample string, sample_rank int")


def seqinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("chr"), "s_suppkey").alias("seqname"), F.lit(LENGTH).cast("long").alias("seqlength"), F.col("s_suppkey").cast("int").alias("seq_rank"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    p, k = F.col("p_partkey"), F.floor(F.col("p_partkey") / n)
    start = 1 + (p * 53 + k * 457) % 9000
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("g"), p).alias("gene_id"), F.concat(F.lit("chr"), p % n).alias("seqname"), p.alias("row_idx"), start.alias("start"),
        F.least(F.lit(LENGTH), start + F.col("p_size") * 20).alias("end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> TranscriptModels:
    """One transcript a gene: three exons of a fifth of it each, untranslated, coding and untranslated."""
    tx = genes(spark, sf_dir).withColumn("tx_id", F.concat(F.lit("t"), "row_idx"))
    q = F.floor((F.col("end") - F.col("start") + 1) / 5)
    ranges = [(F.col("start"), F.col("start") + q - 1), (F.col("start") + 2 * q, F.col("start") + 3 * q - 1), (F.col("start") + 4 * q, F.col("end"))]
    exons = tx.select("tx_id", "gene_id", "seqname", "strand", F.posexplode(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ranges])).alias("i", "e"))
    exons = exons.select("tx_id", "gene_id", "seqname", F.col("e.a").alias("start"), F.col("e.b").alias("end"), "strand", "i")
    first = F.when(F.col("strand") == "+", 0).otherwise(2)
    return TranscriptModels(tx, exons, exons.filter("i = 1"), exons.filter(F.col("i") == first), exons.filter(F.col("i") == 2 - first))
