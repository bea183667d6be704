"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local session without the setting gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts the lineage and outlives executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    return len(_written)


def clean_up(first: int = 0, keep: int = 0) -> None:
    """Delete the intermediate tables this process wrote, from the `first` on and but for the last `keep`; call it once
    what was computed from them is stored."""
    gone = _written[first : len(_written) - keep]
    del _written[first : len(_written) - keep]
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: nothing can reach the folder any more
            return


atexit.register(clean_up)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole_text(name: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(doc_id, n: int) -> int:
    """crc32 of the id's decimal text, modulo n."""
    return zlib.crc32(str(doc_id).encode()) % n


def fold_column(name: str, n: int) -> Column:
    return F.crc32(F.encode(F.col(name).cast("string"), "UTF-8")) % n


def narrowed(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the columns an operator reads; further columns, whatever their names, do not reach it."""
    return df.select(*[F.col(f"`{x}`") for x in names])


def row_key(id_col: str, text_col: str) -> Column:
    """A row's 64-bit key, which tells rows with equal ids but unequal texts apart."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), whole_text(f"`{text_col}`"))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs`, with all its columns, without the rows whose key is in `gone` (key)."""
    keys = gone.select(F.col("key").alias("__gone_key")).distinct()
    return docs.join(keys, row_key(id_col, text_col) == keys["__gone_key"], "left_anti")
