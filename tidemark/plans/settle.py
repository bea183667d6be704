"""Tables that a plan reads several times are written once, to the folder that driver and executors share.

A written table cuts the lineage: plans stay small, nothing is computed twice, and a lost executor costs no more than
its running tasks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, extension: str = "") -> str:
    """A path in the shared folder, deleted by `release`."""
    path = f"{shared_dir(spark)}/tidemark/settled-{uuid.uuid4().hex}{extension}"
    _written.append((spark, path))
    return path


def settled(df: DataFrame) -> DataFrame:
    """`df`, written and read back."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_bytes(df: DataFrame) -> int:
    """The size of the files that a table just read consists of, as its plan states it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def release() -> None:
    """Delete the written tables; call it once results are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            return


atexit.register(release)
