"""Durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a private folder is made in local mode alone: the executors of a cluster would
    not see each other's files there, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='placefinder-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def save(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor loses nothing that was saved. ``parts`` coalesces
    tables known to be small.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/table-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all tasks: adaptive execution would leave few bytes to one task, however long each row takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`save` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_saved_at", None)
        if path:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
