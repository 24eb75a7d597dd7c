"""Work tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one on a local master, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="repograph-")
        spark.conf.set("spark.checkpoint.dir", f"file://{root}")
        spark.sparkContext.setCheckpointDir(f"file://{root}")
        root = f"file://{root}"
    return root


_made: list[tuple[SparkSession, str]] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/repograph/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM has gone; the folder's owner cleans up
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_once(df: DataFrame, name: str) -> DataFrame:
    """df staged, so that a plan that uses it several times computes it once; df itself on a cluster without a shared folder."""
    try:
        shared_dir(df.sparkSession)
    except RuntimeError:
        return df
    return staged(df, name)
