"""Tables in the folder that all machines share, and their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set a folder of our own serves, but only if driver and
    executors are one process: elsewhere no folder of this machine will do.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="gridwright-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
        _at_end(spark, sc.getCheckpointDir(), True)
    return path


def _at_end(spark: SparkSession, path: str, delete: bool) -> None:
    """Have a path deleted when the driver ends, or no longer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(p) if delete else fs.cancelDeleteOnExit(p)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: lineage ends
    there, so a lost executor costs one reread, not a recomputation. Whatever
    nobody discards before goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _at_end(spark, path, True)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by written() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _at_end(spark, p, False)
