"""Tables and files in the folder that driver and executors share.

The cluster names that folder in ``spark.checkpoint.dir``.  Iterative and multi-pass
operators write their intermediate tables there, so a lost executor costs a re-read and
not a recomputation, and the lineage stays short.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder.

    Where the session names none, a session on this machine alone gets a temporary one, which
    goes when Python ends; on a cluster that would be a folder the executors do not see, so
    it is an error.
    """
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_root(spark)}/quarry/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished_folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of a pattern whose write has finished: those with the mark that Spark's writers leave last."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = mark.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(mark)
    return sorted(str(status.getPath().getParent()) for status in found or [])


def discard(spark: SparkSession) -> None:
    """Delete what this library wrote to the shared folder.

    The caller of an operator owns its intermediate tables, as results read from them: call
    this once the results are stored and no other job of the session is at work.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/quarry")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
