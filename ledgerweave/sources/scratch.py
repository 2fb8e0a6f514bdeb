"""Written tables in the shared folder: the lineage cut between stages.

``materialize`` writes a DataFrame once as Parquet under the session's
checkpoint folder (``spark.checkpoint.dir``, a shared filesystem on a
cluster) and returns a scan of it.  Compared to ``Dataset.checkpoint`` it
runs a single job (checkpoint recomputes the plan a second time to write
it), compresses columnar data and lets later scans prune columns and push
filters down.  Every call gets a new folder; nothing is overwritten.  ``clean_up``
removes a session's written stages when they are no longer read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import dropping_shuffles, scratch_path


def materialize(df: DataFrame, name: str = "stage", rows_per_file: int = 0) -> DataFrame:
    """``rows_per_file`` (0: no limit) bounds the files, and with them the smallest pieces that later scans are read in."""
    spark = df.sparkSession
    path = scratch_path(spark, "tables", f"{name}-{uuid.uuid4().hex}")
    with dropping_shuffles(spark):
        df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder of the shared file system; whether there was one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> bool:
    """Remove every stage that this session has written; tables read from them are lost."""
    return remove(spark, scratch_path(spark, "tables"))
