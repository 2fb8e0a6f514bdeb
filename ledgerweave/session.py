"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Bytes of code up to which the JVM compiles a method; longer ones it interprets (HotSpot).
JIT_LIMIT = "8000"


def fit_code_to_jit(spark: SparkSession) -> None:
    """Let Spark run an operator by itself, its expressions split over methods, where the one method of a fused stage
    would be too long for the JVM to compile: the typing of a line's cells is, and takes several times as long interpreted."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)


SPLIT_CONF = "spark.sql.files.maxPartitionBytes"
#: Bytes of numbered lines (some 27 a line) that one task reads and sorts when it consolidates them.
SORT_SPLIT = "16m"
#: Lines in a file of the numbered lines; one file is about one split.
SORT_ROWS = 500_000


@contextmanager
def sorting_splits(spark: SparkSession) -> Iterator[None]:
    """Scans of stages written inside are read in pieces small enough to be sorted in memory: a line's facts grow about
    twenty times when its cells are made and typed, so a split of the usual size would be spilled before its first row is sent."""
    before = spark.conf.get(SPLIT_CONF)
    spark.conf.set(SPLIT_CONF, SORT_SPLIT)
    try:
        yield
    finally:
        spark.conf.set(SPLIT_CONF, before)


#: Spark removes a query's shuffle files when the query ends (its default is to wait for the driver's garbage collector).
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind: they are read back from the folder they were written to, so
    nothing needs those files any more."""
    try:
        before = spark.conf.get(CLEANUP_CONF)  # with a default of ours, an unset key would look like an unknown one
    except PySparkException:  # a Spark without the setting
        yield
        return
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ledgerweave") -> SparkSession:
    """Session tuned for the reconciliation jobs.

    AQE stays on: it coalesces small shuffle partitions, turns joins whose
    build side turns out small at run time into broadcast joins (a size check
    made on real data, not a guess) and splits skewed join partitions.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.driver.memory", os.environ.get("LW_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    fit_code_to_jit(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of this session.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    filesystem every executor can reach).  Only when nothing is configured
    and the master is local, as in tests, a fresh folder is made for this
    process; on a cluster a missing setting is an error, because a folder of
    this machine cannot be read by the executors.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder (master {master})")
        configured = tempfile.mkdtemp(prefix="lw-ckpt-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])


def lasting_path(spark: SparkSession, *parts: str) -> str:
    """A path that later sessions find again: below the folder that ``spark.checkpoint.dir`` names, not below the
    subfolder that this session made in it (in local tests without the setting they are the same)."""
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    base = configured or ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), "ledgerweave", *parts])
