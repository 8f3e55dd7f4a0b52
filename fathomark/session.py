"""Session helpers: a tuned local session, table reading, and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fathomark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is unset and Spark runs in one process (tests), a temporary folder takes its place; on a
    cluster a missing setting is an error, since a machine-local folder would lose data with its machine.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = os.environ.get("FATHOMARK_TEST_SHARED")
        if not known:
            known = os.environ["FATHOMARK_TEST_SHARED"] = tempfile.mkdtemp(prefix="fathomark-")
            atexit.register(shutil.rmtree, known, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, for work in Python that costs more than moving them, where a scan has fewer splits than
    there are cores: a file of few row groups is read by few tasks. Otherwise, and at scale, the scan as it is.

    ``df`` must be a scan with at most projections and filters: its splits are counted by planning it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_RUNS: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table below the shared folder, in this application's own folder there.

    That folder is deleted when the Python process ends; what a killed process leaves behind, :func:`clear_scratch` takes.
    """
    run = f"{shared_dir(spark).rstrip('/')}/fathomark/run-{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        _RUNS.add(run)
        atexit.register(_delete, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), run)
    return f"{run}/{label}-{uuid.uuid4().hex}"


def _delete(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  (the JVM may be gone already)
        pass


def clear_scratch(spark: SparkSession, older_hours: float = 24) -> int:
    """Delete intermediate tables of other applications that have not been written to for ``older_hours``; how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/fathomark")
    fs = base.getFileSystem(conf)
    gone = 0
    for s in fs.listStatus(base) if fs.exists(base) else []:
        name = s.getPath().getName()
        if name.startswith("run-") and name != f"run-{spark.sparkContext.applicationId}" and s.getModificationTime() < (time.time() - older_hours * 3600) * 1000:
            gone += bool(fs.delete(s.getPath(), True))
    return gone


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it again: lineage ends there, on replicated storage."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
