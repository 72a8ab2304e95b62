"""Session helpers: building a session, locating the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(cpus: str | int | None = None, shuffle_partitions: int | None = None,
              app: str = "tessera") -> SparkSession:
    """Local session for tests/bench. On a cluster, use the session you are given."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, read from ``spark.checkpoint.dir``.

    Unset, a local session (one machine, as in tests) gets a folder of its own; any other raises, as executors would
    write to disks that the others do not see.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint setting
        sc = None
    d = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_SCRATCH = f"tessera-scratch/{uuid.uuid4().hex[:12]}"  # of this process


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir for written tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{_SCRATCH}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> bool:
    """Removes all tables this process has written to the scratch folder; True if there were any.

    For the owner of the session, once the results of its queries are written: DataFrames that still read scratch
    tables fail afterwards.  Checkpoints are removed by Spark's cleaner (``cleanCheckpoints``).
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{_SCRATCH}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))


def materialize(df):
    """Cut lineage with a reliable checkpoint in the session's ``spark.checkpoint.dir``.

    Executors may be lost; a reliable checkpoint is re-read, never recomputed.
    Never ``localCheckpoint`` (executor-local storage).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
