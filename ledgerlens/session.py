"""Session helpers: building a local session for tests/bench and finding shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None, max_failures: int = 1) -> SparkSession:
    """Session for tests and the bench: UTC, AQE on, UI off, Arrow on.

    ``max_failures > 1`` lets local mode retry failed tasks (as a cluster does).
    """
    n = os.cpu_count() if cores == "*" else int(cores)
    master = f"local[{cores}]" if max_failures <= 1 else f"local[{cores},{int(max_failures)}]"
    builder = (
        SparkSession.builder.master(master)
        .appName("ledgerlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or max(8, 2 * n)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only when it is unset
    in local mode (tests) do we set one of our own.  On a cluster an unset
    folder is an error: a machine-local folder would not survive executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")  # local mode only: one machine
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/ledgerlens/{name}-{uuid.uuid4().hex}"
