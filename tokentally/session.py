"""Spark session and shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


MB = 1 << 20


def scale_conf(input_bytes: int, total_cores: int, shuffle_fraction: float = 0.25) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of parquet facts on a
    cluster with ``total_cores`` task slots.

    * scan splits of 256 MB: a task holds one split's columns, far below
      executor memory, and 100 TB gives ~400k scan tasks;
    * initial shuffle partitions so that the largest shuffle (the row-level
      shuffle of the running totals, estimated as ``shuffle_fraction`` of the
      input after column pruning) lands at ~200 MB per partition, at least
      3 waves of tasks; AQE coalesces them at run time to 128 MB targets;
    * skewed partitions (5x the median and over 512 MB) are split by AQE.
    """
    shuffle_bytes = int(input_bytes * shuffle_fraction)
    parts = max(3 * total_cores, -(-shuffle_bytes // (200 * MB)))
    return {
        "spark.sql.files.maxPartitionBytes": str(256 * MB),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * MB),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * MB),
        # only the checked small sides are broadcast explicitly; keep the
        # automatic threshold modest so large dimensions are never shipped
        "spark.sql.autoBroadcastJoinThreshold": str(64 * MB),
    }


def get_spark(master: str | None = None, app: str = "tokentally",
              shuffle_partitions: int | None = None, input_bytes: int | None = None,
              total_cores: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """Session tuned for the reports: AQE on, UTC, UI off.  With
    ``input_bytes`` and ``total_cores`` the partition sizing of
    ``scale_conf`` is applied."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if input_bytes and total_cores:
        conf.update(scale_conf(input_bytes, total_cores))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        # in local mode the driver JVM runs every task: size its heap
        conf["spark.driver.memory"] = driver_memory
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set (a shared file system); only a local-mode
    session without one gets a fresh temporary folder, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        # spark.checkpoint.dir is fixed at start-up; the context's checkpoint
        # folder can still be set for this local session
        root = tempfile.mkdtemp(prefix="tokentally-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder name below the checkpoint root (writers create it)."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
