"""SparkSession helpers shared by tests, the bench and the driver entry point."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DIR = "spark.odflow.local.dir"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "odflow") -> SparkSession:
    """Return a session tuned for the library.

    On a cluster the caller's session already exists and ``getOrCreate`` returns it
    unchanged apart from the SQL confs set below; ``master`` is only used for local runs.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", os.environ.get("ODFLOW_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, where intermediate tables are written.

    A cluster must name a folder that all its machines share.  Only a local master, whose
    executors are the driver itself, gets a temporary one where the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_DIR, None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    folder = tempfile.mkdtemp(prefix="odflow-")
    spark.conf.set(_LOCAL_DIR, folder)
    return folder
