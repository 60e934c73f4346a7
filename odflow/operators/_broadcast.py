"""Written intermediate tables and one-row broadcasts.

No operator decides on a size by itself: whether a side is broadcast is left to
``spark.sql.autoBroadcastJoinThreshold`` and AQE, which know the sizes of scanned and of
written tables.  Hints stand only on one-row aggregates and on lists built on the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.session import shared_dir


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast hint for a global aggregate, which has exactly one row by construction."""
    return F.broadcast(df)


def from_driver(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table made from a list that the driver holds anyway."""
    return F.broadcast(df)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once: Parquet in the shared folder, read back.

    Used where a result feeds several branches (rows and a quantile of them, an index probed
    twice), which would otherwise re-run the upstream scan.  The folder is the one the session
    names in ``spark.checkpoint.dir``; without one this is an error on a cluster, because a
    machine-local copy would be lost with its executor.  The planner sees the written size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/odflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
