"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master.

    A cluster must name its folder: a machine-local one would not be seen by the others.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and sc.getCheckpointDir():
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="odflow-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, task_rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The lineage ends at files every executor can read, so a lost executor costs no more than
    its own tasks, and values such as row numbers keep what was written.  With ``task_rows``
    the table is read in as few partitions as hold that many rows each, for tables of two or
    three numbers a row that go through many short steps.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/odflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table if task_rows is None else table.coalesce(max(1, -(-table.count() // task_rows)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def integer_id(df: DataFrame, column: str) -> None:
    """An error that says so where an id is not an integer."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{column} must be an integer column, not {kind.simpleString()}")
