"""Folders for what a job writes and reads again, and rows dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; only where that
    is unset and Spark runs in one process (local tests) below a temporary folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="denialkit-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(narrow: DataFrame, *by: str) -> DataFrame:
    """The rows over all cores, before work that costs far more than moving them: a packed table makes
    few splits, and text that compresses well would be put together to few tasks of many rows."""
    spark = narrow.sparkSession
    return narrow.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
