"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import shutil
import tempfile
import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only where that is unset, and all runs on one machine, as in tests, a folder of this process is made, which
    goes when the process ends. A cluster needs the setting; without it this is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siltline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and written to the checkpoint folder.

    Spark removes the files when the frame is no longer used, if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set; they lie in the application's own subfolder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered_rows(ordered: DataFrame, place: str) -> DataFrame:
    """Sorted rows with their place, from 1: each partition is numbered behind the ones before it."""
    df = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    sizes = df.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    # There is one row of sizes per partition of the sort.
    return df.join(F.broadcast(sizes), "_part").withColumn(place, F.col("_before") + F.col("_id") - F.shiftleft("_part", 33) + 1).drop("_id", "_part", "_before")
