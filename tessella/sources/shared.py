"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from tessella.errors import InvalidInput


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without one gets a folder of its own; a cluster must name one, since executors don't see a driver's folder."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local["):
        raise InvalidInput("spark.checkpoint.dir is not set")
    context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='tessella-')}")
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
