"""Sessions with the settings that the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Re-planning at run time, with skewed joins split: what the operators rely on for hot keys.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder of spark.checkpoint.dir; local masters without one get a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="helixframe-"))
    return df.checkpoint()


def local_session(cores: str = "*", memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A session on this machine, with a temporary checkpoint folder."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("helixframe")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or (int(cores) if cores.isdigit() else 8)))
    spark = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="helixframe-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
