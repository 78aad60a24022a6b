"""Give the Python workers this package: what ``--py-files`` does, once a Spark context."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Settings of Arrow batches, as Spark has them and as they are lowered: whole texts can be long, and a batch is
#: held several times over on its way.
BATCHES = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"),
)


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the context's Python files, unless that was done before."""
    context = spark.sparkContext
    if getattr(context, "_helixframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="helixframe-py-")  # only the driver reads it: Spark serves it to the executors
    target = f"{folder}/helixframe.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"helixframe/{path.relative_to(root)}")
    context.addPyFile(target)
    context._helixframe_shipped = True


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and what one stage took would stay taken."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package, over batches of bounded size.

    The session's batch sizes are lowered where they still have Spark's defaults.
    """
    spark = df.sparkSession
    ship(spark)
    for key, usual, lower in BATCHES:
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, lower)

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)
