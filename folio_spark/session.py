"""Session helpers: shipping the package to executors and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows of a partition, about, where a task's memory grows with them.
PART_ROWS = 500_000
_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application."""
    # texts are long: batches of fewer rows bound the memory of Python workers and of Arrow's buffers in the JVM
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="folio_ship_")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "folio_spark_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        folder = tempfile.mkdtemp(prefix="folio_shared_")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
        path = f"file://{folder}"
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/folio_{name}_{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table written to the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def spread(df: DataFrame, rows: int, *keys) -> DataFrame:
    """df by keys in as many partitions as its rows ask for: merging small partitions goes by compressed bytes, of which narrow rows have few."""
    return df.repartition(parts_of(rows), *keys)
