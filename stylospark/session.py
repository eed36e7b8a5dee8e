"""Makes the package importable on the executors of a running session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once per application. Where
    the cluster installs the package itself this only adds the same files."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{here.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent).as_posix())
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir). Where
    that is unset, a temporary folder on one machine, as in tests, or an error on a
    cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = shared(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of whole texts: at most `rows` rows, unless the session has a setting
    of its own. A batch is held by the JVM, outside of its heap, and by the Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
