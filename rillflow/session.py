"""A session with the settings the operators are designed for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "rillflow", **extra: str) -> SparkSession:
    """Get or create a session; ``extra`` and an existing session's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (CONF | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()
#: Spark's own bound on a batch for Python workers, and ours, which replaces it unless a session sets another.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"


def ship(spark: SparkSession | None = None) -> None:
    """Give the Python workers this package, once per application: called before each operator that runs Python.

    Spark's file server hands the archive to executors, so that nothing needs to be installed on them. Batches for
    Python are bounded by 8 MB instead of 64, as texts have no bound of their own.
    """
    spark = spark or SparkSession.active()
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="rillflow-")) / "rillflow_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
