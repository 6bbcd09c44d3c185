"""Tables in the scratch folder that all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent a temporary folder is made, which is right for a local master only;
    on any other master that raises, since executors would not see the folder. The folder is
    removed when the driver ends.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="rillflow-")
        path = f"{base.rstrip('/')}/rillflow-{uuid.uuid4().hex}"
        _scratch[sc.applicationId] = path
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())

        def remove() -> None:
            try:
                files.delete(hadoop, True)
            except Exception:  # the JVM may already be gone
                pass

        atexit.register(remove)
    return _scratch[sc.applicationId]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    This cuts the lineage (a lost executor costs the tasks it ran, never the steps before) and gives
    the planner the real size of the table, so that it broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialise` that nothing will read again; whatever is left goes when the driver ends."""
    for t in tables:
        hadoop = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        hadoop.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scope():
    """Discards, at its end, every table that was written within it but those added to the list it gives.

    Results have to be written, collected or kept by then; what is kept belongs to the scope around, if there is one.
    """
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        own, stay = _scopes.pop(), {t.scratch_path for t in kept}
        discard(*[t for t in own if t.scratch_path not in stay])
        if _scopes:
            _scopes[-1] += [t for t in own if t.scratch_path in stay]
