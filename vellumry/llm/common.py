"""Helpers that the training-data operators share: scratch tables and Arrow batch slicing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that are turned into Python objects at a time; bounds worker memory.
SLICE_ROWS = 256

_roots: dict[str, str] = {}
#: Paths of stored tables, as long as someone holds their DataFrame: with it the driver holds its plan.
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder of this application inside spark.checkpoint.dir.

    The setting is read from the session.  Only a local master (one machine, as in tests) may
    leave it unset; then a temporary folder is used and set as the checkpoint directory.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="vellumry-")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/vellumry-{app}"
        atexit.register(_forget, spark, app)
    return _roots[app]


def _forget(spark: SparkSession, app: str) -> None:
    """Delete the application's scratch tables at interpreter exit, if the JVM still answers."""
    try:
        drop_path(spark, _roots.pop(app))
    except Exception:  # the JVM may be gone already; the folder is scratch space
        return


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through the Hadoop file system that owns it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a lineage cut that survives
    lost executors, because every reader sees the same complete files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _stored[kept] = path
    return kept


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no result reads any more."""
    for table in tables:
        if table in _stored:
            drop_path(table.sparkSession, _stored.pop(table))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of at most `rows` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes without decoding, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
