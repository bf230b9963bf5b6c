"""Scratch tables in the cluster's shared folder, and small helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side made of fixed-width keys may be broadcast; beyond it a shuffle join is planned.
BROADCAST_ROWS = 1_000_000

#: Rows and bytes of the batches that Python workers get; a batch is held by the executor's JVM and by the worker.
_BATCH, SMALL_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
_BATCH_BYTES, SMALL_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20
_swept: set[str] = set()
_worker_caches: list = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return root.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/loomtide/{spark.sparkContext.applicationId}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the application's shared folder and read it back: cuts lineage and survives lost executors.

    Python workers get small batches while it is written, so that long texts take
    little memory; the session's settings are put back.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (_BATCH, _BATCH_BYTES)}
    if not 0 < int(before[_BATCH]) <= SMALL_BATCH:
        spark.conf.set(_BATCH, str(SMALL_BATCH))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[_BATCH_BYTES]) > SMALL_BYTES:
        spark.conf.set(_BATCH_BYTES, str(SMALL_BYTES))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if spark.sparkContext.applicationId not in _swept:
        _swept.add(spark.sparkContext.applicationId)
        atexit.register(_sweep, spark, _folder(spark))
    out = spark.read.schema(df.schema).parquet(path)
    out._loomtide_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`save` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._loomtide_path)


def clean(spark: SparkSession, hours: float) -> list[str]:
    """Delete the scratch folders of applications that ended without doing so: those untouched for so many hours."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/loomtide")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for found in fs.listStatus(path) if fs.exists(path) else []:
        name = found.getPath().getName()
        if name != spark.sparkContext.applicationId and time.time() - found.getModificationTime() / 1000 >= hours * 3600:
            fs.delete(found.getPath(), True)
            gone.append(name)
    return gone


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the JVM may be gone at interpreter exit
        return


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_key(doc, text):
    """Columns k and digest, which name a row by its doc_id (a null one ranks first) and its text."""
    return F.coalesce(doc, F.lit(-(1 << 63))).alias("k"), F.xxhash64(doc, text).alias("digest")


def slices(batches, column: int, rows: int = 512, size: int = 4 << 20):
    """Slices of Arrow batches of at most ``rows`` rows and ``size`` bytes of a string column, or of one row."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(total, total[at] + size, side="right")) - 1
            end = min(max(end, at + 1), at + rows, b.num_rows)
            yield b.slice(at, end - at)
            at = end


def worker_cache(cached):
    """``cached``, an lru_cache that a Python worker keeps from task to task, until it does work that uses another."""
    _worker_caches.append(cached)
    return cached


def forget(but=None) -> None:
    """Empty this worker's caches except ``but``."""
    for cached in _worker_caches:
        if cached is not but:
            cached.cache_clear()


def tidied(run, cache=None):
    """``run`` over Arrow batches; afterwards the worker, which is used again, hands free memory back to the system.

    ``cache`` is the :func:`worker_cache` that ``run`` uses; others, of work that the worker did before, are emptied.
    """

    def wrapped(batches):
        forget(cache)
        try:
            for b in run(batches):  # the JVM holds a batch as a whole, too
                rows = max(1, b.num_rows * SMALL_BYTES // max(1, b.nbytes))
                for at in range(0, max(1, b.num_rows), rows):
                    yield b.slice(at, rows)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text):
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
