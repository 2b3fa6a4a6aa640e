"""Shared-folder tables and Arrow helpers used by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that setting is absent a folder is made and set, but only if everything runs on this one
    machine (tests); on a cluster that is an error, as other machines would not see the folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            where = got.get()
        elif not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            where = "file://" + tempfile.mkdtemp(prefix="corpus-shared-")
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Bytes that Spark puts into one Arrow batch for a worker, so that long texts don't pile up in either process.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches by bytes, unless the session has a smaller bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (string) alone, read in bounded batches."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: What a worker process keeps between tasks, by kind; see ``only``.
caches: dict[str, dict] = {"tokens": {}, "powers": {}}


def only(*kinds: str) -> None:
    """Called as a task starts: drops what the worker has kept for operators of other kinds."""
    for kind, cache in caches.items():
        if kind not in kinds:
            cache.clear()


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Deletes the shuffle files of a write as it ends, so that only one step's files are on disk at a time.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and no executor loss undoes it."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``table``, one row a key, whose ``size`` is the key's number of rows.

    Keys with a thousandth or more of all rows, of which there are at most 1000, go by broadcast, so
    a hot key's rows stay where they are; the others are shuffled.  ``rows`` should be a stored table.
    """
    least = F.lit(-(-rows.count() // 1000))
    hot = F.broadcast(table.where(F.col("size") >= least))
    others = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(others.join(table.where(F.col("size") < least), keys))


def hash_sample(rows: DataFrame, keys: list[str], by: list[str], most: int) -> DataFrame:
    """The ``most`` distinct rows of ``keys`` that come first by the hash of ``by`` (all, if there are fewer).

    Only rows below a hash bound, chosen by the number of distinct rows so that a few times ``most`` are left, reach
    the sort, so what it gathers does not grow with the number of partitions.
    """
    rows, place = rows.select(*keys), F.xxhash64(*by)
    n = rows.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    share = min(1.0, (4 * most + 1000) / max(1, n))
    below = rows.distinct()
    if share < 1:
        below = rows.where(place < F.lit(int(share * 2**64) - 2**63)).distinct()
        if below.limit(most).count() < most:  # hardly ever: ``by`` takes few values
            below = rows.distinct()
    return below.orderBy(place, *keys).limit(most)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    bufs = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int = (1 << 20) - 4096) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``most`` text bytes, so that kernels use bounded memory (a longer row goes alone)."""
    if batch.num_rows == 0:
        return
    _, offs = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """int64 values and a mask of the non-null ones."""
    ok = ~np.asarray(column.is_null())
    return np.asarray(column.fill_null(0).cast(pa.int64())), ok
