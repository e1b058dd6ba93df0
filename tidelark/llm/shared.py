"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are broadcast at most, 8 MB; rows and bytes in one Arrow batch of texts at most.
BROADCAST_IDS = 1_000_000
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 4096, 4 << 20
#: Column chunks are read one after another: with vectored reads each reading thread keeps direct buffers of its largest read.
PLAIN_READS = {"parquet.hadoop.vectored.io.enabled": "false"}


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="tidelark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only on one machine where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return base.rstrip("/") if base else _own_dir(spark.sparkContext.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/tidelark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.options(**PLAIN_READS).schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `cut` has written and nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *tables: DataFrame) -> str:
    """`name`, with as many underscores before it as make it a new one for the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def only_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows whose `column` is in the written table `ids` of one column, a null being equal to a null.

    Up to BROADCAST_IDS ids (counted) are broadcast, so that texts aren't shuffled; beyond that both sides are.
    """
    name = unused("_id", rows)
    ids = ids.select(F.col(ids.columns[0]).alias(name))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(ids, F.col(column).eqNullSafe(F.col(name)), "left_semi")


def one_row_each(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each key; only rows of keys that repeat are shuffled.  Rows with a null key count as one key."""
    again = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated")
    if again.isEmpty():
        return rows
    name = unused("_id", rows)
    again = again.select(F.col(key).alias(name))
    same = F.col(key).eqNullSafe(F.col(name))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates([key]))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that gives memory back to the system after each batch and at its end: Python workers wait for the next one
    without it."""

    def give_back() -> None:
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            give_back()
        gc.collect()
        pa.default_memory_pool().release_unused()
        give_back()

    return tidied


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers that are sent whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.options(**PLAIN_READS).parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
