"""What the operators share: tables, Arrow batches, shared storage and the two kinds of words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of an Arrow batch that goes to a Python worker; one long text may exceed the bytes.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset and all runs on this machine, as in tests."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            path = known.get()
        elif context.master.startswith("local"):
            path = tempfile.mkdtemp(prefix="orpheon-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. release() deletes it."""
    path = f"{shared_dir(spark)}/orpheon-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: list[str] = []


def written() -> int:
    """How many tables stored() has written and release() not yet deleted."""
    return len(_STORED)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete what stored() wrote in this session, from table number `since` on but for the last `but`; frames that still
    read it become invalid."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in _STORED[since : len(_STORED) - but]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _STORED.remove(name)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string or binary array as one byte array, with offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
