"""What the operators share: scratch tables, slices of Arrow batches, byte views of texts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Characters that count as white space everywhere in this subpackage: [\x20\x09-\x0D].
WS = b" \t\n\x0b\x0c\r"


#: Folders of pinned tables that are still there, as far as this process knows.
_pinned: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder name under the session's spark.checkpoint.dir.

    The driver and all executors must see that folder. Where the setting is
    absent, a local master gets a temporary folder and any other an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(scratch, "own", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = scratch.own = tempfile.mkdtemp(prefix="scratch-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    _pinned.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unpin(df: DataFrame) -> None:
    """Delete a pinned table that nothing will read again and let finished shuffles go."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(spark, path)
        _pinned[:] = [p for p in _pinned if not path.endswith(p.rpartition("/")[2])]
    release(spark)


def pinned() -> list[str]:
    """Folders of pinned tables, in the order in which this process wrote them."""
    return list(_pinned)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete pinned tables by their folders."""
    for path in paths:
        delete(spark, path)
        _pinned.remove(path)
    release(spark)


def release(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect, so that the context cleaner drops the shuffle files of finished jobs."""
    spark._jvm.System.gc()


def distinct_ids(docs: DataFrame) -> bool:
    """Whether no row's doc_id is null and no two rows share one; a narrow aggregate decides."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return ids.where("n > 1 or id is null").isEmpty()


def numbered(docs: DataFrame, nulls_first: bool = True) -> tuple[DataFrame, bool]:
    """`docs` with a long doc_id of its own for each row, the given one as __doc_id; and whether the numbers are new.

    Null and repeated doc_ids are rows of their own. Where there are none, the
    given doc_ids stay. Otherwise rows are numbered in the order of doc_id,
    then of a hash of the text and of their place, which also spread a
    frequent doc_id or row over the sort's tasks.
    """
    key = F.col("doc_id").cast("long")
    if distinct_ids(docs):
        return docs.withColumns({"__doc_id": F.col("doc_id"), "doc_id": key}), False
    rows = docs.withColumns({"__doc_id": F.col("doc_id"), "__place": F.monotonically_increasing_id()})
    rows = rows.orderBy(key.asc_nulls_first() if nulls_first else key.asc_nulls_last(), F.xxhash64("text"), "__place").drop("__place")
    return pin(rows.withColumn("doc_id", F.monotonically_increasing_id())), True


def restored(out: DataFrame, named: DataFrame, *columns: str) -> DataFrame:
    """`out` with the given doc_ids instead of the new numbers in `columns`."""
    order = out.columns
    names = named.select(F.col("doc_id").alias("__id"), F.col("__doc_id").cast("long").alias("__name"))
    for c in columns:
        out = out.join(names, out[c] == names["__id"], "left").drop("__id", c).withColumnRenamed("__name", c)
    return out.select(*order)


def frugal(df: DataFrame) -> None:
    """Keep Arrow batches of whole texts small, unless the session has a setting of its own."""
    conf = df.sparkSession.conf
    if conf.get(ROWS_PER_BATCH, None) is None:
        conf.set(ROWS_PER_BATCH, "1000")


def trim() -> None:
    """Give memory that a task has freed back to the system; Python workers live on after it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each part have `limit` bytes at most, or it is a single row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(at).cast(pa.binary())).fill_null(0).to_pylist()
        ends, start, total = [], 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                ends.append((start, i))
                start, total = i, 0
            total += size
        ends.append((start, n))
        for a, b in ends:
            yield batch.slice(a, b - a)
    trim()


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after another, and the offsets of the parts (one more than parts)."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), offsets


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
