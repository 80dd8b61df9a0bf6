"""What the operators share: the work folder, written intermediate tables, the words of a text."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strainlake.functions.shipping import ship

__all__ = ["WS_RUN", "discard", "free", "new_path", "raw_of", "release", "ship", "slices", "small_batches", "texts_of", "words", "work_dir", "written"]

#: Java pattern of a run of the six ASCII white-space characters; all other characters belong to words.
WS_RUN = r"[ \t\n\x0B\f\r]+"

_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one where that is unset and the master local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own_dirs.setdefault(app, "") or tempfile.mkdtemp(prefix="strainlake-")
        _own_dirs[app] = base
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the work folder, deleted when the driver's JVM ends."""
    path = f"{work_dir(spark)}/strainlake/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of at most so many bytes for what runs inside: their buffers are no part of the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{most_bytes}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table written to the work folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._work_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing that is still to run reads them."""
    for t in tables:
        jpath = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._work_path)
        jpath.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of queries that are over: its cleaner needs their plans collected, twice."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)


def free(docs: DataFrame, *names: str) -> list[str]:
    """Column names like these that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def words(text: Column) -> Column:
    """The words of a text as an array; none for an empty text."""
    return F.array_remove(F.split(text, WS_RUN), "")


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def raw_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, text_index: int, most_bytes: int = 4 << 20):
    """Parts of a batch with about most_bytes of text each (one row at least), so Python memory stays bounded."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()
