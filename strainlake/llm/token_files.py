"""Token files: Parquet tables of id lists in ascending doc_id order, and their readers.

A row holds one document: doc_id, part (number of its file), part_start (ids before it in its part), n_tokens and the
list column ids. Ids are dictionary encoded, row groups and pages are kept small, and Parquet's page index is written,
so doc_id ranges and the columns without ids can be read alone.

Texts are dealt to parts by ranges of doc_id and encoded there: a text's bytes are fewer than those of its ids. The
ranges come from quantiles of doc_id, a column that is read alone; nothing but the texts is read for the exchange.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strainlake.llm.common import new_path, slices

END_ID = 0
#: Dictionary pages up to 1 MB hold all ids of a 50k vocabulary; row groups of 32 MB and pages of 256 KB.
FORMAT = {
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}
#: Text bytes that are encoded at once, so that a worker's memory is bounded.
SLICE_BYTES = 6 << 20
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_SUMS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, parts: int | None = None) -> None:
    """Encodes each text, appends end_id and writes the files; a null text is empty, a null id comes first.

    parts: number of ranges of doc_id, by default the session's shuffle partitions. Rows with one id follow each other in no set order; other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from strainlake.llm.tokens import encoder

        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                ids, offs = enc.encode(some.column(1))
                ids = np.insert(ids, offs[1:], end_id).astype(np.int32)
                offs = offs + np.arange(len(offs))
                n = np.diff(offs)
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + offs[:-1]), pa.array(n), lists], schema=_ARROW
                )
                before += int(offs[-1])
            pa.default_memory_pool().release_unused()

    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    dealt = d.repartitionById(n, _part(d, n)).sortWithinPartitions("doc_id")
    dealt.mapInArrow(run, SCHEMA).write.options(**FORMAT).parquet(path)


def _part(d: DataFrame, n: int) -> Column:
    """The range of doc_id, 0 to n - 1: how many of n - 1 quantiles lie below it. A null id lies below all."""
    found = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    # A binary search, by falling powers of two.
    array = F.array(*[F.lit(x) for x in bounds]) if len(bounds) < 100 else F.expr(f"from_json('{bounds}', 'array<bigint>')")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    below = lambda at: F.coalesce(F.get(array, at - 1) < F.col("doc_id"), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at + step), at + step).otherwise(at))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start and n_tokens of each document; the ids are not read."""
    table = spark.read.schema(SCHEMA).parquet(path).drop("ids")
    return _started(table, spark, path)


def _started(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    # One sum for each file part: as many rows as the write had tasks.
    sums = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, table = 0, []
    for r in sums:
        table.append((r["part"], before))
        before += r["n"]
    parts = spark.createDataFrame(table, "part int, before long")
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before", "part_start")


def read(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """The documents with doc_id in [lo, hi] (all without bounds) with their ids; the page index skips other pages."""
    t = _started(spark.read.schema(SCHEMA).parquet(path), spark, path)
    if lo is not None:
        t = t.where(F.col("doc_id") >= lo)
    return t if hi is None else t.where(F.col("doc_id") <= hi)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the ids read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            offs = lists.offsets.to_numpy().astype(np.int64)
            raw = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            n = pa.array(np.diff(offs), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), n, pa.array(crc, pa.int64())], schema=_SUMS)

    rows = spark.read.schema(SCHEMA).parquet(path).mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return _started(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **columns: str) -> DataFrame:
    """Writes docs to token files in the work folder and returns what checksums() reads from them."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer, **columns)
    return checksums(spark, path)
