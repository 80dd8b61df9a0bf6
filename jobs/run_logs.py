"""Digests of run reports as they arrive, and the failures that reports of a store share.

    python -m jobs.run_logs --input REPORTS --output OUT --checkpoint CP [--config FILE]

A campaign leaves a report text for each run. This job watches the folder they arrive in as a file stream: each start
takes the files that the checkpoint does not know, writes a digest of each report (line counts, the lines that name a
fault, its last characters, a signature of its last line) to OUT/digests, by batch and store, and brings OUT/signatures,
how many reports of a store end alike, up to date for the stores that the batch touched. A batch that runs again after a
failure replaces its own partitions, so a rerun gives the same tables; a start without new files changes nothing.

A null text counts as empty, a null or empty store as "(none)"; null ids and repeated rows are reports like others.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs.common import default_config, load_config, session
from strainlake.functions import reports

DIGEST = "id long, n_chars long, n_lines long, n_marked long, signature string, excerpt string, batch long, store string"
SIGNATURE = "signature string, alike long, first_id long, last_id long, n_marked long, store string"
_log = logging.getLogger("jobs.run_logs")


@dataclass(frozen=True)
class Config:
    id: str = "doc_id"
    text: str = "text"
    store: str = "source"
    excerpt: int = reports.EXCERPT
    markers: tuple[str, ...] = ("error", "failed", "exception", "traceback")
    files_per_batch: int = 500


def digests(rows: DataFrame, config: Config) -> DataFrame:
    t = rows.select(F.col(config.id).cast("long").alias("id"), F.coalesce(F.nullif(F.col(config.store), F.lit("")), F.lit("(none)")).alias("store"), F.coalesce(config.text, F.lit("")).alias("t"))
    t = t.withColumn("l", reports.lines(F.col("t")))
    return t.select(
        "id", F.char_length("t").cast("long").alias("n_chars"), F.size("l").cast("long").alias("n_lines"), reports.marked(F.col("l"), config.markers).alias("n_marked"),
        reports.signature(F.col("l")).alias("signature"), reports.excerpt(F.col("t"), config.excerpt).alias("excerpt"), "store",
    )


def signatures(of: DataFrame) -> DataFrame:
    """How many reports of a store end alike: counted within each task first, so a store of any size is no hot key."""
    return of.groupBy("store", "signature").agg(F.count("*").alias("alike"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("n_marked").alias("n_marked"))


def _replace(t: DataFrame, path: str, *keys: str) -> None:
    """Writes the partitions that t has rows of, in place of what they held; Spark deals rows so that files are few and none is huge."""
    t.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def pattern(path: str) -> str:
    """A pattern that matches this path alone: a file stream takes a single file by pattern only."""
    bare = path.rstrip("/")
    return bare if any(c in bare for c in "*?[{") else f"{bare[:-1]}[{bare[-1]}]"


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: Config | None = None) -> DataFrame:
    """Takes what is new in `source` (a folder of Parquet files, or one file), waits for it, and returns output()."""
    config = config or Config()
    known = spark.read.parquet(source).select(config.id, config.text, config.store).schema

    def batch(df: DataFrame, number: int) -> None:
        s = df.sparkSession
        _replace(digests(df, config).withColumn("batch", F.lit(number).cast("long")), f"{out}/digests", "batch", "store")
        every = s.read.schema(DIGEST).parquet(f"{out}/digests")
        own = every.where(F.col("batch") == number)
        n = own.count()
        if n:
            touched = own.select("store").distinct()
            _replace(signatures(every.join(touched, "store", "left_semi")), f"{out}/signatures", "store")
        _log.info("batch %d: %d reports read from %s, digests written to %s/digests", number, n, source, out)

    for name, schema, keys in (("digests", DIGEST, ("batch", "store")), ("signatures", SIGNATURE, ("store",))):
        _replace(spark.createDataFrame([], schema), f"{out}/{name}", *keys)  # no partition: the folders alone
    stream = spark.readStream.schema(known).option("maxFilesPerTrigger", config.files_per_batch).parquet(pattern(source))
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    _log.info("%d batches taken in all; signatures are in %s/signatures", (query.lastProgress.batchId + 1) if query.lastProgress else 0, out)
    return output(spark, out)


def output(spark: SparkSession, out: str) -> DataFrame:
    """All digests as written, each with how many reports of its store end alike, and the first and last of them."""
    d = spark.read.schema(DIGEST).parquet(f"{out}/digests")
    return d.join(spark.read.schema(SIGNATURE).parquet(f"{out}/signatures").drop("n_marked"), ["store", "signature"])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Digests of new run reports")
    for name in ("input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="YAML; by default jobs/run_logs.yaml")
    a = p.parse_args(argv)
    spark = session("run-logs")
    try:
        run(spark, a.input, a.output, a.checkpoint, load_config(Config, a.config) if a.config else default_config(Config, "run_logs.yaml"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
