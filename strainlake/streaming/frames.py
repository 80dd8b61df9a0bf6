"""Series of frames as a stream of descriptors: each new frame is paired with the first, or with the one before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

FRAME = "series string, t long, path string"
ANCHORED, SEQUENTIAL = "reference_anchored", "sequential"


def pairs(frames: DataFrame, pairing: str = ANCHORED) -> DataFrame:
    """series, t, reference, deformed: frame paths paired with the series' first frame or the one before."""
    w = Window.partitionBy("series").orderBy("t")
    if pairing == ANCHORED:
        other = F.first("path").over(w)
    elif pairing == SEQUENTIAL:
        other = F.lag("path").over(w)
    else:
        raise ValueError(f"unknown pairing {pairing!r}")
    t = frames.select("series", "t", other.alias("reference"), F.col("path").alias("deformed"), F.row_number().over(w).alias("k"))
    return t.where("k > 1").drop("k")


def stream(spark: SparkSession, source: str, checkpoint: str, seen: str, act: Callable[[DataFrame, int], None], pairing: str = ANCHORED) -> StreamingQuery:
    """Watches a folder of frame descriptors (Parquet) and calls act with the new pairs of each batch.

    Frames seen so far are kept as a table beside the checkpoint, written by batch number, so a batch that runs again
    after a failure replaces itself; pairs of late frames are made when these come.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        s = df.sparkSession
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(seen)
        known = s.read.schema(FRAME + ", epoch int").parquet(seen).where(F.col("epoch") <= epoch)
        own = pairs(known.dropDuplicates(["series", "t"]), pairing)
        new = known.where(F.col("epoch") == epoch).select("series", "t")
        act(own.join(new, ["series", "t"], "left_semi"), epoch)

    return spark.readStream.schema(FRAME).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PAIR = "series string, t long, reference string, deformed string, late boolean"
#: Kept for a series: its first frame, the latest frames (times and paths, ascending), and whether others were let go.
SERIES = "first_t long, first_path string, times array<long>, paths array<string>, more boolean"
#: Latest frames that a series keeps, so that a late one still finds the frame before it.
HISTORY = 64


def _meet(known: tuple | None, new: list[tuple[int, str]], pairing: str, history: int) -> tuple[tuple, list[tuple]]:
    """The state after new frames (t, path) have come, and (t, reference, deformed, late) of each that has a partner."""
    first_t, first_path, times, paths, more = known or (None, None, [], [], False)
    held = dict(zip(times, paths, strict=True))
    since = first_t
    beyond = lambda t: more and since < t < times[0]
    fresh: dict[int, str] = {}
    for t, path in sorted(new):
        if t not in held and t != first_t:
            fresh.setdefault(t, path)
    late = [t for t in fresh if beyond(t) and (pairing == SEQUENTIAL)]
    merged = sorted({**held, **{t: p for t, p in fresh.items() if t not in late}}.items())
    if merged and (first_t is None or merged[0][0] < first_t):
        first_t, first_path = merged[0]
    out, before = [(t, None, fresh[t], True) for t in late], None
    for t, path in merged:
        if t in fresh and t != first_t:
            out.append((t, first_path if pairing == ANCHORED or before is None else before, path, beyond(t)))
        before = path
    kept = merged[-history:]
    return (first_t, first_path, [t for t, _ in kept], [p for _, p in kept], more or len(merged) > history), out


def paired(frames: DataFrame, pairing: str = ANCHORED, history: int = HISTORY) -> DataFrame:
    """pairs() as a stateful stream: series, t, reference, deformed, late; a batch touches its own frames alone.

    The state of a series is its first frame and its `history` latest ones, whatever its length. A frame is paired with
    what is known when it comes, frames of its batch included; a frame before the first becomes the first of later ones.
    Frames that come again within the history give nothing. With sequential pairing a frame older than the history has
    no reference (null) and is marked late, to be paired from the stored descriptors. Frames without t or path are left
    out. Descriptors of one series within one batch are sorted in one task: bound them by the source's maxFilesPerTrigger.
    """
    if pairing not in (ANCHORED, SEQUENTIAL):
        raise ValueError(f"unknown pairing {pairing!r}")
    if history < 1:
        raise ValueError(f"history must be at least 1, got {history}")

    def run(key, parts, state):
        import pandas as pd

        new = [x for part in parts for x in zip(part["t"].tolist(), part["path"].tolist(), strict=True)]
        known, out = _meet(tuple(state.get) if state.exists else None, new, pairing, history)
        state.update(known)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in PAIR.split(", ")])

    t = frames.where("t is not null and path is not null").select("series", "t", "path")
    return t.groupBy("series").applyInPandasWithState(run, PAIR, SERIES, "append", "NoTimeout")


def stream_pairs(spark: SparkSession, source: str, checkpoint: str, out: str, pairing: str = ANCHORED, history: int = HISTORY, most_files: int = 1000) -> StreamingQuery:
    """Writes the pairs of new frame descriptors (Parquet files in source) to out as Parquet; takes what is there, then ends."""
    frames = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", most_files).parquet(source)
    return paired(frames, pairing, history).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
