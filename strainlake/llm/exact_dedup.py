"""Exact deduplication by a log-structured merge index of digests.

Documents are reduced to a log of (digest, length, id). Each input task is a memtable: its digests are flushed as a
run, sorted by digest. Compaction merges FANOUT runs into one of the next level, keeping the smallest entry of each
digest, until one run is left. The run's filter, a bitmap of the hashes of the digests that occur more than once, is
asked before the look-up: a document that it rules out is alone and meets no other row. The others look up their
digest, and every group of hits is verified byte by byte; a second filter, of the members' ids, keeps all other texts
out of that join. Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from strainlake.llm.common import WS_RUN, discard, free, release, written

FANOUT = 16
#: Digests with at least this share of all rows are looked up by broadcast: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: Bits of a filter for each key, and the size up to which it is broadcast; beyond, rows are joined without one.
FILTER_BITS = 16
MOST_FILTER = 8 << 20
#: Bits in a row of a filter: what Spark's bitmaps hold.
ROW_BITS = 4096 * 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_RUN, "")


def sha256(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


def _entry() -> Column:
    """The order in which a row stays: most code points, then smallest id (null last), then first in the log."""
    return F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"))


def flush(log: DataFrame) -> DataFrame:
    """Level 0: one sorted run for each input task (its number is the upper half of uid)."""
    return log.withColumn("run", F.shiftright("uid", 33)).groupBy("run", "digest").agg(F.min(_entry()).alias("entry"), F.count("*").alias("group_size"))


def merged(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: each run is the merge of fanout runs; equal digests keep their smallest entry."""
    return level.withColumn("run", F.floor(F.col("run") / fanout)).groupBy("run", "digest").agg(F.min("entry").alias("entry"), F.sum("group_size").alias("group_size"))


def _run_table(level: DataFrame, name: str) -> DataFrame:
    return written(level.sortWithinPartitions("run", "digest"), name)


def build_index(log: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The compacted index: one run with digest, entry, group_size."""
    level = _run_table(flush(log), "run0")
    top = level.agg(F.max("run")).first()[0] or 0
    n = 0
    while top > 0:
        n, top = n + 1, top // fanout
        below, level = level, _run_table(merged(level, fanout), f"run{n}")
        discard(below)
    return level


def key_filter(keys: DataFrame, key: Column, n: int) -> tuple[DataFrame, int] | None:
    """Rows (at, bits) of a bitmap of the keys' hashes, and how many there may be; none if that is too large to broadcast."""
    rows = 1
    while rows * ROW_BITS < FILTER_BITS * n:
        rows *= 2
    if rows * ROW_BITS // 8 > MOST_FILTER:
        return None
    h = F.pmod(F.xxhash64(key), F.lit(rows * ROW_BITS))
    marks = keys.select(F.floor(h / ROW_BITS).cast("int").alias("at"), F.pmod(h, F.lit(ROW_BITS)).alias("bit"))
    return marks.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")), rows


def may_hold(df: DataFrame, key: Column, filter_: tuple[DataFrame, int], name: str) -> DataFrame:
    """df with column name: false where the filter rules the key out."""
    marks, rows = filter_
    at, bits, bit = free(df, "at", "bits", "bit")
    h = F.pmod(F.xxhash64(key), F.lit(rows * ROW_BITS))
    asked = df.withColumns({at: F.floor(h / ROW_BITS).cast("int"), bit: F.pmod(h, F.lit(ROW_BITS)).cast("int")})
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = asked.join(F.broadcast(marks.select(F.col("at").alias(at), F.col("bits").alias(bits))), at, "left")
    return held.withColumn(name, F.coalesce(F.getbit(byte, F.pmod(F.col(bit), F.lit(8))) == 1, F.lit(False))).drop(at, bits, bit)


def _look_up(log: DataFrame, index: DataFrame, total: int) -> DataFrame:
    """log with entry and group_size; hot digests are joined by broadcast, so no task gets all rows of one."""
    most = max(1000, int(total * HOT_SHARE))
    many = index.where(F.col("group_size") > 1)
    hot = many.where(F.col("group_size") > most)
    first = log.join(F.broadcast(hot), "digest", "left")
    found, open_ = first.where(F.col("entry").isNotNull()), first.where(F.col("entry").isNull()).drop("entry", "group_size")
    alone = lambda d: d.withColumns({"entry": _entry(), "group_size": F.lit(1).cast("long")})
    own = key_filter(many, F.col("digest"), many.count())
    if own:
        open_ = may_hold(open_, F.col("digest"), own, "held")
        found = found.unionByName(alone(open_.where(~F.col("held")).drop("held")))
        open_ = open_.where("held").drop("held")
    rest = open_.join(many.where(F.col("group_size") <= most), "digest", "left")
    rest = rest.withColumns({"entry": F.coalesce("entry", _entry()), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return found.unionByName(rest.select(found.columns))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, fanout: int = FANOUT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal without ASCII white space; a null text counts as empty. The longest original stays,
    then the smallest id; a null id comes after all others, and of wholly repeated rows one is kept. Texts of any length
    are taken whole. Other columns are ignored, whatever their names; an empty table gives no rows. digest may be any function of the normalised text: equal digests of unequal texts are told apart.
    """
    # A row's number is drawn once and written, so it stays the same when tasks run again.
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    log = d.select("doc_id", normalised(F.col("t")).alias("normal"), F.length("t").alias("n_points"))
    log = written(log.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_points", digest(F.col("normal")).alias("digest"), F.sha2("normal", 256).alias("text_sha256")), "log")
    index = build_index(log, fanout)
    resolved = written(_look_up(log, index.drop("run"), log.count()), "hits")
    discard(log, index)

    # Byte verification: all members of a group must be one text. Tasks first reduce their own members.
    members = resolved.where("group_size > 1").select(F.col("doc_id").alias("member"), "digest").distinct()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = key_filter(members, F.col("member"), members.count())
    if ids:
        texts = may_hold(texts, F.col("doc_id"), ids, "held").where("held").drop("held")
    of = texts.select("doc_id", normalised(F.col("text")).alias("normal")).join(members, F.col("doc_id").eqNullSafe(F.col("member")))
    own = of.where(digest(F.col("normal")) == F.col("digest")).select("digest", "normal")
    wrong = own.groupBy("digest").agg(F.min("normal").alias("lo"), F.max("normal").alias("hi")).where("lo <> hi").select("digest")
    wrong = written(wrong, "unequal")
    right = resolved
    if wrong.limit(1).count():
        # Unequal texts behind one digest: these rows are grouped by their SHA-256, then checked by their bytes too.
        bad = resolved.join(wrong, "digest", "left_semi").drop("entry", "group_size")
        groups = bad.groupBy("digest", "text_sha256").agg(F.min(_entry()).alias("entry"), F.count("*").alias("group_size"))
        right = resolved.join(wrong, "digest", "left_anti").unionByName(bad.join(groups, ["digest", "text_sha256"]))
    out = written(right.select("doc_id", F.col("entry.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("entry.uid")).alias("kept"), "text_sha256"), "kept")
    discard(resolved, wrong)
    release(docs.sparkSession)
    return out


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that dedup() keeps."""
    found = dedup(docs, doc_id, text)
    stay, sha, own, n = free(docs, "stay", "sha", "own", "n")
    some = found.where("kept").select(F.col("doc_id").alias(stay), F.col("text_sha256").alias(sha)).distinct()
    if not found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.join(some, F.col(doc_id).eqNullSafe(F.col(stay)), "left_semi")
    # Rows share an id: the text tells which stays, and of whole copies one does.
    with_own = docs.withColumn(own, F.sha2(normalised(F.col(text)), 256))
    with_own = with_own.join(some, F.col(doc_id).eqNullSafe(F.col(stay)) & (F.col(own) == F.col(sha)), "left_semi")
    first = Window.partitionBy(doc_id, own).orderBy(F.desc(F.length(F.coalesce(F.col(text), F.lit("")))))
    return with_own.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n, own)
