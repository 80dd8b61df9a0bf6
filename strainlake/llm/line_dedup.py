"""Line deduplication by a deletion-neighbourhood join: near-equal lines share a variant with one character deleted.

A line is removed when an equal line, or one within edit distance 1, occurs earlier (by document id, then line).
Distinct lines first pass two sieves that no pair within the bound can fail: half of the line is shared, then all but
one piece of PIECE characters is shared. Such pieces emit all their deletion variants as hashed keys; lines with an
equal variant at the same place differ by a substitution, a line whose variant is another line by an insertion. Each
line meets only the earliest of its key, never all pairs, and that pair's edit distance is verified. Lines of a key are
one another's neighbours but for one character at one place, so there are at most as many as characters. Native:
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strainlake.llm.common import discard, free, release, written

PIECE = 64
#: Least characters of a line that is matched near; 1 is all of them.
MIN_NEAR = 1
#: Lines with at least this share of all occurrences are looked up by broadcast: there are at most 1 / HOT_SHARE.
HOT_SHARE = 0.001


def _line(raw: Column) -> Column:
    return F.btrim(raw, F.lit(" \t\n\x0b\f\r"))


def _occurrences(docs: DataFrame, doc_id: str, text: str, min_near: int) -> DataFrame:
    """uid, doc_id, no, digest (null: blank), n and the half keys of each line."""
    d = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("ls"))
    d = d.select("uid", "doc_id", F.posexplode("ls").alias("no", "raw")).select("uid", "doc_id", "no", _line(F.col("raw")).alias("line")).withColumn("n", F.length("line"))
    n, line = F.col("n"), F.col("line")
    keys = []
    for m in (n, n - 1):  # as one of two lines of equal length, and as the longer of two
        h = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(m, F.lit(0), F.left(line, h)), F.xxhash64(m, F.lit(1), F.right(line, m - h))]
    # The shorter of two has the same keys as one of equal length.
    return d.select("uid", "doc_id", "no", F.when(n > 0, F.unhex(F.md5(line.cast("binary")))).alias("digest"), "n", F.when(n >= min_near, F.array(*keys)).alias("halves"))


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("no").alias("no"))


def _survivors(lines: DataFrame) -> DataFrame:
    """Lines that share a half with another distinct line."""
    keys = lines.where("halves is not null").select("digest", "first", F.explode(F.array_distinct("halves")).alias("key"))
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    return keys.join(shared, "key", "left_semi").select("digest", "first").distinct()


def _with_text(lines: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """lines (digest, first) with the text of their first occurrence."""
    ids = lines.select(F.col("first.id").alias("i")).distinct()
    d = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    d = d.join(ids, F.col("d").eqNullSafe(F.col("i")), "left_semi").select("d", F.posexplode(F.split("t", "\n")).alias("k", "raw")).select("d", "k", _line(F.col("raw")).alias("line"))
    both = lines.join(d, F.col("first.id").eqNullSafe(F.col("d")) & (F.col("first.no") == F.col("k")) & (F.col("digest") == F.unhex(F.md5(F.col("line").cast("binary")))))
    return both.select("digest", "first", "line").dropDuplicates(["digest"])


def _pieces(lines: DataFrame) -> DataFrame:
    """For each piece of a line its place key and what lies in it, in three roles.

    s: one of two lines of equal length; l: the longer, and k: the shorter of two whose lengths differ by one.
    """
    line = F.col("line")
    d = lines.withColumn("n", F.length("line"))
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), (F.col("n") / PIECE).cast("int")))).withColumn("b", F.col("b") * PIECE)
    n, b = F.col("n"), F.col("b")
    rest = lambda at: F.substring(line, at + 1, n)
    before = F.xxhash64(F.left(line, b))
    full, less = F.least(b + PIECE, n), F.least(b + PIECE - 1, n)
    role = lambda r, size, end: F.struct(F.lit(r).alias("role"), F.xxhash64(F.lit("s" if r == "s" else "d"), size, b, before, F.xxhash64(rest(end))).alias("place"), F.substring(line, b + 1, end - b).alias("mid"))
    roles = F.array(F.when(b < n, role("s", n, full)), F.when(b < n, role("l", n - 1, full)), role("k", n, less))
    return d.select("digest", "first", F.explode(F.filter(roles, lambda x: x.isNotNull())).alias("x")).select("digest", "first", "x.*")


def _variants(pieces: DataFrame) -> DataFrame:
    """digest, first, role, variant: the hashed variants of pieces whose place another line shares."""
    shared = pieces.groupBy("place").agg(F.min("role").alias("a"), F.max("role").alias("z"), F.count("*").alias("c")).where("c > 1 and (a = 's' or a <> z)").select("place")
    p = pieces.join(shared, "place", "left_semi")
    mid = F.col("mid")
    gone = lambda i: F.concat(F.left(mid, i - 1), F.substring(mid, i + 1, F.length(mid)))
    each = F.sequence(F.lit(1), F.length(mid))
    keys = (
        F.when(F.col("role") == "s", F.transform(each, lambda i: F.xxhash64("place", i, gone(i))))
        .when(F.col("role") == "l", F.array_distinct(F.transform(each, lambda i: F.xxhash64("place", F.lit(0), gone(i)))))
        .otherwise(F.array(F.xxhash64("place", F.lit(0), mid)))
    )
    return p.select("digest", "first", "role", F.explode(keys).alias("variant"))


def near_lines(docs: DataFrame, lines: DataFrame, doc_id: str, text: str, min_near: int = MIN_NEAR) -> DataFrame:
    """digest and earliest: lines that have an earlier one within edit distance 1, with that line's digest."""
    some = written(_with_text(_survivors(lines), docs, doc_id, text), "survivors")
    v = _variants(_pieces(some))
    by = Window.partitionBy("variant")
    own = lambda r: F.min(F.when(F.col("role") == r, F.struct("first", "digest"))).over(by)
    met = v.select("digest", "first", F.when(F.col("role") == "s", own("s")).when(F.col("role") == "l", own("k")).otherwise(own("l")).alias("other"))
    met = met.where(F.col("other.first") < F.col("first")).groupBy("digest").agg(F.collect_set("other.digest").alias("others"))
    pairs = met.select("digest", F.explode("others").alias("earliest"))
    text_of = lambda c, t: some.select(F.col("digest").alias(c), F.col("line").alias(t), F.col("first").alias(f"f{t}"))
    both = pairs.join(text_of("digest", "x"), "digest").join(text_of("earliest", "y"), "earliest")
    good = both.where(F.levenshtein("x", "y", 1) == 1).where(F.least(F.length("x"), F.length("y")) >= min_near)
    return good.groupBy("digest").agg(F.min_by("earliest", "fy").alias("earliest"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_near: int = MIN_NEAR) -> DataFrame:
    """One row per document: doc_id, n_lines (not blank), n_copies, n_near (removed lines), removed (their numbers).

    Numbers count all lines of a text from 0. A null text has no lines; a null id comes after all others. Rows that
    share an id number their lines alike, so none of them removes the other's; texts and lines of any length are taken
    whole; ids are integers, a text id that is no number raises; other columns are ignored; an empty table gives no rows.
    min_near: lines with fewer characters are compared as they are; by default there are none.
    """
    occ = written(_occurrences(docs, doc_id, text, min_near), "occurrences")
    real = occ.where("digest is not null")
    lines = real.groupBy("digest").agg(F.min(_first()).alias("first"), F.count("*").alias("count"), F.min("halves").alias("halves"))
    lines = written(lines, "lines")
    near = near_lines(docs, lines, doc_id, text, min_near)
    table = written(lines.select("digest", "first", "count").join(near.select("digest", F.lit(True).alias("near")), "digest", "left").where("count > 1 or near"), "decisions")
    most = max(1000, int(real.count() * HOT_SHARE))
    hot = table.where(F.col("count") > most).select("digest", "first", F.coalesce("near", F.lit(False)).alias("near"))
    cold = table.where(F.col("count") <= most).select("digest", "first", F.coalesce("near", F.lit(False)).alias("near"))
    mine = occ.select("uid", "doc_id", "no", "digest").join(F.broadcast(hot), "digest", "left")
    rest = mine.where("first is null").drop("first", "near").join(cold, "digest", "left")
    judged = mine.where("first is not null").unionByName(rest)
    copy = F.col("first").isNotNull() & (_first() != F.col("first"))
    judged = judged.select("uid", "doc_id", "no", F.col("digest").isNotNull().alias("real"), F.coalesce(copy, F.lit(False)).alias("copy"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = F.col("copy") | F.col("near")
    out = judged.groupBy("uid", "doc_id").agg(
        F.count_if("real").alias("n_lines"), F.count_if("copy").alias("n_copies"), F.count_if(F.col("near") & ~F.col("copy")).alias("n_near"), F.sort_array(F.collect_list(F.when(gone, F.col("no")))).alias("removed")
    ).drop("uid")
    out = written(out, "removed")
    discard(occ, lines, table)
    release(docs.sparkSession)
    return out


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns as they are, with the removed lines taken out of text; ids must not repeat."""
    i, gone = free(docs, "i", "gone")
    lines = dedup(docs, doc_id, text).select(F.col("doc_id").alias(i), F.col("removed").alias(gone))
    joined = docs.join(lines, F.col(doc_id).cast("long").eqNullSafe(F.col(i)), "left")
    stay = F.filter(F.split(F.col(text), "\n"), lambda x, at: ~F.array_contains(F.col(gone), at))
    return joined.select(*[F.array_join(stay, "\n").alias(c) if c == text else F.col(c) for c in docs.columns])
