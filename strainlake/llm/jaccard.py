"""N-gram Jaccard join with set-relation skipping, and the components of its links.

Equal sets are one class. Each class is indexed by its prefix: the first n - ceil(0.9 n) + 1 of its shingles in one
global order, rare ones first, so that two linked sets share a prefix shingle. Index lists are sorted by set size and
carry positions; blocks whose sizes or positions cannot reach the threshold are skipped. Answers are derived across
similar sets, in three passes over the lists, each verified against the texts before the next begins:

1. Each set is compared with the middle set of its block and takes over the component of the nearest one it links to.
2. Within a list a set takes over the answers of the sets found near it so far: what one of them is linked to needs no
   further pair. Near-certain links (well within the bound) go first, so a list gives fewer pairs than it has sets.
3. All pairs that are still of different components and not yet verified.

A parity sketch (a lower bound of the symmetric difference, wide enough to be nearly exact about the bound) drops
pairs before their texts are compared. Lists longer than CHUNK are dealt out as pairs of chunks, so a task's list is
bounded; all pairs of chunks are there, so no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strainlake.llm.common import discard, free, release, slices, written

WORDS = 3
THRESHOLD = (90, 100)
#: A shingle in the prefixes of at least so many classes goes to the end of the order; at most MOST_HOT do, the most
#: frequent. Any such set gives the same links: it only keeps lists short.
HOT = 48
MOST_HOT = 1 << 20
#: Lists longer than this carry sketches, so that only near pairs leave them; shorter ones give few pairs anyway.
SHORT = 64
#: Longer lists are dealt out by chunks of about so many sets.
CHUNK = 2048
#: Bytes of text whose shingles are made at once.
PART = 1 << 20
#: Words of up to so many bytes are hashed eight bytes at a time, all of a part at once.
SHORT_WORD = 64


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie end to end in data (bytes), the first word of each text (and one past
    the last), and the bytes with A-Z lower-cased."""
    import xxhash

    n = len(data)
    low = np.zeros((n // 8 + 2) * 8, np.uint8)
    np.take(_LOWER, data, out=low[:n])
    inside = np.zeros(n + 2, bool)
    np.take(_IN_WORD, data, out=inside[1:-1])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offs[1:-1]
    at = cuts[(cuts > 0) & (cuts < n)]  # a word never reaches into the next text
    begins[at] |= inside[at + 1]
    ends[at - 1] |= inside[at]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    h = size.astype(np.uint64) * _MIX[0]
    eight = low.view("<u8")
    on = np.arange(len(start))
    for done in range(0, SHORT_WORD, 8):
        if done:
            on = on[size[on] > done]
        if not len(on):
            break
        where = start[on] + done
        bit = ((where & 7) << 3).astype(np.uint64)
        where >>= 3
        value = (eight[where] >> bit) | (eight[where + 1] << (np.uint64(64) - bit))  # NumPy's shift by 64 gives 0
        value &= _FIRST[np.minimum(size[on] - done, 8)]
        value ^= h[on]
        value *= _MIX[1]
        value ^= value >> np.uint64(32)
        value *= _MIX[2]
        value ^= value >> np.uint64(29)
        h[on] = value
    for i in np.flatnonzero(size > SHORT_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(low[start[i] : start[i] + size[i]])
    return h, np.searchsorted(start, offs), low


def shingle_parts(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles, end to end, and the texts' offsets; of the whole
    sequence if a text has fewer words. texts: a string column; null counts as empty."""
    import pyarrow.compute as pc
    import xxhash

    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    h, first, low = _word_hashes(data, offs)
    words = np.diff(first)
    count = np.where(words < k, words > 0, words - k + 1)
    cut = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = (out ^ (h[i : i + len(out)] * np.uint64(0x9E3779B97F4A7C15 + 2 * i))) * _MIX[2]
        out ^= out >> np.uint64(29)
    of = np.repeat(np.arange(len(words)), words)
    flat = np.zeros(cut[-1], np.uint64)
    few = np.flatnonzero((words > 0) & (words < k))
    whole = np.ones(len(flat), bool)
    whole[cut[few]] = False
    flat[whole] = out[of[: len(out)] == of[k - 1 :]]
    for i in few.tolist():
        flat[cut[i]] = xxhash.xxh64_intdigest(b" ".join(low[offs[i] : offs[i + 1]].tobytes().split()), seed=int(words[i]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[cut[:-1][count > 0]] = True
    return flat[new], np.concatenate([[0], np.cumsum(new)])[cut]


def shingle_lists(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """The same, an array for each text."""
    flat, cut = shingle_parts(texts, k)
    return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def shingles(raw: bytes, k: int = WORDS) -> np.ndarray:
    """The same of one text."""
    return shingle_parts(pa.array([raw], pa.large_binary()), k)[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_MIX = np.asarray([0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC2B2AE3D27D4EB4F], np.uint64)
#: The first 0 to 8 bytes of eight.
_FIRST = np.asarray([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def prefix_length(n: int, at_least: tuple[int, int] = THRESHOLD) -> int:
    a, b = at_least
    return n - -(-a * n // b) + 1


def most_apart(total: np.ndarray | int, at_least: tuple[int, int] = THRESHOLD):
    """The largest symmetric difference of two linked sets whose sizes sum to total."""
    a, b = at_least
    return total * (b - a) // (b + a)


def sketch(s: np.ndarray, at_least: tuple[int, int] = THRESHOLD) -> bytes:
    """Parity of the shingles in each of m buckets, m a power of two of at least 16 times what may differ."""
    m = max(64, 1 << int(16 * most_apart(2 * len(s), at_least)).bit_length())
    return np.packbits((np.bincount(((s >> np.uint64(20)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(bool), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sketched sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def shingle_sets(docs: DataFrame, doc_id: str, text: str, at_least: tuple[int, int], k: int) -> DataFrame:
    """doc_id, n, sig (of the whole set), prefix, sketch for each row."""
    types = [("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, 1, PART):
                rows = []
                for i, s in zip(part.column(0).to_pylist(), shingle_lists(part.column(1), k), strict=True):
                    rows.append((i, len(s), xxhash.xxh128_digest(s.tobytes()), s[: prefix_length(len(s), at_least) if len(s) else 0].view(np.int64), sketch(s, at_least)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], schema=pa.schema(types))

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n long, sig binary, prefix array<long>, sketch binary")


def _hot(reps: DataFrame) -> np.ndarray:
    """Sorted hot shingles: in at least HOT prefixes, fewer where that would be more than MOST_HOT."""
    counts = written(reps.select(F.explode("prefix").alias("s")).groupBy("s").count().where(F.col("count") >= HOT), "hot")
    least = HOT
    sizes = counts.groupBy(F.floor(F.log2("count")).alias("b")).count().orderBy(F.desc("b")).collect()  # 64 rows at most
    seen = 0
    for r in sizes:
        seen += r["count"]
        if seen > MOST_HOT:
            least = 1 << (r["b"] + 1)
            break
    return np.sort(np.asarray([r["s"] for r in counts.where(F.col("count") >= least).select("s").collect()], np.int64).view(np.uint64))


def _ordered_prefixes(docs: DataFrame, doc_id: str, text: str, at_least: tuple[int, int], k: int, hot: np.ndarray) -> DataFrame:
    """doc_id and prefix with hot shingles last, of the documents that have a hot one in their prefix."""
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = held.value
        for batch in batches:
            for part in slices(batch, 1, PART):
                ids, out = [], []
                flat, cut = shingle_parts(part.column(1), k)
                found = h[np.minimum(np.searchsorted(h, flat), len(h) - 1)] == flat
                for i, begin, end in zip(part.column(0).to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    s, is_hot = flat[begin:end], found[begin:end]
                    p = prefix_length(len(s), at_least) if len(s) else 0
                    if is_hot[:p].any():
                        ids.append(i)
                        out.append(np.concatenate([s[~is_hot], s[is_hot]])[:p].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "prefix"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, prefix array<long>")


class _Sketches:
    """The sketches of a list, by size; wider ones are folded to meet the next narrower size."""

    def __init__(self, raw: list[bytes]):
        self.bits = np.fromiter(map(len, raw), np.int64, len(raw))
        self.row = np.zeros(len(raw), np.int64)
        self.of: dict[int, np.ndarray] = {}
        self.folded: dict[int, np.ndarray] = {}
        for m in np.unique(self.bits).tolist():
            at = np.flatnonzero(self.bits == m)
            self.row[at] = np.arange(len(at))
            self.of[m] = np.frombuffer(b"".join([raw[i] for i in at]), np.uint8).reshape(len(at), m)
            if m > 8:
                half = self.of[m]
                self.folded[m // 2] = half[:, : m // 2] ^ half[:, m // 2 :]

    def apart(self, i: int, j: np.ndarray) -> np.ndarray:
        """Lower bounds of the symmetric difference of set i and the sets j, none of which is smaller."""
        m = int(self.bits[i])
        own = self.of[m][self.row[i]].view(np.uint64)
        out = np.zeros(len(j), np.int64)  # 0 where sizes are too far apart to compare here: those stay
        for bits, table in ((m, self.of.get(m)), (2 * m, self.folded.get(m))):
            at = np.flatnonzero(self.bits[j] == bits)
            if len(at):
                out[at] = np.bitwise_count(table[self.row[j[at]]].view(np.uint64) ^ own).sum(1)
        return out


#: What a pass over the lists tells: pairs with the middle of their block, the pairs by which sets of different
#: components take over each other's answers, or all pairs of different components.
MIDDLES, ANSWERS, ALL = "middles", "answers", "all"


def _dealt(lists: DataFrame, by: str) -> DataFrame:
    """lists with sub-key i, j and the set's own chunk: 0, 0, 0 but for lists longer than CHUNK (column size)."""
    short = lists.where(F.col("size") <= CHUNK).select("*", *[F.lit(0).alias(c) for c in ("i", "j", "chunk")])
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    long = lists.where(F.col("size") > CHUNK).withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
    if by == MIDDLES:
        long = long.select("*", F.col("chunk").alias("i"), F.col("chunk").alias("j"))
    else:
        other = F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")
        long = long.select("*", other).select("*", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).drop("other")
    return short.unionByName(long)


def _pairs(lists: DataFrame, at_least: tuple[int, int], by: str) -> DataFrame:
    """Distinct pairs (x, y) from lists (s, size, n, pos, rep, comp) as by says.

    With a column sketch, pairs that it rules out stay in the list's task.
    """
    a, b = at_least
    sketched = ["sketch"] * ("sketch" in lists.columns)

    def of_list(i_chunk: int, j_chunk: int, chunk: np.ndarray, n: np.ndarray, pos: np.ndarray, rep: np.ndarray, comp: np.ndarray, *sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if (comp == comp[0]).all():
            return
        ends = np.searchsorted(n, n * b // a, side="right")  # sizes beyond cannot be linked: those blocks are skipped
        if by == MIDDLES:
            i = 0
            while i < len(n):
                # A block that reaches from the smallest to its middle, and from there as far again.
                mid = (i + int(ends[i]) - 1) // 2
                stop = max(int(ends[mid]), i + 1)
                j = np.arange(i, stop)
                j = j[(comp[j] != comp[mid]) & (pos[j] + pos[mid] <= most_apart(n[j] + n[mid], at_least))]
                yield rep[j], np.full(len(j), rep[mid])
                i = stop
            return
        own = _Sketches(sketch[0].tolist()) if sketch else None
        label = np.unique(comp, return_inverse=True)[1]
        # Near-certain links first: their sets share answers, so fewer pairs are left to the others.
        for strict in (True, False) if own and by == ANSWERS else (False,):
            for i in range(len(n) - 1):
                j = np.arange(i + 1, ends[i])
                most = most_apart(n[j] + n[i], at_least)
                on = (label[j] != label[i]) & (pos[j] + pos[i] <= most)
                if i_chunk != j_chunk:
                    on &= chunk[j] != chunk[i]
                j, most = j[on], most[on]
                if own and len(j):
                    d = own.apart(i, j)
                    on = 4 * d <= 3 * most if strict else d <= most
                    j, d = j[on], d[on]
                if not len(j):
                    continue
                if by == ANSWERS:
                    if own:
                        j = j[np.argsort(d, kind="stable")]
                    new, first = np.unique(label[j], return_index=True)  # the nearest of each other label
                    j = j[first]
                    label[np.isin(label, new)] = label[i]
                yield rep[j], np.full(len(j), rep[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def told(xs: list[np.ndarray], ys: list[np.ndarray]) -> pa.RecordBatch:
            xy = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], 1), axis=0)  # lists repeat each other's pairs
            return pa.RecordBatch.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])

        def edges(cols: list[np.ndarray]) -> np.ndarray:
            return np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cuts = edges(cols).tolist()
            xs, ys, n = [], [], 0
            for begin, end in zip([0, *cuts], [*cuts, len(cols[0])], strict=True):
                if end - begin > 1:
                    for x, y in of_list(cols[1][begin], cols[2][begin], *(c[begin:end] for c in cols[3:])):
                        xs.append(np.minimum(x, y))
                        ys.append(np.maximum(x, y))
                        n += len(x)
                        if n > 200_000:
                            yield told(xs, ys)
                            xs, ys, n = [], [], 0
            if n:
                yield told(xs, ys)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if left is not None:
                cols = [np.concatenate([p, c]) for p, c in zip(left, cols, strict=True)]
            cuts = edges(cols)
            last = int(cuts[-1]) if len(cuts) else 0  # the last list may go on in the next batch
            left = [c[last:] for c in cols]
            if last:
                yield from out([c[:last] for c in cols])
        if left is not None:
            yield from out(left)

    dealt = _dealt(lists, by).select("s", "i", "j", "chunk", "n", "pos", "rep", "comp", *sketched)
    dealt = dealt.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "n", "rep")
    return dealt.mapInArrow(run, "x long, y long").distinct()


def _near(pairs: DataFrame, reps: DataFrame, at_least: tuple[int, int]) -> DataFrame:
    """pairs whose sketches do not rule a link out, with that bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nx, ny, sx, sy = (c.to_pylist() for c in batch.columns)
            d = [apart(p, q) for p, q in zip(sx, sy, strict=True)]
            on = [i for i, v in enumerate(d) if v <= most_apart(nx[i] + ny[i], at_least)]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in on], pa.int64()) for c in (x, y, d)], names=["x", "y", "d"])

    one = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(one("x"), "x").join(one("y"), "y").select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(run, "x long, y long, d long")


def _verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, at_least: tuple[int, int], k: int) -> DataFrame:
    """The pairs whose shingle sets, from their whole texts, reach the threshold."""
    a, b = at_least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, PART):
                xy, sets = [], []
                for c in (0, 1):
                    ids, first, at = np.unique(part.column(c).to_numpy(), return_index=True, return_inverse=True)
                    own = shingle_lists(part.column(c + 2).take(pa.array(first)), k)  # a text of several pairs once
                    xy.append(ids[at])
                    sets.append([own[i] for i in at.tolist()])
                on = []
                for i, (p, q) in enumerate(zip(*sets, strict=True)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if b * both >= a * (len(p) + len(q) - both):
                        on.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in xy], names=["x", "y"])

    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    texts = written(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).join(ids, "id").dropDuplicates(["id"]), "texts", compression="zstd")
    both = pairs.select("x", "y").join(texts.select(F.col("id").alias("x"), F.col("t").alias("tx")), "x").join(texts.select(F.col("id").alias("y"), F.col("t").alias("ty")), "y")
    good = written(both.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long"), "links")
    discard(texts)
    return good


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (id) with comp, the smallest id reachable over links (x, y).

    Each round a node takes the least component among its neighbours', then that of the node its component names.
    """
    both = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = written(nodes.select("id", F.col("id").alias("comp")), "labels")
    while True:
        of = both.join(labels.select(F.col("id").alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("best"))
        moved = labels.join(of.withColumnRenamed("x", "id"), "id", "left").select("id", "comp", F.least("comp", "best").alias("new"))
        jump = moved.select(F.col("id").alias("new"), F.col("new").alias("up"))
        before, after = labels, written(moved.join(jump, "new", "left").select("id", F.least("new", "up").alias("next"), "comp"), "labels")
        discard(before)
        changed = after.where("next <> comp").limit(1).count()
        labels = after.select("id", F.col("next").alias("comp"))
        labels._work_path = after._work_path
        if not changed:
            discard(both)
            return labels


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", at_least: tuple[int, int] = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (smallest id of an equal set).

    Documents without words, and those with a null id, are linked with nothing and are their own component. Rows that
    share an id are one document, the longest text of them. Texts of any length are taken whole. Ids are integers: a text
    id that is no number raises. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sets = written(shingle_sets(docs, doc_id, text, at_least, words), "sets")
    if sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
        one = d.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(F.length("t").alias("n"), "t")).alias("x")).select("doc_id", F.col("x.t").alias("t"))
        whole = join(written(one.unionByName(d.where("doc_id is null")), "unshared"), "doc_id", "t", at_least, words)
        again = d.where("doc_id is not null").select("doc_id").join(whole, "doc_id")
        return again.unionByName(whole.where("doc_id is null"))
    real = sets.where("n > 0 and doc_id is not null")
    classes = real.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    reps = written(classes, "classes")
    hot = _hot(reps)
    prefixes = reps.select("rep", "n", "prefix")
    if len(hot):
        anew = _ordered_prefixes(docs, doc_id, text, at_least, words, hot).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), F.col("prefix").alias("p2"))
        prefixes = prefixes.join(anew, "rep", "left").select("rep", "n", F.coalesce("p2", "prefix").alias("prefix"))
    postings = prefixes.select("rep", "n", F.posexplode("prefix").alias("pos", "s"))
    # Sizes by a sum for each shingle and a join that can split a long list, not by a window that holds it.
    shared = postings.groupBy("s").agg(F.count("*").alias("size")).where("size > 1")
    lists = written(postings.join(shared, "s").select("s", "size", "n", F.col("pos").cast("long").alias("pos"), "rep"), "lists")
    nodes = reps.select(F.col("rep").alias("id"))
    done: list[DataFrame] = []  # verified pairs
    links: list[DataFrame] = []

    def all_of(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.select("x", "y") for t in tables])

    def verify(pairs: DataFrame) -> None:
        done.append(pairs)
        links.append(_verified(pairs, docs, doc_id, text, at_least, words))
        release(spark)

    def across(comp: DataFrame) -> DataFrame:
        """The lists that hold more than one component, with the components."""
        now = lists.drop("size").join(comp.withColumnRenamed("id", "rep"), "rep")
        sizes = now.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("s", "size")
        return now.join(sizes, "s")

    first = _near(_pairs(lists.withColumn("comp", F.col("rep")), at_least, MIDDLES), reps, at_least)
    either = first.select(F.col("x").alias("k"), "*").unionByName(first.select(F.col("y").alias("k"), "*"))
    verify(written(either.groupBy("k").agg(F.min(F.struct("d", "x", "y")).alias("p")).select("p.x", "p.y").distinct(), "pairs"))
    for by in (ANSWERS, ALL):
        comp = components(nodes, all_of(links))
        open_ = across(comp)
        few = _near(_pairs(open_.where(F.col("size") <= SHORT), at_least, by), reps, at_least).select("x", "y") if by == ALL else None
        many = _pairs(open_.where(F.col("size") > SHORT).join(reps.select("rep", "sketch"), "rep"), at_least, by)
        new = many if few is None else few.unionByName(many).distinct()
        verify(written(new.join(all_of(done), ["x", "y"], "left_anti"), "pairs"))
    if links[-1].limit(1).count():
        comp = components(nodes, all_of(links))

    # A large class is one row for each task after the first grouping, so its sig is looked up by broadcast.
    named = reps.select("sig", "rep").join(comp.withColumnRenamed("id", "rep"), "rep")
    sizes = real.groupBy("sig").count()
    most = max(1000, real.count() // 1000)
    hot_sigs = sizes.where(F.col("count") > most).select("sig").join(named, "sig")
    cold = named.join(hot_sigs.select("sig"), "sig", "left_anti")
    begun = real.select("doc_id", "n", "sig").join(F.broadcast(hot_sigs), "sig", "left")
    found = begun.where("comp is not null").unionByName(begun.where("comp is null").select("doc_id", "n", "sig").join(cold, "sig"))
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("rep"), F.col("doc_id").alias("comp"))
    out = found.select("doc_id", "n", "rep", "comp").unionByName(alone)
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("rep").alias("class_id")), "components")
    discard(sets, reps, lists, *done, *links)
    release(spark)
    return out


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", at_least: tuple[int, int] = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The rows of docs, all columns as they are, without those of a component whose smallest id is another's."""
    (gone,) = free(docs, "gone")
    ids = join(docs, doc_id, text, at_least, words).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col(doc_id) == F.col(gone), "left_anti")
