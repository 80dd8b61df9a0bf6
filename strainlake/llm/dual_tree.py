"""Lloyd's rounds over two trees: cover trees over blocks of vectors, and a tree over the centroids, made anew each round.

Vectors are dealt into blocks of at most BLOCK rows where they lie; each block's cover tree is built once, with the sum
and count of the vectors below every node, and written as one row. A round walks each block's tree level by level
against the tree of the centroids: a pair of nodes is dropped when the nearest that any centroid below one can come to
any vector below the other is farther than what another centroid reaches at worst. A node left with a single centroid
gives its sum and count at once; the vectors of leaves are compared exactly with the centroids that are left. A task
returns one row for each centroid and component, so a round brings k x (components + 1) numbers to the driver.

Components are integers and all sums exact, so the result does not depend on blocks or partitions. Bounds are taken with
a margin over the error of their square roots, so that no tie is decided by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strainlake.llm.common import discard, written

#: Vectors in a block at most, and below a leaf of its tree.
BLOCK, LEAF = 2048, 24
#: A level's covering radius as a share of the one above it.
SHRINK = 0.75
#: Largest absolute component: squared distances of 64 of them stay below 2^63.
LARGEST = 1 << 27
TREE = "vec_ids binary, null_ids binary, vectors binary, first binary, last binary, pivot binary, radius binary, child binary, n_child binary, sums binary, n int, dims int"


def cover_tree(v: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows of v, and the nodes over it in breadth-first order, children of a node side by side.

    Node: rows first to last - 1 of the order, a pivot among them, the largest distance from it, and its children (none
    for a leaf). The children's pivots lie farther from each other than the covering radius of their level, and every
    row belongs to a child whose pivot covers it.
    """
    n, x = len(v), v.astype(float)
    order = np.arange(n)
    norm = (x * x).sum(1)
    nodes = {k: [] for k in ("first", "last", "pivot", "radius", "child", "n_child")}

    def add(first: int, last: int, pivot: int, far: np.ndarray) -> None:
        for k, value in zip(nodes, (first, last, pivot, float(far.max(initial=0.0)), 0, 0), strict=True):
            nodes[k].append(value)

    def away(rows: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(np.maximum(0, norm[rows] + norm[pivot] - 2 * (x[rows] @ x[pivot])))

    add(0, n, 0, away(order, 0))
    scale = [nodes["radius"][0]]
    at = 0
    while at < len(scale):
        first, last, radius = nodes["first"][at], nodes["last"][at], nodes["radius"][at]
        if last - first > LEAF and radius > 0:
            cover = SHRINK * min(scale[at], radius)
            rest = order[first:last].copy()
            d = away(rest, nodes["pivot"][at])
            pivot, begin = nodes["pivot"][at], first
            nodes["child"][at] = len(scale)
            while len(rest):
                near = d <= cover
                near[rest == pivot] = True
                mine = rest[near]
                order[begin : begin + len(mine)] = mine
                add(begin, begin + len(mine), pivot, d[near])
                scale.append(cover)
                begin, rest = begin + len(mine), rest[~near]
                if len(rest):
                    pivot = rest[0]
                    d = away(rest, pivot)
            nodes["n_child"][at] = len(scale) - nodes["child"][at]
        at += 1
    kinds = {"radius": float}
    return order, {k: np.array(x, kinds.get(k, np.int32)) for k, x in nodes.items()}


class CentroidTree:
    """A tree over the centroids: halves along the component of widest spread, each node with its mean and radius."""

    def __init__(self, c: np.ndarray):
        self.c, self.low, self.high, self.mid, self.radius = c.astype(float), [], [], [], []
        self.order = np.arange(len(c))
        self.kids: list[tuple[int, int]] = []
        self._node(0, len(c))
        self.mid, self.radius, self.kids = np.array(self.mid), np.array(self.radius), np.array(self.kids)
        self.leaf = np.array([self.order[a] if b - a == 1 else -1 for a, b in zip(self.low, self.high, strict=True)])

    def _node(self, a: int, b: int) -> int:
        me, rows = len(self.low), self.c[self.order[a:b]]
        mid = rows.mean(0)
        self.low.append(a)
        self.high.append(b)
        self.mid.append(mid)
        self.radius.append(float(np.sqrt(((rows - mid) ** 2).sum(1)).max()))
        self.kids.append((-1, -1))
        if b - a > 1:
            axis = np.ptp(rows, axis=0).argmax()
            self.order[a:b] = self.order[a:b][np.argsort(rows[:, axis], kind="stable")]
            half = (a + b) // 2
            self.kids[me] = (self._node(a, half), self._node(half, b))
        return me


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of each run, end to end."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _compared(tree: dict[str, np.ndarray], v: np.ndarray, c: np.ndarray, q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the leaves q and the nearest of the centroids k that are left for each (pairs sorted by q, then k), exactly."""
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    left, leaf = np.diff(np.r_[first, len(q)]), q[first]
    size = tree["last"][leaf] - tree["first"][leaf]
    row = _runs(tree["first"][leaf], size)
    left = np.repeat(left, size)  # centroids for each row
    pair = _runs(np.repeat(first, size), left)
    gap = v[np.repeat(row, left)] - c[k[pair]]
    d = np.einsum("ij,ij->i", gap, gap)
    begin = np.cumsum(left) - left
    is_least = d == np.repeat(np.minimum.reduceat(d, begin), left)
    return row, np.minimum.reduceat(np.where(is_least, k[pair], len(c)), begin)


def owners(tree: dict[str, np.ndarray], v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nearest centroid of all rows of v (in tree order), the smaller number of equally near ones.

    Returns nodes owned as a whole and their owners, then rows of compared leaves and theirs.
    """
    cents = CentroidTree(c)
    x, pivots, radius = cents.mid, v[tree["pivot"]].astype(float), tree["radius"]
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of a vector node and a centroid node, sorted
    found = [[], [], [], []]
    while len(q):
        d = np.sqrt(((pivots[q] - x[r]) ** 2).sum(1))
        slack = 1e-6 + 1e-9 * (d + radius[q] + cents.radius[r])
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        reach = np.minimum.reduceat(d + radius[q] + cents.radius[r] + slack, first)
        keep = d - radius[q] - cents.radius[r] - slack <= np.repeat(reach, np.diff(np.r_[first, len(q)]))
        q, r = q[keep], r[keep]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        size = np.diff(np.r_[first, len(q)])
        inner = cents.leaf[r] < 0
        settled = np.repeat(~np.logical_or.reduceat(inner, first), size)  # single centroids alone are left
        single = settled & np.repeat(size == 1, size)
        exact = settled & ~single & (tree["n_child"][q] == 0)
        found[0].append(q[single])
        found[1].append(cents.leaf[r[single]])
        if exact.any():
            node, k = q[exact], cents.leaf[r[exact]]
            order = np.lexsort((k, node))
            for out, part in zip(found[2:], _compared(tree, v, c, node[order], k[order]), strict=True):
                out.append(part)
        # Centroid nodes that can be split are; else vector nodes give way to their children.
        split, down = inner, settled & ~single & ~exact
        stay = ~inner & ~settled
        n_kids = tree["n_child"][q[down]]
        q, r = (
            np.concatenate([np.repeat(q[split], 2), q[stay], _runs(tree["child"][q[down]], n_kids)]),
            np.concatenate([cents.kids[r[split]].ravel(), r[stay], np.repeat(r[down], n_kids)]),
        )
        order = np.lexsort((r, q))
        q, r = q[order], r[order]
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in found)


def _pack(tree: dict[str, np.ndarray], v: np.ndarray) -> bytes:
    upto = np.concatenate([np.zeros((1, v.shape[1]), np.int64), np.cumsum(v, 0, dtype=np.int64)])
    return (upto[tree["last"]] - upto[tree["first"]]).astype("<i8").tobytes()


def quantised(vectors: DataFrame, dims: int, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and q (array of long), floor(scale * x), of the rows whose vector has dims finite components and no null."""
    e = F.col(embedding)
    fine = (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    q = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(e.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("q"))


def trees(q: DataFrame, dims: int) -> DataFrame:
    """Blocks of rows (vec_id, q) with their cover trees, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def block(ids, v):
            if np.abs(v).max(initial=0) > LARGEST:
                raise ValueError(f"a scaled component exceeds {LARGEST}: squared distances would not fit into a long")
            v = v.astype(np.int32)
            order, t = cover_tree(v)
            v = v[order]
            ids = ids.take(pa.array(order))
            null = np.asarray(ids.is_null())
            raw = [ids.fill_null(0).to_numpy().astype("<i8").tobytes(), null.tobytes(), v.astype("<i4").tobytes()]
            at = np.argsort(order)
            raw += [t["first"].tobytes(), t["last"].tobytes(), at[t["pivot"]].astype(np.int32).tobytes(), t["radius"].tobytes(), t["child"].tobytes(), t["n_child"].tobytes(), _pack(t, v)]
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in raw], pa.array([len(v)], pa.int32()), pa.array([dims], pa.int32())], names=[f.split()[0] for f in TREE.split(", ")])

        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.slice(i, BLOCK)
                ids.append(part.column(0))
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64))
                held += len(part)
                if held >= BLOCK:
                    a, v = pa.concat_arrays(ids), np.concatenate(rows)
                    yield block(a.slice(0, BLOCK), v[:BLOCK])
                    ids, rows, held = [a.slice(BLOCK)], [v[BLOCK:]], held - BLOCK
        if held:
            yield block(pa.concat_arrays(ids), np.concatenate(rows))

    return q.mapInArrow(run, TREE)


def _unpack(row: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
    get = lambda k, kind: np.frombuffer(row[k], kind)
    t = {k: get(k, np.int32) for k in ("first", "last", "pivot", "child", "n_child")}
    t["radius"] = get("radius", float)
    return t, get("vectors", "<i4").reshape(row["n"], row["dims"]).astype(np.int64)


def _means(blocks: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of the vectors nearest to each."""
    k, dims = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                t, v = _unpack(row)
                sums = np.frombuffer(row["sums"], "<i8").reshape(-1, dims)
                node, whose, at, own = owners(t, v, c)
                n = t["last"][node] - t["first"][node]
                for i in range(k):
                    total[i, :dims] += sums[node[whose == i]].sum(0) + v[at[own == i]].sum(0)
                    total[i, dims] += n[whose == i].sum() + (own == i).sum()
        some = np.argwhere(total != 0)
        yield pa.RecordBatch.from_arrays([pa.array(some[:, 0], pa.int32()), pa.array(some[:, 1], pa.int32()), pa.array(total[tuple(some.T)])], names=["k", "i", "s"])

    total = np.zeros((k, dims + 1), object)
    for r in blocks.mapInArrow(run, "k int, i int, s long").groupBy("k", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        total[r["k"], r["i"]] = int(r["s"])
    out = c.copy()
    for j in range(k):
        if total[j, dims]:
            out[j] = [int(s) // int(total[j, dims]) for s in total[j, :dims]]
    return out


def _assigned(blocks: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    names = ["vec_id", "cluster", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t, v = _unpack(row)
                own = np.zeros(len(v), np.int64)
                node, whose, at, mine = owners(t, v, c)
                n = t["last"][node] - t["first"][node]
                own[_runs(t["first"][node], n)] = np.repeat(whose, n)
                own[at] = mine
                distance = ((v - c[own]) ** 2).sum(1)
                ids = pa.array(np.frombuffer(row["vec_ids"], "<i8"), mask=np.frombuffer(row["null_ids"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(distance)], names=names)

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia and centroid_sha256 of every vector.

    Vectors become integers floor(scale * x); rows with null vectors, other lengths, null or non-finite components are
    left out. The k with the smallest SHA-256 of "seed:vec_id" start as centroids, fewer where there are fewer vectors;
    of equal ids the smaller vector comes first. A centroid without vectors stays. Ties go to the smaller number. A null
    vec_id counts as the empty string there and comes out as null; repeated rows are rows like others; columns of any
    other name are ignored; an empty table gives an empty one. Components beyond 2^27 once scaled raise.

    The driver holds k centroids; nothing else is broadcast.
    """
    q = quantised(vectors, dims, scale, vec_id, embedding)
    spark = vectors.sparkSession
    seeds = q.select("q", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h")).orderBy("h", "q").limit(k).collect()
    c = np.array([r["q"] for r in seeds], np.int64).reshape(-1, dims)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(c):
        return spark.createDataFrame([], out)
    if np.abs(c).max() > LARGEST:
        raise ValueError(f"a scaled component exceeds {LARGEST}: squared distances would not fit into a long")
    blocks = written(trees(q, dims), "cover-trees")
    for _ in range(rounds):
        c = _means(blocks, c)
    rows = written(_assigned(blocks, c), "clusters")
    discard(blocks)
    own = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    per = spark.createDataFrame([(i, own.get(i, 0), sum(own.values()), sha[i]) for i in range(len(c))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
