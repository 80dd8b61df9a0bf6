"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Pass 1 counts the characters of all texts and which follow which. Pass 2 finds the base patterns and, in what they
leave, all runs of token characters, whole and parted at their separators (name=value, paths); a part's encoding is
inferred. Two claims are tested of each: that it is no ordinary text, by the likelihood ratio of ordinary text (the
counted characters) to uniform chance, whose inverse bounds by Markov's inequality how often ordinary text looks so; and
that it is no ordinary pattern, by the battery: the deviates of chi-squared uniformity over the alphabet, of the runs
test and of the serial correlation are summed in squares, and that sum is compared with the sums that ordinary text of
that alphabet and length gives (drawn from the counts, log-normal). A secret has to pass both, so its p-value is the
larger one. Of overlapping parts the strongest stays. The Benjamini-Hochberg rule is then applied in each length class
over all runs of the whole table; parts that cannot pass it (first p-value over the rate) are counted only.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strainlake.llm.common import raw_of, slices, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: Shortest run that is tested (no shorter one could pass), bounds of the length classes, share of false discoveries.
MIN_LENGTH = 8
CLASSES = (8, 12, 16, 20, 24, 32, 48, 64, 128)
FDR = 0.01
#: Texts drawn for each alphabet and length class.
DRAWN = 2000

#: Alphabets in the order they are tried: the first that holds all characters of a run is its encoding.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "BASE36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Ways to part a piece: which of the four separators count as a key's own characters. Padding stays at the end.
_LAYERS = [re.compile(rf"[A-Za-z0-9{x}]+(?:=+\Z)?") for x in ("+/_-", "+/", "_-", "")]
_RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = np.zeros(256, bool)
_RUN[list(_RUN_BYTES)] = True
#: Kinds of characters, a bit each; which kinds an alphabet holds decides whether it holds all characters of a run.
_KINDS = (b"01", b"234567", b"89", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"+/", b"-_", b"=")
_KIND = np.zeros(256, np.uint16)
for _i, _chars in enumerate(_KINDS):
    _KIND[list(_chars)] = 1 << _i
_NAMES = list(ALPHABETS)
_HELD = [int(np.bitwise_or.reduce(_KIND[list(v.encode())])) for v in ALPHABETS.values()]
#: Kinds -> number of the first alphabet that holds them, -1 if none does. Padding counts as separator.
_ENCODING = np.asarray([next((i for i, h in enumerate(_HELD) if kinds and not kinds & ~h), -1) for kinds in range(1 << len(_KINDS))])
_SEPARATORS = int(np.bitwise_or.reduce(_KIND[list(b"+/-_=")]))
_INDEX = []
for _v in ALPHABETS.values():
    _x = np.full(256, -1, np.int64)
    _x[list(_v.encode())] = np.arange(len(_v))
    _INDEX.append(_x)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def encoding(run: str) -> str | None:
    """The first alphabet that holds all characters of a run, padding aside."""
    raw = run.rstrip("=").encode()
    i = int(_ENCODING[np.bitwise_or.reduce(_KIND[list(raw)])]) if raw else -1
    return _NAMES[i] if i >= 0 else None


def deviates(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Standard normal deviates, under chance, of chi-squared uniformity, runs and serial correlation.

    x: one sequence a row, of numbers below k.
    """
    rows, n = x.shape
    seen = np.bincount((np.arange(rows)[:, None] * k + x).ravel(), minlength=rows * k).reshape(rows, k)
    chi = ((seen - n / k) ** 2).sum(1) * k / n
    z_chi = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * max(1, n - 1) / n)
    high = x >= k // 2
    a = high.sum(1).astype(float)
    b = n - a
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * max(1, n - 1))
    z_runs = np.where(var > 0, (runs - mean) / np.sqrt(np.where(var > 0, var, 1)), math.sqrt(2 * n * math.log(2)))
    d = x - x.mean(1, keepdims=True)
    ss = (d * d).sum(1)
    z_serial = np.where(ss > 0, ((d[:, 1:] * d[:, :-1]).sum(1) / np.where(ss > 0, ss, 1) + 1 / n) * math.sqrt(n), float(n))
    return z_chi, z_runs, z_serial


def battery(x: np.ndarray, k: int) -> np.ndarray:
    """The log of the sum of the squared deviates of each row: about that of chi-squared with 3 degrees under chance."""
    return np.log(1e-3 + sum(z * z for z in deviates(x, k)))


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def length_class(n: int) -> int:
    return bisect.bisect_right(CLASSES, n) - 1


_LOG_CLASSES = np.log(CLASSES)


class Ordinary:
    """What ordinary text looks like: shares of characters, and for each alphabet and length class the battery's law."""

    def __init__(self, counts: np.ndarray, follows: np.ndarray, fdr: float = FDR, seed: int = 11):
        """counts: of bytes; follows: of pairs of neighbouring bytes (256 x 256). One is added to each count."""
        self.least = -math.log10(fdr)  # what lies below passes no Benjamini-Hochberg rule at that rate
        c = np.where(_RUN, counts + 1.0, 1.0)
        self.logs = np.log(c / c[_RUN].sum())
        rng = np.random.default_rng(seed)
        self.law: list[list[tuple[float, float]]] = []
        self.own: list[float] = []
        for alphabet in ALPHABETS.values():
            at = list(alphabet.encode())
            k = len(at)
            self.own.append(math.log(np.exp(self.logs[at]).sum()))
            step = np.cumsum(follows[np.ix_(at, at)] + c[at] / c[at].sum(), 1)  # a character that is followed by none goes by the shares
            step /= step[:, -1:]
            first = np.cumsum(c[at]) / c[at].sum()
            x = np.zeros((DRAWN, CLASSES[-1]), np.int64)
            x[:, 0] = np.minimum(k - 1, np.searchsorted(first, rng.random(DRAWN)))
            for i in range(1, CLASSES[-1]):
                x[:, i] = np.minimum(k - 1, (step[x[:, i - 1]] < rng.random(DRAWN)[:, None]).sum(1))
            self.law.append([(float(t.mean()), max(0.05, float(t.std()))) for t in (battery(x[:, :n], k) for n in CLASSES)])

    def unlike_text(self, run: bytes, i: int) -> float:
        """-log10 of the bound on the chance that ordinary text of alphabet i looks so evenly drawn as run."""
        total = float(self.logs[np.frombuffer(run, np.uint8)].sum()) - len(run) * self.own[i]
        return max(0.0, -(total + len(run) * math.log(len(ALPHABETS[_NAMES[i]]))) / math.log(10))

    def unlike_pattern(self, run: bytes, i: int) -> float:
        """-log10 of the chance that ordinary text of alphabet i and that length does so well in the battery."""
        at = np.log(len(run))
        mean, sd = (float(np.interp(at, _LOG_CLASSES, [law[j] for law in self.law[i]])) for j in (0, 1))
        x = _INDEX[i][np.frombuffer(run, np.uint8)]
        p = _normal((float(battery(x[None], len(ALPHABETS[_NAMES[i]]))[0]) - mean) / sd)
        return -math.log10(max(p, 1e-300))


def best_parts(piece: str, ordinary: Ordinary) -> list[tuple[int, int, float]]:
    """(start, end, -log10 p) of the parts of a piece with separators; of overlapping ones the strongest.

    Inner '=' always separate; '+', '/', '-' and '_' are tried as characters of a key and as separators.
    """
    tested: dict[tuple[int, int], tuple[bytes, int]] = {}
    ways = 0
    for layer in _LAYERS:
        before = len(tested)
        for m in layer.finditer(piece):
            run = m[0].rstrip("=").encode()
            if len(run) >= MIN_LENGTH and (i := int(_ENCODING[np.bitwise_or.reduce(_KIND[list(run)])])) >= 0:
                tested[m.span()] = run, i
        ways += len(tested) > before

    def strength(span: tuple[int, int]) -> float:
        """Of a part's letters and digits alone: a separator at its edge neither adds nor takes."""
        own = tested[span][0].translate(None, b"+/_-")
        return ordinary.unlike_text(own, int(_ENCODING[np.bitwise_or.reduce(_KIND[list(own)])])) if own else 0.0

    order = sorted(tested, key=lambda x: (-strength(x), x[1] - x[0], x[0])) if len(tested) > 1 else list(tested)
    kept: list[tuple[int, int]] = []
    for i, j in order:
        at = bisect.bisect(kept, (i, j))
        if (at == 0 or kept[at - 1][1] <= i) and (at == len(kept) or kept[at][0] >= j):
            kept.insert(at, (i, j))
    # A character stood in up to so many tested parts, which the bound on the chance has to carry.
    out = []
    for span in kept:
        run, e = tested[span]
        q = ordinary.unlike_text(run, e) - math.log10(ways)
        out.append((*span, min(q, ordinary.unlike_pattern(run, e)) if q >= ordinary.least else 0.0))
    return out


def candidates(raw: bytes, text: str, ordinary: Ordinary, taken: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, float]], np.ndarray]:
    """(start, end, length class, -log10 p) of the parts outside the base spans that could pass, and the number tested in each class."""
    b = np.frombuffer(raw, np.uint8)
    points = np.flatnonzero((b & 0xC0) != 0x80) if taken or len(text) < len(raw) else None
    on = np.concatenate([[False], _RUN[b], [False]])
    for x, _, y in taken:
        on[int(points[x]) + 1 : (int(points[y]) if y < len(points) else len(b)) + 1] = False
    edge = np.flatnonzero(on[1:] != on[:-1])
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= MIN_LENGTH
    begin, end = begin[long], end[long]
    tested = np.zeros(len(CLASSES), np.int64)
    if not len(begin):
        return [], tested
    both = np.stack([begin, end], 1).ravel()
    both = both[:-1] if both[-1] == len(b) else both
    kinds = np.bitwise_or.reduceat(_KIND[b], both)[::2].astype(np.int64)
    total = np.add.reduceat(ordinary.logs[b], both)[::2]
    n = end - begin
    plain = kinds & _SEPARATORS == 0
    code = _ENCODING[kinds]
    own, size = np.asarray(ordinary.own)[code], np.asarray([len(v) for v in ALPHABETS.values()])[code]
    q = -(total - n * own + n * np.log(size)) / math.log(10)
    tested += np.bincount(np.searchsorted(CLASSES, n[plain], side="right") - 1, minlength=len(CLASSES))
    out = []
    for r in np.flatnonzero(~plain | (q >= ordinary.least)).tolist():
        i, j = int(begin[r]), int(end[r])
        start = i if points is None else int(np.searchsorted(points, i))
        if plain[r]:
            found = [(0, j - i, min(float(q[r]), ordinary.unlike_pattern(raw[i:j], int(code[r]))))]
        else:
            found = best_parts(raw[i:j].decode(), ordinary)
            for x, y, _ in found:
                tested[length_class(y - x)] += 1
        out += [(start + x, start + y, length_class(y - x), p) for x, y, p in found if p >= ordinary.least]
    return out, tested


def thresholds(histogram: dict[tuple[int, int], int], tested: dict[int, int], fdr: float = FDR) -> dict[int, int]:
    """Length class -> least bin (of tenths of -log10 p) that the Benjamini-Hochberg rule accepts, among all tested."""
    out = {}
    for c in {c for c, _ in histogram}:
        bins = {b: n for (k, b), n in histogram.items() if k == c}
        within = 0
        for b in sorted(bins, reverse=True):
            within += bins[b]
            if tested[c] * 10 ** (-b / 10) <= fdr * within:
                out[c] = b
    return out


def ordinary_text(docs: DataFrame, text: str = "text", fdr: float = FDR) -> Ordinary:
    """From the characters of all texts: 256 counts and those of pairs of token characters reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256 + 65536, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                b = np.frombuffer(b" ".join(raw_of(part.column(0))), np.uint8)
                total[:256] += np.bincount(b, minlength=256)
                pair = _RUN[b[:-1]] & _RUN[b[1:]] if len(b) else np.zeros(0, bool)
                total[256:] += np.bincount(b[:-1][pair].astype(np.int64) * 256 + b[1:][pair], minlength=65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["b", "n"])

    total = np.zeros(256 + 65536)
    for r in docs.select(F.col(text)).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        total[r["b"]] = r["n"]
    return Ordinary(total[:256], total[256:].reshape(256, 256), fdr)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base array<int>, start array<int>, end array<int>, class array<int>, bin array<int>, tested array<int>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text is empty; repeated rows are scanned each for itself and a null id stays null; other columns are
    ignored; an empty table gives no rows. Positions are code points, ends are exclusive.
    """
    ordinary = ordinary_text(docs, text, fdr)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 6
        names = [x.split()[0] for x in _FOUND.split(", ")]
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), raw_of(part.column(1)), strict=True):
                    t = raw.decode()
                    base = base_spans(t)
                    more, tested = candidates(raw, t, ordinary, base)
                    kinds = [k for _, k, _ in base]
                    rows.append((doc, *map(kinds.count, range(3)), [x for s in base for x in s], [x[0] for x in more], [x[1] for x in more], [x[2] for x in more], [min(3000, int(10 * x[3])) for x in more], tested.tolist() if tested.any() else []))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    found = written(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(find, _FOUND), "secrets")
    # At most one row for each class and bin, however many candidates there are.
    bins = found.select(F.explode(F.arrays_zip("class", "bin")).alias("x")).groupBy("x.class", "x.bin").count().collect()
    sums = found.agg(*[F.sum(F.get("tested", F.lit(i))).alias(str(i)) for i in range(len(CLASSES))]).first()
    least = thresholds({(r["class"], r["bin"]): r["count"] for r in bins}, {i: sums[i] or 0 for i in range(len(CLASSES))}, fdr)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, a, b, c, q = (batch.column(i).to_pylist() for i in range(4, 9))
            sha, spans = [], []
            for own, *more in zip(base, a, b, c, q, strict=True):
                s = [tuple(own[i : i + 3]) for i in range(0, len(own), 3)]
                sha.append(hashlib.sha256(joined(s).encode()).hexdigest())
                spans.append(joined(s + [(x, 3, y) for x, y, k, n in zip(*more, strict=True) if n >= least.get(k, 1 << 30)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(tell, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
