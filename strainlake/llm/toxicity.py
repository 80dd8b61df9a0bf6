"""Toxic passages: all maximal-scoring segments of token log-odds, judged by extreme-value statistics.

Log-odds of tokens between toxic and clean labelled texts are shrunk by an informative Dirichlet prior (the pooled
counts), and count as far as their interval lies off zero, on either side: clean-leaning tokens cost a segment more
than neutral ones. A linear-time scan finds every maximal segment; a segment's score S in a text of n tokens is
normalised to lambda S - ln(K n), with lambda from the clean token distribution and K from the best segments of clean
texts. A document's normalised scores are summed and mapped to a probability by a logistic fit on the labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strainlake.llm.common import WS_RUN, discard, slices, texts_of, written

#: Bound of the fit: labelled rows (those of smallest hash). Terms are those of these rows, all of them.
MAX_LABELLED = 20_000
#: The prior weighs as much as this share of the labelled tokens; half width of the interval in standard errors; what
#: every token costs, so that a neutral one does.
PRIOR_SHARE = 0.1
WIDTH = 1.96
DRIFT = 0.5
#: Scores of clean tokens are counted in steps of this size.
STEP = 1 / 256
#: Chance that a clean text has a segment as good as one that is called significant.
SIGNIFICANCE = 0.01

#: Besides the word, its beginnings of these lengths are terms: inflected and compound forms share them.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words whose score a Python worker keeps.
KEPT_WORDS = 300_000

_STRIP = ".,;:!?\"'()[]{}*_-#$%&|<>«»“”„¡¿"


def tokens(text: str) -> list[str]:
    return [x.strip(_STRIP) for x in text.lower().split()]


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior_share: float = PRIOR_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and z of each term from its counts in both classes, with a Dirichlet prior in proportion to both."""
    nt, nc = toxic.sum(), clean.sum()
    prior = prior_share * (toxic + clean)
    a0 = prior.sum()
    delta = np.log((toxic + prior) / (nt + a0 - toxic - prior)) - np.log((clean + prior) / (nc + a0 - clean - prior))
    return delta, delta / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def shrunk(delta: np.ndarray, z: np.ndarray, width: float = WIDTH) -> np.ndarray:
    """The end of the interval of the log-odds that is nearer to zero; zero if it holds zero."""
    return delta * np.maximum(0.0, 1 - width / np.maximum(np.abs(z), 1e-12))


def segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) of a text whose token at[i] scores score[i], the others -drift.

    Ruzzo and Tompa's scan in time linear in the scored tokens: each candidate keeps the totals left of it and at its
    right end; a new one is merged back as long as that makes it better. Tokens of no positive score begin none.
    """
    out: list[list] = []  # begin, end, left total, right total
    total, before = 0.0, 0
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (i - before)
        before = i + 1
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(a, b, r - x) for a, b, x, r in out]


def decay(scores: np.ndarray, share: np.ndarray, drift: float = DRIFT) -> float:
    """The positive root of sum share e^(lambda score) = 1, where all other tokens score -drift."""
    rest = max(1e-9, 1 - float(share.sum()))
    f = lambda x: float((share * np.exp(np.minimum(700, x * scores))).sum()) + rest * math.exp(-x * drift) - 1
    lo, hi = 1e-6, 1e-6
    while f(hi) < 0 and hi < 1e3:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


@dataclass
class Model:
    terms: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.words: dict[str, float | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"words": {}}

    def word_score(self, word: str) -> float | None:
        """The best score of a word's terms, less what every token costs; None for a neutral word."""
        got = [s for t in terms_of(word) if (s := self.terms.get(t)) is not None] if word else []
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        best = self.words[word] = max(got) - DRIFT if got else None
        return best

    def hits(self, text: str) -> tuple[list[int], list[float], int]:
        """Positions and scores of the scoring tokens, and the number of tokens."""
        words = tokens(text)
        known, at, score = self.words, [], []
        for i, w in enumerate(words):
            s = known[w] if w in known else self.word_score(w)
            if s is not None:
                at.append(i)
                score.append(s)
        return at, score, len(words)

    def found(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Segments and the number of tokens."""
        at, score, n = self.hits(text)
        return segments(np.asarray(at), np.asarray(score)) if at else [], n

    def normalised(self, n: int, scores: list[float]) -> float:
        """log(1 + sum) of the positive normalised scores of a text of n tokens; without one the best / 20, -1 at least."""
        s = [self.lam * x - math.log(self.k * max(1, n)) for x in scores]
        good = [x for x in s if x > 0]
        return math.log1p(sum(good)) if good else max(-20.0, max(s, default=-20.0)) / 20

    def statistic(self, text: str) -> float:
        segs, n = self.found(text)
        return self.normalised(n, [x for _, _, x in segs])

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.statistic(text) + self.shift))))

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """(first token, end, chance that a clean text has such a segment) of each significant segment."""
        segs, n = self.found(text)
        p = [(a, b, -math.expm1(-self.k * max(1, n) * math.exp(-self.lam * s))) for a, b, s in segs]
        return [x for x in p if x[2] <= SIGNIFICANCE]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift by Newton's method."""
    w = np.zeros(2)
    f = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + ridge * np.eye(2), f.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    own = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~F.coalesce(held_out(F.col(doc_id)), F.lit(True)))
    own = own.groupBy(F.col(doc_id).alias("i")).agg(F.max(F.col(label).cast("int")).alias("y"))
    some = own.orderBy(F.xxhash64("i"), "i").limit(most)  # at most `most` rows are broadcast
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(some), "i")
    # Copies count once.
    rows = rows.withColumn("h", F.md5(F.regexp_replace(F.coalesce("t", F.lit("")), WS_RUN, ""))).groupBy("h").agg(F.max(F.struct("y", "t")).alias("x"))
    return rows.select("x.y", "x.t")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> Model:
    """Learns from labelled rows that are not held out, at most `most` of them. Without both classes no term scores.

    Null texts, labels and ids, texts of any length and repeated rows are as in score(); a row's label is the largest.
    The driver gets the terms that score and one short row per labelled text.
    """
    rows = written(_labelled(docs, labels, doc_id, text, label, most), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A term counts once for each text: repeats within one say little about others.
            both = Counter(), Counter()
            for y, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                both[y == 1].update({x for w in set(tokens(t)) for x in terms_of(w)})
            terms = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([both[1][x] for x in terms], pa.int64()), pa.array([both[0][x] for x in terms], pa.int64())], names=["term", "toxic", "clean"])

    counts = rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts, "terms")
    own = ~F.col("term").endswith("*")
    nt, nc = (float(x or 0) for x in counts.where(own).agg(F.sum("toxic"), F.sum("clean")).first())
    # The same as shrunk(log_odds()), as columns, so that only scoring terms reach the driver.
    t, c = F.col("toxic"), F.col("clean")
    prior = PRIOR_SHARE * (t + c)
    a0 = PRIOR_SHARE * (nt + nc)
    delta = F.log((t + prior) / (nt + a0 - t - prior)) - F.log((c + prior) / (nc + a0 - c - prior))
    z = F.abs(delta) / F.sqrt(1 / (t + prior) + 1 / (c + prior))
    scored = counts.where((F.col("term") != "") & F.lit(nt > 0 and nc > 0)).select("term", delta.alias("d"), z.alias("z")).where(F.col("z") > WIDTH)
    model = Model({r["term"]: r["s"] for r in scored.select("term", (F.col("d") * (1 - WIDTH / F.col("z"))).alias("s")).collect()})
    if not any(x > DRIFT for x in model.terms.values()):
        model.shift = -5.0
        discard(rows, counts)
        return model

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often a clean text's tokens have each score (null: neutral)."""
        seen: Counter = Counter()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                if y != 1:
                    at, score, n = model.hits(t)
                    seen.update(round(s / STEP) for s in score)
                    seen[None] += n - len(at)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["bin", "c"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.found(t) for t in texts_of(batch.column(1))]
            tops = [max((x for _, _, x in segs), default=0.0) for segs, _ in found]
            values = [model.normalised(n, [x for _, _, x in segs]) for segs, n in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array(tops, pa.float64()), pa.array(values, pa.float64())], names=["y", "n", "top", "x"])

    of = rows.mapInArrow(spread, "bin long, c long").groupBy("bin").agg(F.sum("c").alias("c")).collect()  # a row for each step of the score
    hits = [r for r in of if r["bin"] is not None]
    at = np.asarray([r["bin"] * STEP for r in hits] + [max(model.terms.values()) - DRIFT])
    model.lam = decay(at, np.asarray([r["c"] for r in hits] + [1]) / max(2.0, sum(r["c"] for r in of) + 1))
    clean = [r for r in rows.mapInArrow(best, "y int, n long, top double, x double").collect() if r["y"] != 1]  # at most `most` rows
    # Maximum likelihood of the Gumbel law of clean maxima, given lambda.
    model.k = max(1e-12, len(clean) / max(1e-9, sum(max(1, r["n"]) * math.exp(-model.lam * r["top"]) for r in clean)))
    seen = rows.mapInArrow(best, "y int, n long, top double, x double").collect()  # now normalised by lambda and K
    model.slope, model.shift = logistic(np.asarray([r["x"] for r in seen]), np.asarray([float(r["y"] == 1) for r in seen]))
    discard(rows, counts)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each document.

    A null or empty text has no segment and gets the score of that; repeated rows are scored each for itself; a null
    id counts as not held out; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                s = [model.score(t) for t in texts_of(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.7) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), F.col(text).alias("t"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model, text: str = "text", most: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, that score below most."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([model.score(t) < most for t in texts_of(part.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def passages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per significant passage: doc_id, first token, end token, its chance in a clean text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *p) for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True) for p in model.passages(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "begin", "end", "chance"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, begin long, end long, chance double")
