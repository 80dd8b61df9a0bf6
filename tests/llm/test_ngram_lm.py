"""Language-model scores against a plain dictionary model."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strainlake.llm import ngram_lm


def test_elias_fano():
    rng = np.random.default_rng(3)
    for high in (10, 10_000, 1 << 62):
        for n in (1, 3000, 40_000):
            v = np.sort(rng.integers(0, high, n).astype(np.uint64))
            ef = ngram_lm.EliasFano.of(v)
            assert (ef.get(np.arange(len(v))) == v).all()
            some = np.unique(rng.integers(0, n, 50))
            assert (ef.get(some) == v[some]).all()
            x = np.sort(rng.integers(0, high, 2000).astype(np.uint64))
            at, same = ef.find(x)
            assert at.tolist() == np.searchsorted(v, x).tolist() and same.tolist() == np.isin(x, v).tolist()
    assert ngram_lm.EliasFano.of(np.zeros(0, np.uint64)).n == 0


def test_level_finds_its_successors():
    rng = np.random.default_rng(4)
    keys = np.unique((rng.integers(0, 200, 3000).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 50, 3000).astype(np.uint64))
    counts = rng.integers(1, 9, len(keys))
    of = (keys >> np.uint64(32)).astype(int)
    total = np.bincount(of, weights=counts, minlength=200).astype(int) + 5
    level = ngram_lm.Level(keys, counts, total)
    at, same = level.find(keys)
    assert same.all() and at.tolist() == list(range(len(keys)))
    assert np.abs(level.p_book[level.p[at]] - np.log10((counts - 0.75) / total[of])).max() < 0.02
    assert not level.find(keys + np.uint64(1 << 20))[1].any()


def plain_model(words, trained):
    """The three-word model from dictionaries: a function of (u, v, w), u None for a first word, and the training counts."""
    c, c2, c3, docs_n = Counter(), Counter(), Counter(), 0
    for i, w in words.items():
        for _ in range(trained(i)):
            docs_n += 1
            c.update(w)
            full = ["<begin>", *w]
            c2.update(zip(full, full[1:]))
            c3.update(zip(full, full[1:], full[2:]))
    n = sum(c.values())
    ctx, kinds, kinds2 = Counter(c) | Counter({"<begin>": docs_n}), Counter(), Counter()
    kinds.update(u for u, _ in c2)
    kinds2.update((u, v) for u, v, _ in c3)
    p0 = min(0.5, max(1, sum(x == 1 for x in c.values())) / n)

    def two(v, w):
        one = (1 - p0) * c[w] / n if c[w] else p0
        return one if not ctx[v] else max(0, c2[v, w] - 0.75) / ctx[v] + 0.75 * kinds[v] / ctx[v] * one

    def three(u, v, w):
        if u is None or not c2[u, v]:
            return two(v, w)
        return max(0, c3[u, v, w] - 0.75) / c2[u, v] + 0.75 * kinds2[u, v] / c2[u, v] * two(v, w)

    return three, c, n, c3


def plain_score(three, w):
    full = ["<begin>", *w]
    return sum(math.log10(three(full[i - 2] if i > 1 else None, full[i - 1], full[i])) for i in range(1, len(full)))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("block_bytes,shard_bytes", [(2000, 3000), (1 << 24, 1 << 25), (4000, 500)])
def test_scores(spark, block_bytes, shard_bytes):
    """With many blocks and shards, hot words ("the") are split by their successors."""
    rng = random.Random(8)
    vocabulary = ["The", "of", "é"] + [f"x{i}" for i in range(120)]
    weights = [60, 40, 20] + [1 + 40 / (i + 1) for i in range(120)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 90))), "c") for i in range(300)]
    rows += [(1001, None, "c"), (1002, "", "c"), (1003, "\tnew1 new2\nnew1 ", "c"), (7, rows[7][1], "c"), (1004, "the of " * 4000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(5)
    if block_bytes < 1 << 20:
        assert ngram_lm.split_words(docs, "text", 20)
    got = ngram_lm.score(docs, block_bytes=block_bytes, shard_bytes=shard_bytes).collect()
    assert len(got) == len(rows)

    words = {i: [w.lower() if w.isascii() else w for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["<end>"] for i, t, _ in rows}
    copies = Counter(i for i, *_ in rows)
    three, c, n, c3 = plain_model(words, lambda i: 0 if held(i) else copies[i])
    assert sum(x == 1 for x in c3.values()) > len(c3) / 3
    for g in got:
        w = words[g.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(g.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert abs(g.base_score - sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w)) < 1e-6 * max(1, len(w))
        assert abs(g.score - plain_score(three, w)) < 0.02 * len(w)
    # The model's probabilities of all types sum to one after any context.
    for u, v in ((None, "<begin>"), ("<begin>", "the"), ("the", "of"), ("x3", "the"), ("nowhere", "x3")):
        assert abs(sum(three(u, v, x) for x in c) + three(u, v, "<unseen>") - 1) < 1e-9
    assert ngram_lm.score(docs.limit(0)).count() == 0


def test_documents_that_occur_twice_stand_apart(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices([f"x{k}" for k in range(3000)], k=80))) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    got = ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    twice = [g.score / g.n_tokens for g in got if g.doc_id < 30 and not held(g.doc_id) and not held(1000 + g.doc_id)]
    once = [g.score / g.n_tokens for g in got if 30 <= g.doc_id < 300]
    assert min(twice) > max(once)
    new = [g.score / g.n_tokens for g in got if 30 <= g.doc_id < 300 and g.held_out]
    assert max(new) < min(twice) - 0.3


def test_null_ids_and_extra_columns(spark):
    rows = [(None, "a b c", 1), (None, None, 2), (3, "a b c", 3), (3, "a b c", 4)]
    got = ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string, block int")).collect()
    assert sorted((g.doc_id or -1, g.n_tokens, g.held_out) for g in got) == [(-1, 1, False), (-1, 4, False), (3, 4, held(3)), (3, 4, held(3))]
