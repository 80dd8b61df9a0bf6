"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strainlake.llm import jaccard


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(doc, least.get(top(i), doc))
    return {doc: (len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(rows)}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    bases = [rng.choices(vocabulary, k=rng.choice([3, 12, 40, 90, 200])) for _ in range(12)]
    texts = []
    for _ in range(300):
        kind = rng.random()
        w = list(rng.choice(bases))
        if kind < 0.6:  # near copies, a few words changed, some chains
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.8:  # a passage that many share
            w = rng.choices(vocabulary, k=rng.randint(0, 60)) + passage
        else:
            w = rng.choices(vocabulary, k=rng.randint(0, 80))
        texts.append(" ".join(w) if rng.random() < 0.7 else "\n".join(w).lower())
    texts += ["", None, "one", "ONE", "one two", "é x", "é x"]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed,hot,short,chunk", [(1, 48, 64, 2048), (2, 5, 2, 2048), (3, 2, 8, 16), (4, 4, 0, 7)])
def test_components(spark, monkeypatch, seed, hot, short, chunk):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (5, "a"), (None, "a b c d"), (None, None), (3, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.join(docs).collect())
    assert got == [(-1, 0, -1), (-1, 2, -1), (3, 2, 3), (5, 2, 3), (5, 2, 3), (5, 2, 3)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(7)
    for n in (3, 50, 700):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[n // 5 :], rng.integers(0, 1 << 62, n // 3).astype(np.uint64)])
        assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_chains_become_one_component(spark):
    nodes = spark.range(200).select("id")
    links = spark.range(149).selectExpr("id as x", "id + 1 as y")
    got = {r.id: r.comp for r in jaccard.components(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(150)) and all(got[i] == i for i in range(150, 200))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingles_of_many_texts_at_once(k):
    """Sizes and intersections are those of plain word tuples, wherever a text lies among others."""
    rng = random.Random(7)
    texts = ["", None, "  ", "A b", "a\x0bb\x0cc\td\re\nf", "É É x", "x" * 63 + " " + "x" * 64 + " " + "x" * 65 + " y y", "\0 \0\0 a", "12345678 123456789 1234567", "tail ", " lead x y z"]
    texts += ["".join(rng.choice("abAB \n\tcdé") for _ in range(rng.randrange(150))) for _ in range(300)]

    def plain(text):
        w = (text or "").encode().lower().split()  # bytes: A-Z alone
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = [plain(t) for t in texts]
    for column in (pa.array(texts), pa.array(["w x", *texts], pa.large_string()).slice(1)):
        got = jaccard.shingle_lists(column, k)
        assert all((np.diff(s.astype(object)) > 0).all() for s in got)
        assert [len(s) for s in got] == [len(w) for w in want]
        assert len(np.unique(np.concatenate(got))) == len(set().union(*want))
        for _ in range(500):
            i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])
    assert not len(jaccard.shingle_parts(pa.array([], pa.string()), k)[0])
