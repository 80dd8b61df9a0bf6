"""Dual-tree clustering against plain rounds, and word BPE against the tokenizers library and one merge at a time."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from strainlake.llm import dual_tree, word_bpe
from strainlake.llm.queries import vocabulary


def plain_lloyd(rows, k=8, rounds=10, dims=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    of = lambda j: sum(d for _, o, d in found if o == j)
    return [(i, j, d, of(j), sum(x[2] for x in found), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, dims, seed=0, groups=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(i, [float(x) for x in np.float32(centres[i % groups] + 0.2 * rng.normal(size=dims))]) for i in range(n)]


def test_clusters_equal_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "BLOCK", 70)
    monkeypatch.setattr(dual_tree, "LEAF", 5)
    rows = vectors(300, 64)
    bad = [(900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 63 + [None]), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] + [0.0] * 63)]
    hot = [(1000 + i, rows[7][1]) for i in range(150)]
    rows += [*bad, *hot, rows[3], rows[3], (None, rows[5][1])]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<float>, q int, cluster string").repartition(3)
    assert as_rows(dual_tree.cluster(df)) == sorted(plain_lloyd(rows), key=repr)


def test_ties_few_vectors_and_empty_tables(spark):
    kind = "vec_id int, embedding array<double>"
    same = [(i, [0.5] * 64) for i in range(20)]  # eight equal centroids: all rows go to number 0
    assert as_rows(dual_tree.cluster(spark.createDataFrame(same, kind))) == sorted(plain_lloyd(same), key=repr)
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert as_rows(dual_tree.cluster(spark.createDataFrame(few, kind))) == sorted(plain_lloyd(few), key=repr)
    assert dual_tree.cluster(spark.createDataFrame([], kind)).count() == 0
    with pytest.raises(ValueError, match="exceeds"):
        dual_tree.cluster(spark.createDataFrame([(1, [1e9] * 64)], kind))


def test_cover_tree_holds_its_bounds():
    v = np.array([x for _, x in vectors(900, 6, 4, 40)]) * 1000
    v[100:400] = v[5]
    v = np.floor(v).astype(np.int64)
    order, t = dual_tree.cover_tree(v)
    assert sorted(order.tolist()) == list(range(900))
    for i in range(len(t["first"])):
        mine = v[order[t["first"][i] : t["last"][i]]]
        assert np.sqrt(((mine - v[t["pivot"][i]]) ** 2).sum(1)).max() <= t["radius"][i] + 1e-3
        kids = range(t["child"][i], t["child"][i] + t["n_child"][i])
        assert not kids or [t["first"][i], *[t["last"][j] for j in kids]] == [*[t["first"][j] for j in kids], t["last"][i]]
    c = v[order][:5]
    inv = np.argsort(order)
    node, whose, at, own = dual_tree.owners(t | {"pivot": inv[t["pivot"]]}, v[order], c)
    assert (t["last"][node] - t["first"][node]).sum() + len(at) == 900
    assert (t["last"][node] - t["first"][node]).max() >= 300  # equal rows are given away as a whole


def plain_bpe(symbols, ranks):
    s = list(symbols)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in ranks]
        if not found:
            return s
        _, i = min(found)
        s[i : i + 2] = [s[i] + s[i + 1]]


def test_rounds_equal_one_merge_at_a_time():
    rng = random.Random(5)
    names, pairs, ranks = list("abcd"), [], {}
    while len(pairs) < 60:
        a, b = rng.choice(names), rng.choice(names)
        if a + b not in names:
            ranks[a, b] = len(pairs)
            pairs.append((a, b))
            names.append(a + b)
    at = {n: i for i, n in enumerate(names)}
    m = word_bpe.Merges(np.array([[at[a], at[b]] for a, b in pairs]), np.array([at[a + b] for a, b in pairs]), len(names))
    words = ["".join(rng.choice("aab" if i % 2 else "abcd") for _ in range(rng.randrange(1, 60))) for i in range(500)] + ["a" * 333]
    flat, n = m.apply(np.array([at[x] for w in words for x in w]), np.array([len(w) for w in words]))
    cut = np.cumsum(n) - n
    assert [[names[i] for i in flat[a : a + k]] for a, k in zip(cut, n, strict=True)] == [plain_bpe(w, ranks) for w in words]
    with pytest.raises(ValueError, match="twice"):
        word_bpe.Merges(np.array([[0, 1], [0, 1]]), np.array([2, 2]), 3)
    with pytest.raises(ValueError, match="before"):
        word_bpe.Merges(np.array([[0, 3], [0, 1]]), np.array([2, 3]), 4)


ODD = [
    None, "", " \n ", "a", "ΑΣ ΑΣΣ Σ σς", "İstanbul ǅ ﬁ", "é ́x a b\xa0c\x85d", "<|endoftext|>x <|startoftext|><|ENDOFTEXT|>", "don't I'LL 'S ''s",
    "aaaaaaaaaa" * 700, "\x00\x1f a﻿b \U0001f600\U0001f468‍\U0001f469 中文字 한국어", "12 3456 ²½ ٣ " * 50, "x" * 5001 + ".", "the cat, the Cat.\tthe\x0bCAT!",
]


def test_word_bpe_equals_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    some = ["".join(rng.choice([chr(rng.randrange(1, 0x250)), chr(rng.randrange(0x300, 0x370)), chr(rng.randrange(0x1000, 0xD7FF)), " ", "'s", "A", "\n"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    texts = ODD + some + ["".join(rng.choice("abcdefghij") for _ in range(20000))]
    path = vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    coder = word_bpe.WordBpe(path, kept_chunks=500)
    for _ in range(2):  # once with an empty table, once with what it kept
        ids, offs = coder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want
    df = spark.createDataFrame([(i if i else None, t, "clash", 1) for i, t in enumerate(texts)], "doc_id int, text string, ids string, t int").repartition(3)
    got = {r.doc_id: r for r in word_bpe.digests(df, path).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i or None]
        assert (r.n_tokens, r.ids_sha256) == (len(w), hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(w, skip_special_tokens=False).encode()).hexdigest()
    coded = word_bpe.encode(df, path)
    text_of = {r.doc_id: r.text for r in word_bpe.decode(coded, path).collect()}
    assert all(text_of[i or None] == lib.decode(w, skip_special_tokens=False) for i, w in enumerate(want))
    assert word_bpe.digests(df.limit(0), path).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["dropout"] = 0.1
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="plain BPE"):
        word_bpe.WordBpe(str(tmp_path / "v.json"))
