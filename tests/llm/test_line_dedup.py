"""Line deduplication against brute force over all pairs of lines."""

import random

import pytest

from strainlake.llm import line_dedup

WS = " \t\n\x0b\f\r"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, least=1):
    at = [((i is None, i or 0, k), i, k, line.strip(WS)) for i, t in rows for k, line in enumerate((t or "").split("\n"))]
    first = {}
    for p, _, _, line in at:
        if line:
            first[line] = min(p, first.get(line, p))
    near = {x for x in first if len(x) >= least and any(first[y] < first[x] and len(y) >= least and x != y and within_one(x, y) for y in first)}
    out = {}
    for i, t in rows:
        ls = [x.strip(WS) for x in (t or "").split("\n")]
        copies = [k for k, x in enumerate(ls) if x and first[x] != (i is None, i or 0, k)]
        nears = [k for k, x in enumerate(ls) if x in near and k not in copies]
        out[i] = (sum(map(bool, ls)), len(copies), len(nears), sorted(copies + nears))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abé "
    bases = ["".join(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 18, 19, 20, 21, 40, 63, 64, 65, 66, 130, 400]))) for _ in range(25)]
    rows = []
    for i in rng.sample(range(1000), 90):
        lines = []
        for _ in range(rng.randint(0, 7)):
            s = rng.choice(bases)
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(s) + 1)
                s = rng.choice([s[:k] + s[k + 1 :], s[:k] + rng.choice(letters) + s[k:], s[:k] + rng.choice(letters) + s[k + 1 :]])
            lines.append(rng.choice(["", " ", "\t"]) + s)
        rows.append((i, "\n".join(lines)))
    return rows + [(None, rows[0][1] + "\n" + bases[0]), (2001, None), (2002, "")]


@pytest.mark.parametrize("seed,least", [(1, 20), (2, 1), (3, 1)])
def test_against_brute_force(spark, seed, least):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, no int").repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_copies, r.n_near, list(r.removed)) for r in line_dedup.dedup(docs, min_near=least).collect()}
    want = brute(rows, least)
    assert got == want
    if least > 1:
        return
    clean = {r.doc_id: r.text for r in line_dedup.cleaned(docs.withColumnsRenamed({"no": "gone"})).collect()}
    for i, t in rows:
        assert clean[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i][3]))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a line of twenty chars\na"), (1, "a line of twenty chars\na"), (2, "a line of twenty chart")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_copies, r.n_near) for r in line_dedup.dedup(docs).collect())
    assert got == [(1, 2, 0, 0), (1, 2, 0, 0), (2, 1, 0, 1)]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_a_very_long_line_and_clashing_names(spark):
    long = "abcdefghij" * 4000
    rows = [(1, long, "a", 1), (2, long[:777] + long[778:], "b", 2), (3, long[:9] + "Z" + long[10:] + "\nx", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, i string, gone int")
    got = {r.doc_id: (r.n_near, list(r.removed)) for r in line_dedup.dedup(docs).collect()}
    assert got == {1: (0, []), 2: (1, [0]), 3: (1, [0])}
    clean = sorted(line_dedup.cleaned(docs).collect())
    assert [tuple(r) for r in clean] == [(1, long, "a", 1), (2, "", "b", 2), (3, "x", "c", 3)]
