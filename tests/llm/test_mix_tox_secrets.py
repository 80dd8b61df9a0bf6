"""Mixing, toxicity and secret scans against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strainlake.llm import mixing, secret_scan, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice("aaab"), rng.choice(["x", "y"]), rng.choice(["p", "q"])) for i in range(400)]
    rows += [(None, None, None, None, None), (7, "w w", "a", "x", "p")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")


def test_raking_meets_targets(docs):
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.7, "y": 0.3}, "topic": {"p": 0.4, "q": 0.6}}
    m = mixing.mix(docs, topic="topic", targets=targets, keep=0.5, rounds=20).toPandas()
    assert len(m) == 402
    m = m[m.n_tokens > 0]
    expected = m.prob * m.n_tokens
    assert abs(expected.sum() / m.n_tokens.sum() - 0.5) < 1e-6
    if m.prob.max() < 1:
        for dim, shares in targets.items():
            got = expected.groupby(m[dim]).sum() / expected.sum()
            for k, v in shares.items():
                assert abs(got[k] - v) < 1e-3
    u = [int(hashlib.md5(str(int(i)).encode()).hexdigest()[:8], 16) / 2**32 for i in m.doc_id]
    assert (m.selected == (np.asarray(u) < m.prob)).all()


def test_skewed_sources_meet_their_targets(spark, caplog):
    """The finding's case (a third of the tokens in one source, ten equal others) and cells capped at 1."""

    def expected(m, dim):
        e = (m.prob * m.n_tokens).groupby(m[dim]).sum()
        return (e / e.sum()).to_dict()

    rows = [(i, "w " * 10, "hot" if i % 3 == 0 else f"s{i // 3 % 10}", "x", "p") for i in range(900)]
    schema = "doc_id long, text string, source string, lang string, topic string"
    m = mixing.mix(spark.createDataFrame(rows, schema), topic="topic").toPandas()
    raw = {"hot": (1 / 3) ** 0.7} | {f"s{i}": (1 / 15) ** 0.7 for i in range(10)}
    got = expected(m, "source")
    assert all(abs(got[k] - v / sum(raw.values())) < 1e-3 for k, v in raw.items())
    assert 0.86 < (m.prob * m.n_tokens).sum() / m.n_tokens.sum() < 0.88 and m.prob.max() <= 1
    # b/x/q alone would need more tokens than it has; the other cells make up for it.
    targets = {"source": {"a": 0.62, "b": 0.38}, "lang": {"x": 0.65, "y": 0.35}, "topic": {"p": 0.4, "q": 0.6}}
    rows = [(i, "w " * 10, "aaab"[i % 4], "xy"[i // 4 % 2], "pq"[i // 8 % 2]) for i in range(960)]
    m = mixing.mix(spark.createDataFrame(rows, schema), topic="topic", targets=targets, keep=0.6).toPandas()
    assert abs(m.prob.max() - 1) < 1e-6 and abs((m.prob * m.n_tokens).sum() / m.n_tokens.sum() - 0.6) < 1e-3
    for dim, shares in targets.items():
        got = expected(m, dim)
        assert all(abs(got[k] - v) < 1e-3 for k, v in shares.items())
    # Targets that the floor of the kept share rules out: the share stays there and the gap is told.
    with caplog.at_level("WARNING", mixing.__name__):
        m = mixing.mix(spark.createDataFrame(rows, schema), topic="topic", targets={"source": {"a": 0.1, "b": 0.9}}).toPandas()
    assert abs((m.prob * m.n_tokens).sum() / m.n_tokens.sum() - mixing.LEAST) < 1e-3 and "gaps to the targets" in caplog.text


def test_salted_cells_and_empty(docs, monkeypatch):
    whole = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 1)
    assert sorted(map(str, mixing.mix(docs).collect())) == whole
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.kept(docs).columns == docs.columns


def test_segments_are_ruzzo_tompa():
    """Recursive definition: the best segment, then the same left and right of it."""
    rng = np.random.default_rng(5)

    def brute(s, base=0):
        best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a, b in itertools.combinations(range(len(s) + 1), 2)), default=(0, 0, 0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = best[3], best[4]
        return brute(s[:a], base) + [(base + a, base + b)] + brute(s[b:], base + b)

    for _ in range(300):
        n = int(rng.integers(1, 14))
        at = np.flatnonzero(rng.random(n) < 0.5)
        score = rng.random(len(at)) * 3 - 0.987  # clean-leaning tokens score below zero
        s = np.full(n, -0.5)
        s[at] = score
        assert [(a, b) for a, b, _ in toxicity.segments(at, score, 0.5)] == brute(list(s))


def test_toxicity_learns(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(vocabulary, k=60)
        y = int(i % 6 == 0)
        if y:
            for w in ("vile", "slur", "vileness"):
                words.insert(rng.randrange(60), w)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, y))
    rows += [(9001, None, "x"), (9002, "", "x"), (None, "vile slur", "x")]
    labels += [(9001, None), (None, 1), (3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    held = [g for g in got if g.held_out and g.doc_id < 900]
    assert sum(g.predicted == (g.doc_id % 6 == 0) for g in held) > 0.97 * len(held)
    found = toxicity.passages(docs, model).toPandas()
    assert set(found.doc_id.dropna()) & set(range(0, 900, 6)) and (found.chance <= toxicity.SIGNIFICANCE).all()
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(g.predicted == 0 for g in toxicity.score(docs, nothing).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_fit_is_the_plain_one(spark):
    """Term scores, lambda, K and the logistic step against loops over the labelled texts."""
    rng = random.Random(3)
    plain = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choice(["vile", "slur", "slurs"] if i % 2 == 0 and rng.random() < 0.2 else plain + ["kind", "fairly"] * (i % 2)) for _ in range(50))) for i in range(600)]
    rows += [(1000, "kind " * 20_000), (1001, None), (1002, rows[8][1])]
    labels = [(i, int(i % 2 == 0 and i < 1000)) for i, _ in rows]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))

    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    texts = {}
    for i, t in rows:
        if not held(i):
            key = re.sub(r"\s", "", t or "")
            texts[key] = max(texts.get(key, (0, "")), (int(i % 2 == 0 and i < 1000), t or ""))
    texts = list(texts.values())
    count = Counter(), Counter()
    for y, t in texts:
        words = {w.strip(".,") for w in t.lower().split()}
        count[y].update({x for w in words for x in [w, *(w[:k] + "*" for k in range(4, 9) if len(w) > k)]})
    nt, nc = (sum(n for x, n in count[y].items() if x[-1] != "*") for y in (1, 0))
    want = {}
    for x in count[0].keys() | count[1].keys():
        t, c = count[1][x], count[0][x]
        a, a0 = 0.1 * (t + c), 0.1 * (nt + nc)
        d = math.log((t + a) / (nt + a0 - t - a)) - math.log((c + a) / (nc + a0 - c - a))
        se = math.sqrt(1 / (t + a) + 1 / (c + a))
        if abs(d) > 1.96 * se:
            want[x] = math.copysign(abs(d) - 1.96 * se, d)
    assert model.terms == pytest.approx(want) and min(want.values()) < 0 < max(want.values())

    def scores(t):
        own = [[want[x] for x in [w, *(w[:k] + "*" for k in range(4, 9) if len(w) > k)] if x in want] for w in t.lower().split()]
        return [max(x, default=0.0) - 0.5 for x in own]

    clean = [scores(t) for y, t in texts if not y]
    tokens = [x for s in clean for x in s] + [max(want.values()) - 0.5]
    assert abs(sum(math.exp(model.lam * x) for x in tokens) / len(tokens) - 1) < 0.03
    top = lambda s: max([x for *_, x in toxicity.segments(np.arange(len(s)), np.asarray(s))], default=0.0)
    k = len(clean) / sum(max(1, len(s)) * math.exp(-model.lam * top(s)) for s in clean)
    assert model.k == pytest.approx(k, rel=1e-6)
    x, y = [model.statistic(t) for _, t in texts], [y for y, _ in texts]
    p = [1 / (1 + math.exp(-(model.slope * v + model.shift))) for v in x]
    assert abs(sum((a - b) * v for a, b, v in zip(y, p, x)) - 0.01 * model.slope) < 1e-3
    assert abs(sum(a - b for a, b in zip(y, p)) - 0.01 * model.shift) < 1e-3


def plain_spans(text):
    t = text or ""
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 8]
    b = [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    c = [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(a + b + c)


def test_secrets(spark):
    rng = random.Random(2)
    key = "".join(rng.choices(secret_scan.ALPHABETS["base62"], k=44))
    hexa = "".join(rng.choices("0123456789abcdef", k=40))
    filler = "the quick brown fox and some ordinary words of a text " * 30
    texts = [
        "é pass Password = 'abcdefgh1' token:short SECRET=longenough_1.2 api_key: x apikey=\"AbCdEf12\"",
        f"ä AKIAABCDEFGHIJKL12 AKIASHORT {hexa} {hexa[:31]} {filler}",
        f"ü {key} {filler}",
        filler + "supercalifragilisticexpialidocious https/www/example/com/some/ordinary/path 12345678901234567890123 aaaaaaaaaaaaaaaaaaaaaaaaaaaa",
        None,
        "",
        "ſecret=abcdefghij toKen=abcdefghij",
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, filler, "y"), (1, texts[1], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secret_scan.scan(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        t = filler if g.doc_id is None else texts[g.doc_id]
        base = plain_spans(t)
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert g.base_sha256 == hashlib.sha256(secret_scan.joined(base).encode()).hexdigest()
        assert {x for x in g.spans.split(",") if x and not x.startswith("random")} == set(secret_scan.joined(base).split(",")) - {""}
    by = {g.doc_id: g.spans for g in got}
    assert f"random:2:{2 + len(key)}" in by[2]
    assert "random" not in by[3] and by[4] == by[5] == ""
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_secrets_in_names_parameters_and_paths(spark):
    rng = random.Random(6)

    def key(name, n, first="A"):  # no separator at its edges
        k = "".join(rng.choices(secret_scan.ALPHABETS[name], k=n - 2))
        return first + k + "z"

    filler = "the quick brown fox and some ordinary words of a text " * 30
    cases = [
        ("é STRIPE_LIVE=", key("base62", 44), f"\n{filler}"),
        ("DB_URL=", key("base64", 64) + "==", f" {filler}"),
        ("see https://host.example/get?user=someone&sig=", key("base62", 44), f"&x=1 {filler}"),
        (f"{filler} /home/some-user/my_files/", key("base62", 44), " end"),
        (f"{filler} https/some/ordinary/path/", key("base62", 44), " end"),
        (f"{filler} a+b/c/", key("base64url", 64), ""),
        ("ü token=abcdefgh ", key("base62", 44), f" {filler}"),
        (f"{'0a1b2c3d' * 4}/", key("base62", 44, "X"), f" {filler}"),
    ]
    docs = spark.createDataFrame([(i, "".join(c)) for i, c in enumerate(cases)] + [(99, filler + "NAME=the_quick_brown_fox/of-ordinary_words=and_some_other_words")], "doc_id long, text string")
    by = {g.doc_id: g.spans.split(",") for g in secret_scan.scan(docs).collect()}
    for i, (before, k, _) in enumerate(cases):
        assert f"random:{len(before)}:{len(before) + len(k)}" in by[i], (i, by[i])
    assert by[99] == [""]


def test_battery_against_plain_tests():
    """Each deviate against its textbook formula, and their law under chance."""
    rng = np.random.default_rng(4)
    for k, n in ((16, 40), (62, 44), (26, 9)):
        x = rng.integers(0, k, (300, n))
        z = secret_scan.deviates(x, k)
        for r in range(20):
            seen = [sum(v == i for v in x[r]) for i in range(k)]
            chi = sum((c - n / k) ** 2 / (n / k) for c in seen)
            assert z[0][r] == pytest.approx((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
            high = [v >= k // 2 for v in x[r]]
            a, b = sum(high), n - sum(high)
            runs = sum(1 for _ in itertools.groupby(high))
            assert z[1][r] == pytest.approx((runs - 2 * a * b / n - 1) / math.sqrt(2 * a * b * (2 * a * b - n) / (n * n * (n - 1))))
            m = x[r].mean()
            serial = sum((p - m) * (q - m) for p, q in zip(x[r], x[r][1:])) / sum((p - m) ** 2 for p in x[r])
            assert z[2][r] == pytest.approx((serial + 1 / n) * math.sqrt(n))
        assert all(abs(v.mean()) < 0.25 and 0.7 < v.std() < 1.3 for v in z)
    patterned = np.asarray([[0, 1] * 20, [5] * 40])
    assert (secret_scan.battery(patterned, 26) > np.quantile(secret_scan.battery(rng.integers(0, 26, (500, 40)), 26), 0.99)).all()


def test_false_discovery_rule_against_brute_force():
    """Benjamini-Hochberg in each class, over p-values of which all but the small ones are counted only."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        p = {c: np.concatenate([rng.random(rng.integers(1, 400)), 10.0 ** -rng.uniform(1, 6, rng.integers(0, 30))]) for c in range(3)}
        bins = Counter((c, int(-10 * math.log10(x))) for c, xs in p.items() for x in xs if x <= 0.01)
        least = secret_scan.thresholds(dict(bins), {c: len(xs) for c, xs in p.items()}, 0.01)
        for c, xs in p.items():
            up = np.sort([10 ** (-int(-10 * math.log10(x)) / 10) for x in xs])  # p-values as the bins round them, upwards
            ok = np.flatnonzero(up <= 0.01 * np.arange(1, len(up) + 1) / len(up))
            want = up[ok[-1]] if len(ok) else 0.0
            for x in xs:
                q = int(-10 * math.log10(x))
                assert (q >= least.get(c, 1 << 30)) == (10 ** (-q / 10) <= want * (1 + 1e-12) and x <= 0.01)


def test_planted_keys_are_found_and_words_are_not(spark):
    rng = random.Random(9)
    syllables = ["tion", "ing", "er", "an", "the", "re", "ou", "st", "en", "ly", "ment", "de"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 5)))
    texts, keys = [], {}
    for i in range(400):
        w = [word().capitalize() if rng.random() < 0.1 else word() for _ in range(150)] + [str(rng.randrange(10**9))]
        if i % 10 == 0:
            name, n = [("base62", 24), ("base62", 40), ("base64url", 43), ("base36", 36)][i // 10 % 4]
            keys[i] = "k" + "".join(rng.choices(secret_scan.ALPHABETS[name], k=n - 2)) + "7"
            w.insert(rng.randrange(len(w)), keys[i])
        texts.append(" ".join(w))
    got = {g.doc_id: g.spans for g in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    spans = {(i, texts[i][int(a) : int(b)]) for i, s in got.items() for k, a, b in (x.split(":") for x in s.split(",") if x) if k == "random"}
    found = sum((i, k) in spans for i, k in keys.items())
    assert found >= 0.9 * len(keys) and all(i in keys for i, _ in spans), [k for i, k in keys.items() if (i, k) not in spans]
    very_long = "x".join(texts)  # one text of some 300,000 characters gives the same runs
    assert len(very_long) > 200_000 and secret_scan.scan(spark.createDataFrame([(1, very_long)], "doc_id long, text string")).count() == 1
