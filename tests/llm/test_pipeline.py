"""The pipeline on a small table, stage by stage, against plain Python."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from strainlake.llm.common import written


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(vocabulary, k=rng.randint(20, 120))
        if i % 5 == 0:
            w[3:3] = ["vile"] * 3
        labels.append((i, 1, int(i % 5 == 0)))
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3"])))
    for k in range(60):  # copies and near copies of clean documents
        i = rng.choice([x for x in range(400) if x % 5])
        w = rows[i][1].split()
        if k % 2:
            w[rng.randrange(len(w))] = "changed"
        rows.append((400 + k, "  ".join(w), "en", "s1"))
    rows += [(900, None, None, None), (901, "", "en", "s1")]
    top = tmp_path_factory.mktemp("sf")
    docs = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def fives(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, sf_dir), name)
    rows = {k: {r.doc_id: r for r in v.collect()} for k, v in out.items() if k != "packing"}
    for name in ("toxicity", "exact_dedup", "ngram_jaccard", "mixing"):
        assert out[name].columns == out["documents"].columns
    clean = rows["toxicity"]
    assert not any(i % 5 == 0 and i < 400 for i in clean)
    assert all(i in clean for i in rows["documents"] if i >= 400 or i % 5)
    groups = defaultdict(list)
    for i, r in clean.items():
        groups[re.sub(r"\s", "", r.text or "")].append((-len(r.text or ""), i))
    assert set(rows["exact_dedup"]) == {min(g)[1] for g in groups.values()}
    left = rows["exact_dedup"]
    sets = {i: fives(r.text) for i, r in left.items()}
    up = {i: i for i in left}

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in left:
        for j in left:
            if i < j and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert set(rows["ngram_jaccard"]) == {i for i in left if top(i) == i}
    mixed = rows["mixing"]
    assert set(mixed) <= set(rows["ngram_jaccard"]) and len(mixed) > 0.75 * len(rows["ngram_jaccard"])
    packed = out["packing"].toPandas()
    assert set(packed.doc_id) == set(mixed)
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)


EDGES = "doc_id long, text string, lang string, source string, n_chars long, own string, n int, stay long, i long, gone int, kept boolean"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    """Nulls, empty and very long texts, whole repeats, a null id, clashing names; an empty table goes through empty."""
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
    some, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "co")
    texts = [(1, long), (2, some), (2, some), (None, other), (None, None), (3, ""), (4, None)]
    rows = [(i, t, None, None, None, "o", 1, 2, 3, 4, None) for i, t in texts]
    spark.createDataFrame([] if empty else rows, EDGES).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = docs.schema
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.schema == want
    got = {k: sorted((str(r.doc_id), r.text or "") for r in v.collect()) for k, v in out.items() if k != "packing"}
    assert got["toxicity"] == sorted((str(i), t or "") for i, t in texts if not empty)
    stay = [] if empty else sorted([("1", long), ("2", some), ("None", other), ("3", "")])
    assert got["exact_dedup"] == got["ngram_jaccard"] == stay
    assert set(got["mixing"]) <= set(stay)
    packed = out["packing"].toPandas()
    assert packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()


def test_windows_are_written_in_small_batches(spark):
    """The packing stage runs while it is called, its texts in batches of bounded bytes, and small parts change no row."""
    from strainlake.llm import packing
    from strainlake.llm.queries import vocabulary

    docs = spark.createDataFrame([(i, f"text {i} " * (i % 40)) for i in range(200)], "doc_id long, text string").coalesce(1)
    got = corpus_pipeline.pack_windows(spark, docs, "")
    assert got._work_path and "MapInArrow" not in got._jdf.queryExecution().toString()
    whole = sorted(map(tuple, packing.pack(docs, vocabulary()).collect()))
    assert sorted(map(tuple, got.collect())) == whole == sorted(map(tuple, packing.pack(docs, vocabulary(), part_bytes=1).collect()))
