"""Quality rules, exact deduplication, packing and token files against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainlake.llm import exact_dedup, packing, quality, token_files
from strainlake.llm.queries import vocabulary

PROSE = " ".join(f"word{i % 37}x{i}" for i in range(70))
ROWS = [
    (1, "a b c a b c\n\na b\nx\x0by", "s0"),
    (2, None, "s0"),
    (3, "", None),
    (4, PROSE, "s1"),
    (5, PROSE + " \n", "s1"),
    (6, PROSE.replace(" ", ""), "s0"),
    (7, "x " * 200, "s1"),
    (8, "a\nb\na\n \nb\n\ta\n# $ é é <|> x x x x", "s0"),
    (9, "tab\tline\r\nend " * 3000, "s2"),
    (9, "tab\tline\r\nend " * 3000, "s2"),
    (None, PROSE, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 7, "clash") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, kept string")


def plain_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measures(docs):
    got = quality.judge(docs).collect()
    want = Counter((r[0], *plain_measures(r[1])) for r in ROWS)
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)


def test_shrunk_rates(spark):
    rows = [("big", 30) for _ in range(500)] + [("tiny", 30)] + [(f"h{i}", 60) for i in range(40) for _ in range(20)]
    m = spark.createDataFrame(rows, "host string, n_words long")
    rates = {r.host: r for r in quality.host_rates(m, {"short": "n_words < 50"}).collect()}
    assert rates["big"].rate > 0.9
    assert rates["h1"].rate < 0.1
    assert rates["tiny"].rate < rates["big"].rate  # one document says little
    verdicts = {r.host: r.host_ok for r in quality.host_verdicts(m, {"short": "n_words < 50"}).collect()}
    assert not verdicts["big"] and verdicts["h1"]


def test_salted_hosts_give_the_same(docs, monkeypatch):
    whole = sorted(map(str, quality.judge(docs).collect()))
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 1)
    assert sorted(map(str, quality.judge(docs).collect())) == whole


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak):
    digest = (lambda n: F.unhex(F.substring(F.sha2(n, 256), 1, 1))) if weak else exact_dedup.sha256
    got = exact_dedup.dedup(docs.repartition(5), digest=digest, fanout=2).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[hashlib.sha256(n.encode()).hexdigest()].append((-len(t or ""), i is None, i))
    assert len(got) == len(ROWS)
    for g in got:
        mine = groups[g.text_sha256]
        assert g.keep_id == min(mine)[2] and g.group_size == len(mine)
    assert sum(g.kept for g in got) == len(groups)


def test_filters_hold_their_keys(spark, docs, monkeypatch):
    keys = spark.range(0, 9000, 3).select(F.col("id").cast("string").alias("k"))
    asked = spark.range(9000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("at"), F.lit(2).alias("Bits"))
    got = exact_dedup.may_hold(asked, F.col("k"), exact_dedup.key_filter(keys, F.col("k"), 3000), "held")
    assert got.columns == ["k", "at", "Bits", "held"]
    hits = {int(r.k) for r in got.where("held").collect()}
    assert hits >= set(range(0, 9000, 3)) and len(hits) < 3000 + 6000 * 0.1
    whole = sorted(map(str, exact_dedup.dedup(docs).collect()))
    monkeypatch.setattr(exact_dedup, "MOST_FILTER", 0)
    assert exact_dedup.key_filter(keys, F.col("k"), 3000) is None
    assert sorted(map(str, exact_dedup.dedup(docs).collect())) == whole


def test_kept_rows_keep_clashing_columns(spark):
    rows = [(1, "a b", "x", 1, "s"), (1, "ab", "y", 2, "t"), (1, "a b", "x", 1, "s"), (2, "c", "z", 3, "u"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string, n int, stay string")
    got = exact_dedup.kept(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [docs.first(), docs.where("doc_id = 2").first(), docs.where("doc_id is null").first()]))
    plain = docs.where("doc_id = 2")
    assert [tuple(r) for r in exact_dedup.kept(plain).collect()] == [rows[3]]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert quality.judge(none).count() == 0
    assert exact_dedup.dedup(none).count() == 0
    assert packing.pack(none, vocabulary()).count() == 0
    assert token_files.round_trip(none, vocabulary()).count() == 0


def encode(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    return tok.encode(text or "", add_special_tokens=False).ids


def test_packing(docs):
    rows = packing.pack(docs.repartition(3), vocabulary()).collect()
    ids = {i: [*encode(t), 1] for i, t, _ in ROWS}
    parts, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        parts[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    copies = Counter(r[0] for r in ROWS)
    for i, p in parts.items():
        at = sorted(p)
        assert sum(n for _, n in at) == copies[i] * len(ids[i])
        if copies[i] == 1:
            assert [a for a, _ in at] == list(np.cumsum([0, *[n for _, n in at]])[:-1])
    for w in windows.values():
        end = 0
        for a, n in sorted(w):
            assert a == end
            end += n
        assert end == 2048 or end & (end - 1) == 0


def test_sum_of_squares_choice():
    rng = np.random.default_rng(1)
    p = packing.SumOfSquares(16)
    for _ in range(400):
        size = int(rng.integers(1, 16))
        options = {}
        for h in range(16 - size + 1):
            if h == 0 or p.counts[h]:
                c = p.counts.copy()
                if h:
                    c[h] -= 1
                if h + size < 16:
                    c[h + size] += 1
                options[h] = int((c**2).sum())
        assert options[p.level(size)] == min(options.values())
        p.place((0, 0, b"\0\0\0\0" * size, size))


def test_token_files(spark, docs, tmp_path):
    got = token_files.round_trip(docs, vocabulary()).collect()
    ids = {i: [*encode(t), 0] for i, t, _ in ROWS}
    start = 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == start and g.n_tokens == len(ids[g.doc_id])
        assert g.ids_crc32 == zlib.crc32(np.asarray(ids[g.doc_id], "<u4").tobytes())
        start += g.n_tokens
    path = str(tmp_path / "t")
    token_files.write(docs, path, vocabulary())
    some = token_files.read(spark, path, 4, 6).collect()
    assert {r.doc_id: list(r.ids) for r in some} == {i: ids[i] for i in (4, 5, 6)}
    assert "ids" not in token_files.metadata(spark, path).columns
    import pyarrow.parquet as pq

    f = next(p for p in (tmp_path / "t").glob("part-*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    column = pq.ParquetFile(f).metadata.row_group(0).column(4)
    assert "DICTIONARY" in str(column.encodings) and column.has_offset_index


def odd_texts(seed, n=400):
    import random

    rng = random.Random(seed)
    pieces = ["a", "word", "Wörter", "naïve", "3", "don't", "x.y", "...", ")", "<|endoftext|>", "<|endoftext", "\x01", "\x01.", "é", "日本", "ⅷ", "😀", "", "\t", "\r", "\u00a0", "\u2028", "_", "'s"]
    joints = [" ", " ", " ", ", ", ". ", ".", ",", "\n", "\n\n", " \n", "\n ", "  ", ".\n", ",\n", ""]
    return ["".join(rng.choice(pieces) + rng.choice(joints) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("specials_as_text,kept", [(False, 600_000), (True, 600_000), (False, 40)])
def test_encoder_is_the_plain_call(specials_as_text, kept):
    """Also with added tokens, marks and white space of all kinds, and with a table that forgets."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from strainlake.llm.tokens import Encoder

    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = specials_as_text
    enc = Encoder(vocabulary(), kept, specials_as_text)
    for seed in range(6):
        texts = [*odd_texts(seed), None, "", " ", "\n", "long " * 3000]
        ids, offs = enc.encode(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, offs[:-1], offs[1:], strict=True):
            assert ids[a:b].tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_a_bad_host_falls_in_query_and_sql(spark, tmp_path):
    """A host whose documents often fail one rule loses its clean documents too; the SQL says the same of every row."""
    import random

    import duckdb

    from strainlake.llm import queries

    rng = random.Random(2)
    rows = []
    for h in range(25):
        for k in range(40):
            words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 80, 90, 120]) if k % 8 else 20)]
            if rng.random() < (0.7 if h == 3 else 0.05):
                words += ["#"] * (len(words) // 3)
            rows.append((100 * h + k, " ".join(words), f"host{h}" if h else None))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_quality_rules(spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    own = got[(got.doc_id >= 300) & (got.doc_id < 340)]
    assert not own.kept.any() and not own.host_ok.any() and (~own.base_failed).sum() > 20
    rest = got.drop(own.index)
    assert (rest.kept == ~rest.base_failed).all()
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op1_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all() and set(got.columns) == set(want.columns)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from strainlake.llm.common import work_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="none"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(session)
