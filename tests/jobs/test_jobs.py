"""The jobs on copies of growing input, against plain Python, and by their command lines' parts."""

import hashlib
import logging
import re
import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import frame_fields, run_logs
from jobs.common import default_config, load_config
from strainlake.config import CorrelateConfig, Lattice
from strainlake.operators import ncc_fft

REPORTS = "doc_id long, text string, source string, n_lines int"
FIRST = [
    (1, "Start\nstep 12 done\nError: volume 17 not found  ", "a", 0),
    (2, "Start\nERROR: volume 4 not found\n\n \t\n", "a", 0),
    (3, None, "a", 0),
    (4, "", None, 0),
    (5, "x" * 5000 + "\nTraceback\nfailed", "", 0),
    (None, "fine\r\n", "2024", 0),
]
SECOND = [(7, "error: volume 999 not found", "a", 0), (8, "Fine", "b", 0), (8, "Fine", "b", 0), (9, "é" * 3000, "b", 0)]


def plain(rows):
    out = []
    for i, t, store, _ in rows:
        t = t or ""
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        last = re.sub(r"[0-9]+", "#", (lines[-1] if lines else "").strip("\x20\x09\x0a\x0b\x0c\x0d").translate({c: c + 32 for c in range(65, 91)}))
        n = sum(any(m in x.lower() for m in ("error", "failed", "exception", "traceback")) for x in lines)
        out.append((i, len(t), len(lines), n, hashlib.sha256(last.encode()).hexdigest()[:16], t[-2000:], store or "(none)"))
    alike = Counter((r[6], r[4]) for r in out)
    return sorted(((*r, alike[r[6], r[4]]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("id", "n_chars", "n_lines", "n_marked", "signature", "excerpt", "store", "alike").collect()), key=repr)


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_run_logs_take_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame(FIRST, REPORTS).coalesce(1).write.parquet(source)
    assert rows_of(run_logs.run(spark, source, out, cp)) == plain(FIRST)
    before = files(tmp_path / "out")
    assert rows_of(run_logs.run(spark, source, out, cp)) == plain(FIRST)
    assert files(tmp_path / "out") == before  # nothing new: nothing is written
    spark.createDataFrame(SECOND, REPORTS).coalesce(1).write.mode("append").parquet(source)
    assert rows_of(run_logs.run(spark, source, out, cp)) == plain(FIRST + SECOND)
    after = files(tmp_path / "out")
    kept = {p for p in before if "digests" in str(p) or "store=2024" in str(p) or "store=(none)" in str(p)}
    assert kept and all(after.get(p) == before[p] for p in kept)  # old digests and stores without news are left alone
    assert any(f"{len(SECOND)} reports read" in r.getMessage() for r in caplog.records)
    once = run_logs.run(spark, source, str(tmp_path / "out2"), str(tmp_path / "cp2"), run_logs.Config(files_per_batch=1))
    assert rows_of(once) == plain(FIRST + SECOND)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame(FIRST, REPORTS).coalesce(1).write.parquet(source)
    run_logs.run(spark, source, out, cp)
    shutil.rmtree(tmp_path / "cp" / "commits")  # as if the run had died before it committed
    assert rows_of(run_logs.run(spark, source, out, cp)) == plain(FIRST)


def test_run_logs_of_an_empty_table(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame([], REPORTS).write.parquet(source)
    assert run_logs.run(spark, source, out, cp).count() == 0


SAMPLES = "year int, z int, y int, x int, v double"
CONFIG = frame_fields.Config("year", "z", "y", "x", "v", (8, 10, 10), 0.5, window=4, mask_threshold=0.6)


def samples(years, seed=3):
    rng = np.random.default_rng(seed)
    base, out = rng.integers(0, 9, (8, 10, 10)), []
    for n, year in enumerate(years):
        v = np.roll(base, n, 2) + rng.integers(0, 2, base.shape)
        out += [(year, *map(int, i), float(v[i])) for i in np.ndindex(base.shape) if v[i]]
    return out


def plain_peaks(rows, a, b, lat):
    ref, dfm = (np.zeros((8, 10, 10)) for _ in range(2))
    for year, z, y, x, v in rows:
        if year in (a, b):
            (ref if year == a else dfm)[z, y, x] += v
    out = {}
    for p in range(lat.points):
        at = [i * s for i, s in zip(np.unravel_index(p, lat.counts), lat.stride, strict=True)]
        cut = tuple(slice(s, s + 4) for s in at)
        m = (ref[cut] >= 0.5)[None]
        if m.mean() >= 0.6:
            r, d = (ncc_fft.prepared(v[cut][None], m, 0.0) for v in (ref, dfm))
            out[p] = ncc_fft.peak_of(ncc_fft.correlation(r, d))[1][0]
    return out


def test_frame_fields_rerun_and_grow(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    odd = [(None, 0, 0, 0, 1.0), (2000, 0, 0, 0, None), (2000, 8, 0, 0, 5.0), (2000, -1, 0, 0, 5.0), (2000, None, 0, 0, 5.0)]
    first = samples((2000, 2001)) + odd
    spark.createDataFrame(first, SAMPLES).write.parquet(source)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    once = order(frame_fields.run(spark, source, out, CONFIG))
    assert order(frame_fields.run(spark, source, out, CONFIG)) == once
    lat = Lattice(CONFIG.shape, CorrelateConfig(window=4).window, 0.5)
    assert len(once) == lat.points
    want = plain_peaks([r for r in first if None not in r and 0 <= r[1] < 8], 2000, 2001, lat)
    f = {r.poi: r for r in frame_fields.output(spark, out).collect()}
    for p, r in f.items():
        assert (r.status == 1) == (p not in want)
        if r.valid:
            assert np.allclose([r.dz, r.dy, r.dx], want[p], atol=1e-5)
    more = samples((2000, 2001, 2002))[len(first) - len(odd) :]
    spark.createDataFrame(more, SAMPLES).write.mode("append").parquet(source)
    grown = frame_fields.run(spark, source, out, CONFIG)
    assert {r.pair_id for r in grown.select("pair_id").distinct().collect()} == {"2000-2001", "2001-2002"}
    assert order(grown.where("pair_id = '2000-2001'")) == once
    counts = spark.read.schema(frame_fields.REPORT).parquet(f"{out}/reports").where("pair_id = '2001-2002'").first()
    assert counts.n_total == lat.points == counts.n_ok + counts.n_masked + counts.n_outlier + counts.n_out_of_range


def test_frame_fields_of_one_frame_and_of_none(spark, tmp_path):
    for n, rows in enumerate(([], samples((2000,)))):
        source, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        spark.createDataFrame(rows, SAMPLES).write.parquet(source)
        assert frame_fields.run(spark, source, out, CONFIG).count() == 0


def test_configs(tmp_path):
    assert default_config(run_logs.Config, "run_logs.yaml") == run_logs.Config()
    assert default_config(frame_fields.Config, "frame_fields.yaml").shape == (12, 16, 16)
    (tmp_path / "c.yaml").write_text("excerp: 3")
    with pytest.raises(ValueError, match="excerp"):
        load_config(run_logs.Config, str(tmp_path / "c.yaml"))


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run_logs, "session", lambda name: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    spark.createDataFrame(FIRST, REPORTS).write.parquet(str(tmp_path / "in"))
    (tmp_path / "c.yaml").write_text("excerpt: 3\nmarkers: [done]")
    run_logs.main(["--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/cp", "--config", f"{tmp_path}/c.yaml"])
    t = run_logs.output(spark, f"{tmp_path}/out")
    assert t.where("id = 1").first().n_marked == 1 and t.agg(F.max(F.length("excerpt"))).first()[0] == 3
