"""The jobs as queries: each runs twice into one new folder and returns the whole output after that, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs import frame_fields, run_logs
from jobs.common import default_config
from strainlake.functions.shipping import shared_folder
from strainlake.plans.oracle import fit, outliers, r


def job1_run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text tables' documents as run reports."""
    top, config = shared_folder(spark, "job1"), default_config(run_logs.Config, "run_logs.yaml")
    for _ in range(2):
        t = run_logs.run(spark, f"{sf_dir}/documents.parquet", f"{top}/out", f"{top}/checkpoint", config)
    return t.select(F.col("id").alias("doc_id"), "store", "n_chars", "n_lines", "n_marked", "signature", F.sha2("excerpt", 256).alias("excerpt_sha256"), "alike", "first_id", "last_id")


def job2_frame_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scan samples: a frame for each year."""
    top, config = shared_folder(spark, "job2"), default_config(frame_fields.Config, "frame_fields.yaml")
    for _ in range(2):
        t = frame_fields.run(spark, f"{sf_dir}/lineitem.parquet", f"{top}/out", config)
    real = [(F.round(F.col(c).cast("double"), 5) + 0.0).alias(c) for c in ("dz", "dy", "dx", "confidence", "mean_dz", "mean_dy", "mean_dx")]
    return t.select("pair_id", "poi", *[F.col(c).cast("long").alias(c) for c in ("iz", "iy", "ix", "status", "n_ok")], "valid", *real)


_WS = r"[\x20\x09-\x0D]"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JOB1 = rf"""
WITH d AS (SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN '(none)' ELSE source END AS store, coalesce(text, '') AS t FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, store, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(l, lambda x: regexp_matches({_FOLD.format('x')}, 'error|failed|exception|traceback'))) AS BIGINT) AS n_marked,
 substr(sha256(regexp_replace({_FOLD.format(rf"regexp_replace(coalesce(l[-1], ''), '^{_WS}+|{_WS}+$', '', 'g')")}, '[0-9]+', '#', 'g')), 1, 16) AS signature, sha256(right(t, 2000)) AS excerpt_sha256 FROM l)
SELECT *, count(*) OVER w AS alike, min(doc_id) OVER w AS first_id, max(doc_id) OVER w AS last_id FROM g WINDOW w AS (PARTITION BY store, signature)
"""


def _job2() -> str:
    """Points and places of each pair carry the pair's number, a thousand apart, so that one plan serves all pairs."""
    real = lambda c: r(c, c).replace(", 6)", ", 5)")
    zero = ", ".join(f"CASE WHEN s = 0 THEN CAST({c} AS FLOAT) ELSE 0 END AS {c}" for c in ("dz", "dy", "dx", "confidence"))
    return f"""
WITH s AS (SELECT year(l_shipdate) AS f, month(l_shipdate) - 1 AS z, l_suppkey % 16 AS y, l_partkey % 16 AS x, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL),
ps AS (SELECT *, row_number() OVER (ORDER BY b) AS pid, CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) AS pair_id FROM (SELECT lag(f) OVER (ORDER BY f) AS a, f AS b FROM (SELECT DISTINCT f FROM s)) WHERE a IS NOT NULL),
cells AS (SELECT i // 256 AS z, (i // 16) % 16 AS y, i % 16 AS x FROM range(3072) t(i)),
vol AS (SELECT pid, cells.z, cells.y, cells.x, coalesce(p.v, 0e0) AS r0, coalesce(q.v, 0e0) AS d0, CASE WHEN p.v >= 1 THEN 1e0 ELSE 0e0 END AS mm FROM ps CROSS JOIN cells LEFT JOIN s p ON p.f = a AND p.z = cells.z AND p.y = cells.y AND p.x = cells.x LEFT JOIN s q ON q.f = b AND q.z = cells.z AND q.y = cells.y AND q.x = cells.x),
grid AS (SELECT pid, pair_id, i AS own, 1000 * pid + i AS poi, 1000 * pid + i // 49 AS iz, (i // 7) % 7 AS iy, i % 7 AS ix, 2 * (i // 49) AS z0, 2 * ((i // 7) % 7) AS y0, 2 * (i % 7) AS x0 FROM ps CROSS JOIN range(245) t(i)),
win AS (SELECT poi, z - z0 AS jz, y - y0 AS jy, x - x0 AS jx, r0, d0, mm FROM grid JOIN vol ON vol.pid = grid.pid AND z >= z0 AND z < z0 + 4 AND y >= y0 AND y < y0 + 4 AND x >= x0 AND x < x0 + 4),
adm AS (SELECT poi FROM win GROUP BY poi HAVING sum(mm) / 64e0 >= 0.6e0),
pr AS (SELECT poi, jz, jy, jx, (r0 - sum(r0 * mm) OVER p / greatest(sum(mm) OVER p, 1)) * mm AS r, (d0 - sum(d0 * mm) OVER p / greatest(sum(mm) OVER p, 1)) * mm AS d FROM win JOIN adm USING (poi) WINDOW p AS (PARTITION BY poi)),
g AS (SELECT poi, kz, ky, kx, sum(r * d) AS rd, sum(r * r) AS rr, sum(d * d) AS dd FROM (SELECT a.poi, b.jz - a.jz AS kz, b.jy - a.jy AS ky, b.jx - a.jx AS kx, a.r, b.d FROM pr a JOIN pr b USING (poi)) WHERE kz BETWEEN -2 AND 1 AND ky BETWEEN -2 AND 1 AND kx BETWEEN -2 AND 1 GROUP BY ALL),
c AS (SELECT poi, kz, ky, kx, round(rd / sqrt(greatest(rr, 0) * greatest(dd, 0) + 1e-12), 9) AS ncc FROM g), {fit(4)},
f0 AS (SELECT grid.poi, pair_id, own, iz, iy, ix, kz + fz AS dz, ky + fy AS dy, kx + fx AS dx, confidence, CASE WHEN sv.poi IS NULL THEN 1 WHEN greatest(abs(kz + fz), abs(ky + fy), abs(kx + fx)) > 2 THEN 4 ELSE 0 END AS st FROM grid LEFT JOIN sv USING (poi)),
ff AS (SELECT *, st = 0 AS ok FROM f0), {outliers('ff', 'ok')},
fs AS (SELECT *, CASE WHEN ok AND coalesce(residual > 2, false) THEN 2 ELSE st END AS s FROM ol),
fld AS (SELECT pair_id, own AS poi, iz % 1000 AS iz, iy, ix, s AS status, s = 0 AS valid, {zero} FROM fs),
mn AS (SELECT pair_id, count(*) FILTER (WHERE valid) AS n_ok, {', '.join(f'avg(CAST(d{a} AS DOUBLE)) FILTER (WHERE valid) AS mean_d{a}' for a in 'zyx')} FROM fld GROUP BY pair_id)
SELECT pair_id, poi, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('iz', 'iy', 'ix', 'status', 'n_ok'))}, valid, {', '.join(real(c) for c in ('dz', 'dy', 'dx', 'confidence', 'mean_dz', 'mean_dy', 'mean_dx'))} FROM fld JOIN mn USING (pair_id)
"""


def queries() -> dict:
    return {"job1_run_logs": job1_run_logs, "job2_frame_fields": job2_frame_fields}


def oracle_sql() -> dict[str, str]:
    return {"job1_run_logs": JOB1, "job2_frame_fields": _job2()}
