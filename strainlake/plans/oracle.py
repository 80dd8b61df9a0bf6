"""The engine's queries as SQL for DuckDB, written apart from the DataFrame plans."""

from __future__ import annotations

from math import exp, pi

CUBE = """agg AS (SELECT CAST((12 * year(l_shipdate) + month(l_shipdate)) % 16 AS INT) AS z, CAST(l_suppkey % 32 AS INT) AS y, CAST(l_partkey % 32 AS INT) AS x,
 CAST(sum(l_quantity) AS DOUBLE) AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY 1, 2, 3),
cells AS (SELECT CAST(i // 1024 AS INT) AS z, CAST((i // 32) % 32 AS INT) AS y, CAST(i % 32 AS INT) AS x FROM range(16384) t(i)),
cube AS (SELECT cells.z, cells.y, cells.x, coalesce(v, CAST(0 AS DOUBLE)) AS value, coalesce(c, 0) > 0 AS m FROM cells LEFT JOIN agg USING (z, y, x))"""
GRID = """grid AS (SELECT i AS poi, i // 49 AS iz, (i // 7) % 7 AS iy, i % 7 AS ix, 4 * (i // 49) AS z0, 4 * ((i // 7) % 7) AS y0, 4 * (i % 7) AS x0 FROM range(147) t(i))"""
WIN = f"""{CUBE}, {GRID}, win AS (SELECT poi, z - z0 AS jz, y - y0 AS jy, x - x0 AS jx, value, m FROM grid JOIN cube ON z >= z0 AND z < z0 + 8 AND y >= y0 AND y < y0 + 8 AND x >= x0 AND x < x0 + 8)"""
EVENTS = """f0 AS (SELECT day(ts) - 1 AS iz, hour(ts) AS iy, user_id % 5 AS ix, avg(value) AS dz, max(value) AS dy, min(value) AS dx, count(*) AS n FROM events GROUP BY 1, 2, 3),
tr AS (SELECT iy, ix, avg(dz) AS tz, avg(dy) AS ty, avg(dx) AS tx FROM f0 GROUP BY 1, 2),
f AS (SELECT (iz * 24 + iy) * 5 + ix AS poi, iz, iy, ix, dz, dy, dx, tz, ty, tx, n >= 2 AS valid, CAST(n AS DOUBLE) AS confidence FROM f0 JOIN tr USING (iy, ix))"""
ERR = f"""{EVENTS}, er AS (SELECT *, dz - tz AS ez, dy - ty AS ey, dx - tx AS ex, sqrt((dz - tz) * (dz - tz) + (dy - ty) * (dy - ty) + (dx - tx) * (dx - tx)) AS norm FROM f)"""

#: Triangles at 120.5 of the tetrahedra of v(z, y, x, value), scaled by s(sz, sy, sx): an inside corner's edges, or the halves of a ring of four.
MARCH = """paths(p1, p2, p3) AS (VALUES (4, 2, 1), (4, 1, 2), (2, 4, 1), (2, 1, 4), (1, 4, 2), (1, 2, 4)),
tet AS (SELECT row_number() OVER () AS tet, unnest([0, 1, 2, 3]) AS i, unnest([0, p1, p1 + p2, 7]) AS o FROM paths),
cell AS (SELECT z, y, x FROM v WHERE z < 15 AND y < 31 AND x < 31),
corner AS (SELECT c.z, c.y, c.x, tet, i, o, v.value, v.z AS vz, v.y AS vy, v.x AS vx FROM cell c, tet JOIN v ON v.z = c.z + o // 4 AND v.y = c.y + o // 2 % 2 AND v.x = c.x + o % 2),
place AS (SELECT *, value > 120.5 AS up, row_number() OVER (PARTITION BY z, y, x, tet, value > 120.5 ORDER BY i) AS nth, sum(CASE WHEN value > 120.5 THEN 1 ELSE 0 END) OVER (PARTITION BY z, y, x, tet) AS ups FROM corner),
cross_ AS (SELECT a.z, a.y, a.x, a.tet, a.ups, a.nth AS ni, b.nth AS nj, ((least(a.vz, b.vz) * 32 + least(a.vy, b.vy)) * 32 + least(a.vx, b.vx)) * 8 + abs(a.o - b.o) AS id,
 sz * (a.vz + (b.vz - a.vz) * (120.5 - a.value) / (b.value - a.value)) AS pz, sy * (a.vy + (b.vy - a.vy) * (120.5 - a.value) / (b.value - a.value)) AS py, sx * (a.vx + (b.vx - a.vx) * (120.5 - a.value) / (b.value - a.value)) AS px
 FROM place a JOIN place b ON a.z = b.z AND a.y = b.y AND a.x = b.x AND a.tet = b.tet AND a.up AND NOT b.up, s),
half AS (SELECT *, unnest(CASE WHEN ups <> 2 THEN [0] WHEN ni = 2 AND nj = 1 THEN [2] WHEN ni = 1 AND nj = 2 THEN [1] ELSE [1, 2] END) AS h FROM cross_),
tri AS (SELECT z, y, x, tet, h, list(id ORDER BY id) AS ids, list(pz ORDER BY id) AS z3, list(py ORDER BY id) AS y3, list(px ORDER BY id) AS x3 FROM half GROUP BY ALL),
tris AS (SELECT *, sqrt(pow((y3[2] - y3[1]) * (x3[3] - x3[1]) - (x3[2] - x3[1]) * (y3[3] - y3[1]), 2) + pow((x3[2] - x3[1]) * (z3[3] - z3[1]) - (z3[2] - z3[1]) * (x3[3] - x3[1]), 2) + pow((z3[2] - z3[1]) * (y3[3] - y3[1]) - (y3[2] - y3[1]) * (z3[3] - z3[1]), 2)) / 2 AS area FROM tri)"""


def r(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {name}"


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def tukey(i: str, n: int, a: float) -> str:
    """The taper by its published three-part definition over i / (n - 1)."""
    if n == 1 or a == 0:
        return "CAST(1 AS DOUBLE)"
    x, c = f"(CAST({i} AS DOUBLE) / {n - 1})", f"CAST({2 * pi / a!r} AS DOUBLE)"
    return f"(CASE WHEN {x} > CAST({1 - a / 2} AS DOUBLE) THEN 0.5e0 * (1 + cos({c} * ({x} - 1 + CAST({a / 2} AS DOUBLE)))) WHEN {x} >= CAST({a / 2} AS DOUBLE) THEN 1e0 ELSE 0.5e0 * (1 + cos({c} * ({x} - CAST({a / 2} AS DOUBLE)))) END)"


VEC = """e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings),
w0 AS (SELECT a.vec_id AS poi, a.i // 16 AS jz, (a.i // 4) % 4 AS jy, a.i % 4 AS jx, CAST(a.v AS DOUBLE) AS r0, CAST(b.v AS DOUBLE) AS d0 FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND b.i = a.i),
w AS (SELECT poi, jz, jy, jx, r0 - sum(r0) OVER p / 64 AS r, d0 - sum(d0) OVER p / 64 AS d FROM w0 WINDOW p AS (PARTITION BY poi))"""


def corr(mode: str, norm: str, exact: bool = False) -> str:
    wrap = lambda a: f"(({a} + 2 + 4) % 4 - 2)" if mode == "cyclic" else a
    lags = ", ".join(f"{wrap(f'(b.j{a} - a.j{a})')} AS k{a}" for a in "zyx")
    lag = f"{VEC}, p AS (SELECT a.poi, {lags}, a.r, b.d FROM w a JOIN w b USING (poi)), g AS (SELECT poi, kz, ky, kx, sum(r * d) AS rd, sum(r * r) AS rr, sum(d * d) AS dd FROM p WHERE kz BETWEEN -2 AND 1 AND ky BETWEEN -2 AND 1 AND kx BETWEEN -2 AND 1 GROUP BY ALL)"
    if norm == "overlap":
        return f"{lag}, c AS (SELECT poi, kz, ky, kx, rd / sqrt(greatest(rr, 0) * greatest(dd, 0) + 1e-12) AS ncc FROM g)"
    value = "rd / sqrt(r2 * d2 + 1e-12)" if exact else "round(rd / sqrt(r2 * d2 + 1e-12), 9)"
    return f"{lag}, en AS (SELECT poi, sum(r * r) AS r2, sum(d * d) AS d2 FROM w GROUP BY poi), c AS (SELECT poi, kz, ky, kx, {value} AS ncc FROM g JOIN en USING (poi))"


def fit(w: int) -> str:
    """After c(poi, kz, ky, kx, ncc): pk (peaks), nb (neighbours) and sv (refined)."""
    h = w // 2
    mod = lambda e: f"(({e}) + {2 * w}) % {w}"
    cols = []
    for a in "zyx":
        same = " AND ".join(f"{mod(f'c.k{o} - pk.k{o}')} = 0" for o in "zyx" if o != a)
        cols += [f"max(ncc) FILTER (WHERE {same} AND {mod(f'c.k{a} - pk.k{a}')} = {s}) AS {n}{a}" for n, s in (("m", w - 1), ("n", 1))]
    pos = lambda a: f"(m{a} > 0 AND confidence > 0 AND n{a} > 0)"
    ln = lambda x, a: f"ln(CASE WHEN {pos(a)} THEN {x} ELSE 1 END)"

    def vertex(m, z, p):
        den = f"(2 * ({m} - 2 * {z} + {p}))"
        return f"(({m}) - ({p})) / (CASE WHEN abs({den}) < 1e-12 THEN 1e-12 ELSE {den} END)"

    f = lambda a: f"greatest(-0.5e0, least(0.5e0, CASE WHEN {pos(a)} THEN {vertex(ln(f'm{a}', a), ln('confidence', a), ln(f'n{a}', a))} ELSE {vertex(f'm{a}', 'confidence', f'n{a}')} END))"
    return f"""pk AS (SELECT poi, kz, ky, kx, ncc AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY poi ORDER BY ncc DESC, ({mod('kz')}) * {w * w} + ({mod('ky')}) * {w} + {mod('kx')}) AS k FROM c) WHERE k = 1),
nb AS (SELECT pk.poi, {', '.join(cols)} FROM c JOIN pk USING (poi) GROUP BY pk.poi),
sv AS (SELECT pk.poi, kz, ky, kx, confidence, {', '.join(f'{f(a)} AS f{a}' for a in 'zyx')} FROM pk JOIN nb USING (poi))"""


def outliers(field: str, valid: str = "valid") -> str:
    """After field(iz, iy, ix, dz, dy, dx, valid): ol with n_neighbors and residual."""
    near = f"nr AS (SELECT a.iz, a.iy, a.ix, b.dz AS bz, b.dy AS by_, b.dx AS bx FROM {field} a JOIN {field} b ON abs(a.iz - b.iz) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 1 AND (a.iz, a.iy, a.ix) <> (b.iz, b.iy, b.ix) WHERE b.{valid})"
    return f"""{near}, md AS (SELECT iz, iy, ix, count(*) AS n_neighbors, median(bz) AS mz, median(by_) AS my, median(bx) AS mx FROM nr GROUP BY ALL),
sp AS (SELECT iz, iy, ix, median(abs(bz - mz)) AS sz, median(abs(by_ - my)) AS sy, median(abs(bx - mx)) AS sx FROM nr JOIN md USING (iz, iy, ix) GROUP BY ALL),
ol AS (SELECT t.*, coalesce(n_neighbors, 0) AS n_neighbors, CASE WHEN t.{valid} AND n_neighbors >= 4 THEN greatest(abs(dz - mz) / (sz + 0.1e0), abs(dy - my) / (sy + 0.1e0), abs(dx - mx) / (sx + 0.1e0)) END AS residual FROM {field} t LEFT JOIN md USING (iz, iy, ix) LEFT JOIN sp USING (iz, iy, ix))"""


def field_sql(cyclic: bool = False, threshold: str = "0.5") -> str:
    """fld: the field of the cube against its rolled copy, by overlapping windows or by cyclic ones with a taper."""
    taper = " * " + " * ".join(tukey(f"j{a}", 8, 0.25) for a in "zyx") if cyclic else ""
    lag = (lambda a: f"(b.j{a} - a.j{a} + 12) % 8 - 4") if cyclic else (lambda a: f"b.j{a} - a.j{a}")
    energy = "r2 * d2" if cyclic else "greatest(rr, 0) * greatest(dd, 0)"
    en = "en AS (SELECT poi, sum(r * r) AS r2, sum(d * d) AS d2 FROM pr GROUP BY poi), " if cyclic else ""
    return f"""{WIN}, roll AS (SELECT (z + 1) % 16 AS z, (y + 30) % 32 AS y, (x + 1) % 32 AS x, value AS dv FROM cube),
adm AS (SELECT poi, avg(CASE WHEN m THEN 1e0 ELSE 0e0 END) AS fraction FROM win GROUP BY poi),
pr0 AS (SELECT poi, jz, jy, jx, value AS r0, dv AS d0, CASE WHEN m THEN 1e0 ELSE 0e0 END AS mm FROM win JOIN grid USING (poi) JOIN roll ON roll.z = jz + z0 AND roll.y = jy + y0 AND roll.x = jx + x0 JOIN adm USING (poi) WHERE fraction >= {threshold}),
pr AS (SELECT poi, jz, jy, jx, (r0 - sum(r0 * mm) OVER p / greatest(sum(mm) OVER p, 1)) * mm{taper} AS r, (d0 - sum(d0 * mm) OVER p / greatest(sum(mm) OVER p, 1)) * mm{taper} AS d FROM pr0 WINDOW p AS (PARTITION BY poi)),
l AS (SELECT poi, {', '.join(f'{lag(a)} AS k{a}' for a in 'zyx')}, a.r, b.d FROM pr a JOIN pr b USING (poi)),
g AS (SELECT poi, kz, ky, kx, sum(r * d) AS rd, sum(r * r) AS rr, sum(d * d) AS dd FROM l WHERE kz BETWEEN -4 AND 3 AND ky BETWEEN -4 AND 3 AND kx BETWEEN -4 AND 3 GROUP BY ALL),
{en}c AS (SELECT poi, kz, ky, kx, round(rd / sqrt({energy} + 1e-12), 9) AS ncc FROM g{' JOIN en USING (poi)' if cyclic else ''}), {fit(8)},
ff0 AS (SELECT grid.poi, iz, iy, ix, kz + fz AS dz, ky + fy AS dy, kx + fx AS dx, confidence, CASE WHEN sv.poi IS NULL THEN 1 WHEN greatest(abs(kz + fz), abs(ky + fy), abs(kx + fx)) > 4 THEN 4 ELSE 0 END AS st FROM grid LEFT JOIN sv USING (poi)),
ff AS (SELECT *, st = 0 AS ok FROM ff0), {outliers('ff', 'ok')},
fld AS (SELECT poi, iz, iy, ix, z_ AS pz, y_ AS py, x_ AS px, CASE WHEN s = 0 THEN dz ELSE 0 END AS dz, CASE WHEN s = 0 THEN dy ELSE 0 END AS dy, CASE WHEN s = 0 THEN dx ELSE 0 END AS dx, s = 0 AS valid, CASE WHEN s = 0 THEN confidence ELSE 0 END AS confidence, s AS status
 FROM (SELECT ol.*, z0 + 3.5e0 AS z_, y0 + 3.5e0 AS y_, x0 + 3.5e0 AS x_, CASE WHEN ok AND coalesce(residual > 2, false) THEN 2 ELSE st END AS s FROM ol JOIN (SELECT poi, z0, y0, x0 FROM grid) USING (poi)))"""


FIELD, FIELD_CYCLIC = field_sql(), field_sql(True)
REPORT = """count(*) AS n_total, count(*) FILTER (WHERE valid) AS n_valid, {mae}, {rmse}, {p95}, {mz}, {my}, {mx}""".format(
    mae=r("avg((abs(ez) + abs(ey) + abs(ex)) / 3) FILTER (WHERE valid)", "mae"), rmse=r("sqrt(avg((ez * ez + ey * ey + ex * ex) / 3) FILTER (WHERE valid))", "rmse"), p95=r("quantile_cont(norm, 0.95) FILTER (WHERE valid)", "p95"),
    mz=r("avg(abs(ez)) FILTER (WHERE valid)", "mae_z"), my=r("avg(abs(ey)) FILTER (WHERE valid)", "mae_y"), mx=r("avg(abs(ex)) FILTER (WHERE valid)", "mae_x"),
)
DIST = f"""{EVENTS}, so AS (SELECT iz, iy, ix FROM f WHERE confidence >= 4),
ds AS (SELECT f.*, (SELECT min(sqrt(CAST(power(f.iz - so.iz, 2) + power(f.iy - so.iy, 2) + power(f.ix - so.ix, 2) AS DOUBLE))) FROM so) AS distance FROM f)"""
VOLS = f"""{CUBE}, vol AS (SELECT 'reference' AS volume_id, value FROM cube UNION ALL SELECT 'deformed', value FROM cube)"""
MIRROR = lambda i, n: f"(CASE WHEN (({i}) + {2 * n}) % {2 * n} >= {n} THEN {2 * n - 1} - (({i}) + {2 * n}) % {2 * n} ELSE (({i}) + {2 * n}) % {2 * n} END)"
U = ("(y % 3 - 1)", "(x % 5 - 2)", "(z % 2)")


def warp(src: str, sign: str, name: str) -> str:
    at = ", ".join(f"{MIRROR(f'{a} {sign} {u}', n)} AS r{a}" for a, u, n in zip("zyx", U, (16, 32, 32), strict=True))
    return f"{name} AS (SELECT q.z, q.y, q.x, s.value FROM (SELECT z, y, x, {at} FROM cube) q JOIN {src} s ON s.z = rz AND s.y = ry AND s.x = rx)"


def linear(points: str, keys: str) -> str:
    """After points(keys, pz, py, px): li, the cube between its voxels, mirrored at its faces."""
    corner = ", ".join(f"{MIRROR(f'CAST(floor(p{a}) AS BIGINT) + e{a}', n)} AS r{a}" for a, n in zip("zyx", (16, 32, 32), strict=True))
    weight = " * ".join(f"(CASE WHEN e{a} = 1 THEN p{a} - floor(p{a}) ELSE 1 - (p{a} - floor(p{a})) END)" for a in "zyx")
    bits = ", ".join(f"(SELECT unnest([0, 1]) AS e{a}) t{a}" for a in "zyx")
    return f"cr AS (SELECT {keys}, {corner}, {weight} AS w FROM {points}, {bits}), li AS (SELECT {', '.join(f'cr.{k}' for k in keys.split(', '))}, sum(w * cube.value) AS value FROM cr JOIN cube ON cube.z = rz AND cube.y = ry AND cube.x = rx GROUP BY ALL)"


POINTS = "p AS (SELECT o_orderkey AS poi, o_orderkey % 157 * 0.1e0 AS pz, o_custkey % 317 * 0.1e0 AS py, (o_orderkey * 7 + o_custkey) % 313 * 0.1e0 AS px FROM orders)"


def analytic(dz: str, dy: str, dx: str) -> str:
    return f"WITH {POINTS} SELECT poi, {r('pz', 'pz')}, {r('py', 'py')}, {r('px', 'px')}, {r(f'CAST({dz} AS FLOAT)', 'dz')}, {r(f'CAST({dy} AS FLOAT)', 'dy')}, {r(f'CAST({dx} AS FLOAT)', 'dx')} FROM p"


SCANS = """scans AS (SELECT p_partkey AS scan, p_size + 6 AS nz, p_size % 7 + 8 AS ny, p_size % 5 + 5 AS nx, p_partkey % 5 + 1 AS shards, p_size % 3 AS margin, CASE p_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 2 END AS s FROM part),
counts AS (SELECT *, (nz - 6) // s + 1 AS cz, (ny - 6) // s + 1 AS cy, (nx - 6) // s + 1 AS cx FROM scans WHERE nz >= 6 AND ny >= 6 AND nx >= 6),
lat AS (SELECT *, (iz * cy + iy) * cx + ix AS poi, iz * s AS z0, iy * s AS y0, ix * s AS x0 FROM (SELECT *, unnest(range(cx)) AS ix FROM (SELECT *, unnest(range(cy)) AS iy FROM (SELECT *, unnest(range(cz)) AS iz FROM counts))))"""


def tukey_rows(i: str, n: str, a: str) -> str:
    """The taper by its three-part definition, length and alpha as columns."""
    x, turn = f"({i} / ({n} - 1e0))", f"(2 * pi() / {a})"
    return f"(CASE WHEN {n} = 1 OR {a} = 0 THEN 1e0 WHEN {x} > 1 - {a} / 2 THEN 0.5e0 * (1 + cos({turn} * ({x} - 1 + {a} / 2))) WHEN {x} >= {a} / 2 THEN 1e0 ELSE 0.5e0 * (1 + cos({turn} * ({x} - {a} / 2))) END)"


def gaussian(src: str, out: str, sigma: float) -> str:
    """out: src smoothed along z, y and x, mirrored at its faces, four deviations wide."""
    reach = int(4 * sigma + 0.5)
    raw = [exp(-0.5 * (o / sigma) ** 2) for o in range(-reach, reach + 1)]
    ctes = [f"{out}k AS (SELECT unnest(range({-reach}, {reach + 1})) AS o, unnest([{', '.join(f'CAST({w / sum(raw)!r} AS DOUBLE)' for w in raw)}]) AS w)"]
    for step, (a, n) in enumerate(zip("zyx", (16, 32, 32), strict=True)):
        before, after = src if step == 0 else f"{out}{step}", out if step == 2 else f"{out}{step + 1}"
        same = " AND ".join(f"b.{o} = a.{o}" for o in "zyx" if o != a)
        ctes.append(f"{after} AS (SELECT a.z, a.y, a.x, sum(k.w * b.value) AS value FROM {before} a CROSS JOIN {out}k k JOIN {before} b ON b.{a} = {MIRROR(f'(a.{a} + k.o)', n)} AND {same} GROUP BY a.z, a.y, a.x)")
    return ", ".join(ctes)


VARIANTS = """pts AS (SELECT 8 * (r_regionkey + 1) AS "window", n_nationkey * 4 AS threshold, 'w' || CAST(8 * (r_regionkey + 1) AS VARCHAR) || '-mt' || CAST(n_nationkey * 4 AS VARCHAR) AS name, 8000 * (r_regionkey + 1) + n_nationkey * 4 AS place, 0 AS part FROM region, nation
 UNION ALL SELECT 8 * (1 + 2 * r_regionkey), 50, 'own' || CAST(r_regionkey AS VARCHAR), r_regionkey, 1 FROM region),
hs AS (SELECT *, substr(sha256('{"threshold": ' || CAST(threshold AS VARCHAR) || ', "window": ' || CAST("window" AS VARCHAR) || '}'), 1, 8) AS params_hash FROM pts),
va AS (SELECT CAST("window" AS BIGINT) AS "window", CAST(threshold AS BIGINT) AS threshold, name, params_hash, name || '-' || params_hash AS variant_id FROM (SELECT *, row_number() OVER (PARTITION BY params_hash ORDER BY part, place) AS k FROM hs) WHERE k = 1)"""
LATEST = """la AS (SELECT * FROM (SELECT o_orderpriority AS store, CAST(o_custkey AS VARCHAR) AS variant_id, o_orderkey AS row_id, o_totalprice AS mae, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1)"""
RAD = {"imp": "(power(z - 8e0, 2) + power(y - 16e0, 2)) <= 9", "hole": "(power(z - 10e0, 2) + power(y - 12e0, 2) + power(x - 20e0, 2)) <= 9", "r2": "(power(y - 16e0, 2) + power(x - 16e0, 2))"}


def sql() -> dict[str, str]:
    ncc_out = f"SELECT poi, {big('kz', 'ky', 'kx')}, {r('ncc', 'ncc')} FROM c"
    out = {
        "lattice_grid": f"WITH {SCANS} SELECT scan, {big('poi', 'iz', 'iy', 'ix', 'z0', 'y0', 'x0')}, {r('z0 + 2.5', 'pz')}, {r('y0 + 2.5', 'py')}, {r('x0 + 2.5', 'px')} FROM lat",
        "stride_overlap": f"SELECT CAST(w AS BIGINT) AS w, {r('o', 'o')}, CAST(greatest(1, round_even(w * (1 - o), 0)) AS BIGINT) AS stride FROM (SELECT DISTINCT p_size AS w FROM part), (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0]) AS o)",
        "integral_image": f"WITH {CUBE}, a AS (SELECT z, y, x, sum(CAST(m AS INT)) OVER (PARTITION BY y, x ORDER BY z) AS s FROM cube), b AS (SELECT z, y, x, sum(s) OVER (PARTITION BY z, x ORDER BY y) AS s FROM a) SELECT {big('z', 'y', 'x')}, CAST(sum(s) OVER (PARTITION BY z, y ORDER BY x) AS BIGINT) AS sat FROM b",
        "box_sums": f"WITH {WIN} SELECT poi, CAST(sum(CAST(m AS INT)) AS BIGINT) AS total FROM win GROUP BY poi",
        "box_sum_admission": f"WITH {WIN}, a AS (SELECT poi, sum(CAST(m AS INT)) / 512e0 AS fraction FROM win GROUP BY poi) SELECT poi, {r('fraction', 'fraction')}, fraction >= 0.6e0 AS admitted FROM a",
        "zslab_shards": f"WITH {SCANS} SELECT scan, {big('poi', 'shards')}, CAST((SELECT min(k) FROM (SELECT k, sum(cz // shards + CASE WHEN k < cz % shards THEN 1 ELSE 0 END) OVER (ORDER BY k) AS upto FROM range(shards) t(k)) WHERE iz < upto) AS BIGINT) AS slab FROM lat",
        "interior_points": f"WITH {SCANS} SELECT scan, CAST(poi AS BIGINT) AS poi FROM lat WHERE least(z0, y0, x0) >= margin AND z0 + 6 <= nz - margin AND y0 + 6 <= ny - margin AND x0 + 6 <= nx - margin",
        "extract_windows": f"WITH {WIN} SELECT poi, {big('jz', 'jy', 'jx')}, {r('value', 'value')} FROM win",
        "center_crop": f"WITH {CUBE} SELECT CAST(z - 4 AS BIGINT) AS z, CAST(y - 8 AS BIGINT) AS y, CAST(x - 8 AS BIGINT) AS x, {r('value', 'value')} FROM cube WHERE z BETWEEN 4 AND 10 AND y BETWEEN 8 AND 23 AND x BETWEEN 8 AND 22",
        "tukey_1d": f"SELECT scan, {big('n')}, {r('alpha', 'alpha')}, {big('i')}, {r(tukey_rows('i', 'n', 'alpha'), 'w')} FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT p_partkey AS scan, p_size AS n, p_partkey % 5 / 4e0 AS alpha FROM part))",
        "tukey_3d": f"SELECT scan, {big('jz', 'jy', 'jx')}, {r(' * '.join(tukey_rows(f'j{a}', f'n{a}', 'alpha') for a in 'zyx'), 'w')} FROM (SELECT *, unnest(range(nx)) AS jx FROM (SELECT *, unnest(range(ny)) AS jy FROM (SELECT *, unnest(range(nz)) AS jz FROM (SELECT p_partkey AS scan, p_partkey % 3 / 2e0 AS alpha, p_size % 3 + 1 AS nz, p_size % 5 + 1 AS ny, p_size % 7 + 1 AS nx FROM part))))",
        "preprocess_masked": f"WITH {WIN}, q AS (SELECT *, sum(CASE WHEN m THEN value ELSE 0 END) OVER p / greatest(count(*) FILTER (WHERE m) OVER p, 1) AS mean FROM win WINDOW p AS (PARTITION BY poi)) SELECT poi, {big('jz', 'jy', 'jx')}, {r('CASE WHEN m THEN (value - mean) * ' + ' * '.join(tukey(f'j{a}', 8, 0.25) for a in 'zyx') + ' ELSE 0 END', 'value')} FROM q",
        "preprocess_unmasked": f"WITH {WIN} SELECT poi, {big('jz', 'jy', 'jx')}, {r('value - avg(value) OVER (PARTITION BY poi)', 'value')} FROM win",
        "ncc_cyclic": f"WITH {corr('cyclic', 'global', True)} {ncc_out}",
        "ncc_linear_global": f"WITH {corr('linear', 'global', True)} {ncc_out}",
        "ncc_linear_overlap": f"WITH {corr('linear', 'overlap')} {ncc_out}",
        "integer_peak": f"WITH {corr('cyclic', 'global')}, {fit(4)} SELECT poi, {big('kz', 'ky', 'kx')}, {r('confidence', 'confidence')} FROM pk",
        "peak_neighbors": f"WITH {corr('cyclic', 'global')}, {fit(4)} SELECT poi, {big('kz', 'ky', 'kx')}, {r('confidence', 'confidence')}, {', '.join(r(f'{k}{a}', f'{k}{a}') for a in 'zyx' for k in 'mn')} FROM pk JOIN nb USING (poi)",
        "subvoxel_fit": f"WITH {corr('linear', 'global')}, {fit(4)} SELECT poi, {big('kz', 'ky', 'kx')}, {', '.join(r(f'f{a}', f'f{a}') for a in 'zyx')}, {', '.join(r(f'k{a} + f{a}', f'd{a}') for a in 'zyx')}, {r('confidence', 'confidence')} FROM sv",
        "search_radius_gate": f"WITH {corr('cyclic', 'global')}, {fit(4)} SELECT poi, {', '.join(r(f'k{a} + f{a}', f'd{a}') for a in 'zyx')}, greatest(abs(kz + fz), abs(ky + fy), abs(kx + fx)) <= 1 AS in_range FROM sv",
        "normalized_median_outlier": f"WITH {EVENTS}, {outliers('f')} SELECT poi, {r('residual', 'residual')}, coalesce(residual > 2, false) AS outlier FROM ol",
        "neighbor_count": f"WITH {EVENTS}, {outliers('f')} SELECT poi, CAST(n_neighbors AS BIGINT) AS n_neighbors FROM ol",
        "displacement_field": f"WITH {FIELD} SELECT poi, iz, iy, ix, pz, py, px, {', '.join(r(f'CAST({c} AS FLOAT)', c) for c in ('dz', 'dy', 'dx', 'confidence'))}, valid, CAST(status AS BIGINT) AS status FROM fld",
        "status_summary": f"WITH {FIELD} SELECT count(*) AS n_total, " + ", ".join(f"count(*) FILTER (WHERE status = {i}) AS n_{k}" for i, k in enumerate(("ok", "masked", "outlier", "low_conf", "out_of_range"))) + " FROM fld",
        "field_error_report": f"WITH {FIELD}, er AS (SELECT valid, ez, ey, ex, sqrt(ez * ez + ey * ey + ex * ex) AS norm FROM (SELECT valid, CAST(CAST(dz AS FLOAT) AS DOUBLE) - 1 AS ez, CAST(CAST(dy AS FLOAT) AS DOUBLE) + 2 AS ey, CAST(CAST(dx AS FLOAT) AS DOUBLE) - 1 AS ex FROM fld)) SELECT {REPORT} FROM er",
        "error_report": f"WITH {ERR} SELECT {REPORT} FROM er",
        "sweep_reports": f"WITH {ERR} SELECT 'u' || CAST(ix AS VARCHAR) AS entry, {REPORT} FROM er GROUP BY ix",
        "average_ranks": f"WITH {EVENTS} SELECT poi, {r('rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2', 'rank')} FROM f",
        "spearman": f"WITH {ERR}, v AS (SELECT rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2e0 AS a, rank() OVER (ORDER BY norm) + (count(*) OVER (PARTITION BY norm) - 1) / 2e0 AS b FROM er WHERE valid) SELECT {r('corr(a, b)', 'rho')} FROM v",
        "distance_to_valid": f"WITH {DIST} SELECT poi, {r('distance', 'distance')} FROM ds",
        "boundary_strata": f"WITH {DIST}, b AS (SELECT CASE WHEN distance > 40 THEN 4 WHEN distance > 3 THEN 3 WHEN distance > 1.5 THEN 2 WHEN distance > 1 THEN 1 ELSE 0 END AS bin, abs(dz - tz) + abs(dy - ty) + abs(dx - tx) AS a, power(dz - tz, 2) + power(dy - ty, 2) + power(dx - tx, 2) AS q FROM ds WHERE valid), bins AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin, unnest([0e0, 1e0, 1.5e0, 3e0, 40e0]) AS edge) SELECT CAST(bin AS BIGINT) AS bin, edge, count(a) AS n, {r('avg(a / 3)', 'mae')}, {r('sqrt(avg(q / 3))', 'rmse')} FROM bins LEFT JOIN b USING (bin) GROUP BY bin, edge",
        "intensity_stats": f"WITH {VOLS} SELECT volume_id, count(*) AS n, {r('avg(value)', 'mean')}, {r('min(value)', 'min')}, {r('max(value)', 'max')} FROM vol GROUP BY 1",
        "mask_stats": f"WITH {CUBE} SELECT 'z' || CAST(z // 8 AS VARCHAR) AS mask_id, count(*) FILTER (WHERE m) AS foreground, count(*) FILTER (WHERE NOT m) AS background, {r('avg(CAST(m AS INT))', 'fraction')} FROM cube GROUP BY 1",
        "displacement_stats": f"WITH {EVENTS}, q AS (SELECT *, sqrt(dz * dz + dy * dy + dx * dx) AS u FROM f) SELECT 'u' || CAST(ix AS VARCHAR) AS entry, count(*) AS n, {r('avg(u)', 'mean_u')}, {r('max(u)', 'max_u')}, {', '.join(r(f'avg(d{a})', f'mean_{a}') + ', ' + r(f'max(abs(d{a}))', f'max_{a}') for a in 'zyx')} FROM q GROUP BY ix",
        "histogram_median": f"""WITH {VOLS}, v AS (FROM vol UNION ALL SELECT 'constant', 3e0 FROM cube WHERE z = 0), x AS (SELECT volume_id, min(value) AS lo, max(value) AS hi, count(*) AS total FROM v GROUP BY 1),
b AS (SELECT volume_id, lo, hi, total, least(floor((value - lo) / (hi - lo) * 64), 63) AS b, count(*) AS c FROM v JOIN x USING (volume_id) WHERE hi > lo GROUP BY ALL), s AS (SELECT *, sum(c) OVER (PARTITION BY volume_id ORDER BY b) AS upto FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY b) AS k FROM s WHERE upto >= total / 2e0)
SELECT volume_id, {r('lo + (b + (total / 2e0 - (upto - c)) / c) * ((hi - lo) / 64)', 'median')} FROM k WHERE k = 1 UNION ALL SELECT volume_id, lo FROM x WHERE hi = lo""",
        "exact_median": f"WITH {VOLS} SELECT volume_id, {r('median(value)', 'median')} FROM vol GROUP BY 1",
        "warp_integer": f"WITH {CUBE}, {warp('cube', '-', 'w')} SELECT {big('z', 'y', 'x')}, {r('value', 'value')} FROM w",
        "warp_linear": f"WITH {CUBE}, pt AS (SELECT z, y, x, z - 0.5e0 AS pz, y + 1.25e0 AS py, x - 0.75e0 AS px FROM cube), {linear('pt', 'z, y, x')} SELECT {big('z', 'y', 'x')}, {r('CAST(value AS FLOAT)', 'value')} FROM li",
        "field_linear": f"WITH {CUBE}, pt AS (SELECT o_orderkey AS poi, (o_orderkey % 173) * 0.1e0 - 0.6e0 AS pz, (o_custkey % 337) * 0.1e0 - 0.8e0 AS py, ((o_orderkey * 7 + o_custkey) % 333) * 0.1e0 - 0.7e0 AS px FROM orders), {linear('pt', 'poi')} SELECT poi, {r('value', 'value')} FROM li",
        "flow_convention_check": f"WITH {CUBE}, {warp('cube', '-', 'a')}, {warp('cube', '+', 'b')}, m AS (SELECT avg(power(a.value - b.value, 2)) AS p, avg(power(b.value - b.value, 2)) AS q FROM a JOIN b USING (z, y, x)) SELECT {r('p', 'mse_pull_back')}, {r('q', 'mse_push_forward')}, CASE WHEN p <= q THEN 'pull_back' ELSE 'push_forward' END AS convention FROM m",
        "field_rigid": analytic("1.5", "-2.25", "0.5"),
        "field_dilation": analytic("0.01e0 * (pz - 8)", "0.01e0 * (py - 16)", "0.01e0 * (px - 16)"),
        "field_shear": analytic("0.02e0 * (px - 16)", "0", "0"),
        "field_sinusoid": analytic(f"sin(CAST({2 * pi!r} AS DOUBLE) * pz / 16)", f"0.5e0 * sin(CAST({2 * pi!r} AS DOUBLE) * py / 32 + 0.5e0)", f"2e0 * sin(CAST({2 * pi!r} AS DOUBLE) * px / 24 + 1)"),
        "field_compose": analytic("1 + 0.01e0 * (pz - 8)", "0.01e0 * (py - 16) + 0.02e0 * pz", "-1 + 0.01e0 * (px - 16)"),
        "phantom_scaffold": f"WITH {CUBE} SELECT {big('z', 'y', 'x')}, CASE WHEN {RAD['imp']} THEN 1.2e0 WHEN {RAD['hole']} THEN 0.05e0 WHEN {RAD['r2']} BETWEEN 81 AND 144 THEN 0.9e0 WHEN {RAD['r2']} <= 81 AND m THEN 0.55e0 ELSE 0.05e0 END AS intensity FROM cube",
        "trabecular_quantile": f"WITH {CUBE} SELECT {big('z', 'y', 'x')}, value > (SELECT quantile_cont(value, 0.7e0) FROM cube) AS strut FROM cube",
        "sweep_expand": f"WITH {VARIANTS} SELECT * FROM va",
        "params_hash": """SELECT p_partkey, substr(sha256('{"p_partkey": ' || CAST(p_partkey AS VARCHAR) || ', "p_size": ' || CAST(p_size AS VARCHAR) || '}'), 1, 8) AS params_hash FROM part""",
        "resume_pending": f"WITH {VARIANTS} SELECT 's' AS store, n_name AS deformation, variant_id, params_hash FROM nation, va WHERE NOT ((n_nationkey + \"window\") % 3 = 0 AND n_nationkey % 2 = 0)",
        "select_entries": "SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS kind FROM customer WHERE c_acctbal > 5000",
        "latest_manifest": f"WITH {LATEST} SELECT store, variant_id, row_id, {r('mae', 'mae')} FROM la",
        "best_variants": f"WITH {LATEST} SELECT store, variant_id, {r('mae', 'mae')}, place FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY mae, variant_id) AS place FROM la) WHERE place <= 3",
        "broken_entries": "WITH g AS (SELECT l_orderkey AS entry, list(DISTINCT l_returnflag) AS roles FROM lineitem GROUP BY 1) SELECT entry, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(roles, x)), ',') AS missing, CASE WHEN len(roles) = 3 THEN 'healthy' ELSE 'broken' END AS status FROM g",
        "catalog_verify": f"""WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS entry, CASE l_returnflag WHEN 'A' THEN 'deformed' WHEN 'N' THEN 'mask' ELSE 'flow' END AS role, CAST(round(l_tax * 100) AS INT) AS tax, l_quantity > 49 AS absent, l_linestatus = 'O' AND l_discount = 0 AS wide FROM lineitem),
w AS (SELECT *, CASE role WHEN 'mask' THEN 'bool' ELSE 'float32' END AS kind FROM c)
SELECT entry, role, 'missing' AS error FROM w WHERE absent
UNION ALL SELECT entry, role, 'expected ' || kind || ', got float64' FROM w WHERE NOT absent AND wide
UNION ALL SELECT entry, role, 'expected ' || CASE role WHEN 'flow' THEN '4' ELSE '3' END || ' dimensions, got 2' FROM w WHERE NOT absent AND tax = 8
UNION ALL SELECT entry, role, CASE role WHEN 'flow' THEN 'spatial shape' ELSE 'shape' END || ' differs from the reference''s' FROM w WHERE NOT absent AND tax = 7
UNION ALL SELECT entry, role, 'vector axis 0 must be 3, got 2' FROM w WHERE NOT absent AND tax = 6 AND role = 'flow'""",
        "ncc_fft": f"WITH {FIELD_CYCLIC} SELECT 'pair' AS pair_id, poi, iz, iy, ix, pz, py, px, {', '.join(r(f'CAST({c} AS FLOAT)', c) for c in ('dz', 'dy', 'dx', 'confidence'))}, valid, CAST(status AS BIGINT) AS status FROM fld",
        "distance_volume": f"WITH {CUBE}, s AS (SELECT z, y, x FROM cube WHERE m) SELECT {big('z', 'y', 'x')}, {r('min(sqrt(power(c.z - s.z, 2) + power(c.y - s.y, 2) + power(c.x - s.x, 2)))', 'value')} FROM (SELECT z AS z, y AS y, x AS x FROM cube) c, s GROUP BY c.z, c.y, c.x".replace(f"{big('z', 'y', 'x')}", big("c.z", "c.y", "c.x").replace("AS c.", "AS ")),
        "frame_pairs": "SELECT CAST(user_id AS VARCHAR) AS series, event_id AS t, before AS reference, event_type AS deformed FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE k > 1",
        "frame_pairs_state": "SELECT CAST(user_id AS VARCHAR) AS series, event_id AS t, before AS reference, event_type AS deformed, false AS late FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE k > 1",
        "zarr_roundtrip": f"WITH {CUBE} SELECT {big('z', 'y', 'x')}, {r('CAST(value AS FLOAT)', 'value')} FROM cube",
        "zone_profile": f"""WITH {CUBE}, v AS (SELECT 'reference' AS name, value FROM cube UNION ALL SELECT 'deformed', value FROM cube UNION ALL SELECT 'mask', CAST(m AS INT) FROM cube),
x AS (SELECT name, count(*) AS n, count(*) FILTER (WHERE value <> 0) AS n_true, avg(value) AS mean, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1),
b AS (SELECT name, least(floor((value - lo) / (hi - lo) * 64), 63) AS b, count(*) AS c FROM v JOIN x USING (name) GROUP BY ALL), s AS (SELECT *, sum(c) OVER (PARTITION BY name ORDER BY b) AS upto FROM b),
k AS (SELECT s.*, row_number() OVER (PARTITION BY name ORDER BY b) AS k FROM s JOIN x USING (name) WHERE upto >= n / 2e0)
SELECT name, n, n_true, {r('mean', 'mean')}, {r('lo', 'min')}, {r('hi', 'max')}, {r('lo + (b + (n / 2e0 - (upto - c)) / c) * ((hi - lo) / 64)', 'median')} FROM k JOIN x USING (name) WHERE k = 1""",
        "zarr_region": f"WITH {CUBE}, roll AS (SELECT (z + 1) % 16 AS z, (y + 30) % 32 AS y, (x + 1) % 32 AS x, value FROM cube) SELECT {big('z', 'y', 'x')}, {r('CAST(value AS FLOAT)', 'value')} FROM roll WHERE z >= 3 AND z < 9 AND y < 20 AND x >= 17",
        "campaign_fields": " UNION ALL ".join(f"(WITH {field_sql(threshold=t)} SELECT CAST({t} AS DOUBLE) AS mask_threshold, poi, {', '.join(r(f'CAST({c} AS FLOAT)', c) for c in ('dz', 'dy', 'dx', 'confidence'))}, valid, CAST(status AS BIGINT) AS status FROM fld)" for t in ("0.4", "0.5", "0.6")),
        "displacement_field_stored": f"WITH {FIELD} SELECT poi, {', '.join(r(f'CAST({c} AS FLOAT)', c) for c in ('dz', 'dy', 'dx', 'confidence'))}, valid, CAST(status AS BIGINT) AS status FROM fld",
        "budget_batch": """WITH p AS (SELECT p_partkey, CAST(16 + 8 * (p_size % 11) AS BIGINT) AS w, CAST(500 + 10 * p_size AS BIGINT) * 1280 * 1280 AS v, CAST(16 + p_partkey % 64 AS BIGINT) * 1073741824 AS free, ([36, 232, 480])[p_partkey % 3 + 1] AS c, CASE WHEN p_partkey % 3 = 2 THEN 8 ELSE 0 END AS o FROM part)
SELECT p_partkey, w AS "window", CASE p_partkey % 3 WHEN 0 THEN 'cyclic' ELSE 'linear' END AS mode, CASE p_partkey % 3 WHEN 2 THEN 'overlap' ELSE 'global' END AS normalization, CAST(c * w * w * w AS BIGINT) AS per_point, CAST(9 * v AS BIGINT) AS resident,
 CAST(least(greatest(0, CAST(floor(free * 0.85e0) AS BIGINT) - 9 * v - o * w * w * w) // (c * w * w * w) // 8 * 8, 1024) AS BIGINT) AS batch FROM p""",
        "make_texture": f"WITH {CUBE}, {gaussian('cube', 'gs', 1.5)} SELECT {big('z', 'y', 'x')}, {r('CAST((value - (SELECT avg(value) FROM gs)) / (SELECT stddev_pop(value) FROM gs) AS FLOAT)', 'value')} FROM gs",
        "phantom_render": f"WITH {CUBE}, {gaussian('cube', 'gs', 1.5)}, tx AS (SELECT z, y, x, CAST((value - (SELECT avg(value) FROM gs)) / (SELECT stddev_pop(value) FROM gs) AS FLOAT) AS t FROM gs), lit AS (SELECT z, y, x, CASE WHEN {RAD['imp']} THEN 1.2e0 WHEN {RAD['hole']} THEN 0.05e0 WHEN {RAD['r2']} BETWEEN 81 AND 144 THEN 0.9e0 WHEN {RAD['r2']} <= 81 AND m THEN 0.55e0 ELSE 0.05e0 END * (1 + 0.2e0 * t) AS value FROM cube JOIN tx USING (z, y, x)), {gaussian('lit', 'ph', 0.5)} SELECT {big('z', 'y', 'x')}, {r('CAST(value AS FLOAT)', 'value')} FROM ph",
        "unit_convert": f"SELECT p_partkey, u AS unit, {r('p_size * (CASE u WHEN ' + chr(39) + 'nm' + chr(39) + ' THEN 0.001e0 WHEN ' + chr(39) + 'um' + chr(39) + ' THEN 1e0 ELSE 1000e0 END)', 'um')} FROM (SELECT *, (['nm', 'um', 'mm'])[p_partkey % 3 + 1] AS u FROM part)",
        "field_points_export": f"WITH {EVENTS} SELECT poi, {r('ix * 1.5e0', 'x')}, {r('iy * 0.5e0', 'y')}, {r('iz * 2e0', 'z')}, {r('dx * 1.5e0', 'ux')}, {r('dy * 0.5e0', 'uy')}, {r('dz * 2e0', 'uz')}, confidence, CAST(0 AS BIGINT) AS status, {r('sqrt(power(dx * 1.5e0, 2) + power(dy * 0.5e0, 2) + power(dz * 2e0, 2))', 'magnitude')} FROM f WHERE valid",
        "masked_volume": f"WITH {CUBE} SELECT {big('z', 'y', 'x')}, {r('CASE WHEN m THEN value ELSE 0 END', 'value')} FROM cube",
        "iso_cells": f"WITH {CUBE}, g AS (SELECT a.z, a.y, a.x, count(*) AS n, min(b.value) AS lo, max(b.value) AS hi FROM cube a JOIN cube b ON b.z - a.z BETWEEN 0 AND 1 AND b.y - a.y BETWEEN 0 AND 1 AND b.x - a.x BETWEEN 0 AND 1 GROUP BY ALL) SELECT {big('z', 'y', 'x')}, {r('lo', 'lo')}, {r('hi', 'hi')} FROM g WHERE n = 8 AND lo <= 120 AND hi >= 120",
        "iso_surface": f"WITH {CUBE}, v AS (SELECT z, y, x, value FROM cube), s AS (SELECT 1e0 AS sz, 1e0 AS sy, 1e0 AS sx), {MARCH} SELECT {big('z', 'y', 'x')}, CAST(ids[1] AS BIGINT) AS a, CAST(ids[2] AS BIGINT) AS b, CAST(ids[3] AS BIGINT) AS c, {r('area', 'area')} FROM tris",
        "surface_measures": f"""WITH {CUBE}, v AS (SELECT z, y, x, CASE WHEN m THEN value ELSE 0 END AS value FROM cube), s AS (SELECT 2e0 AS sz, 1e0 AS sy, 0.5e0 AS sx), {MARCH}, ed AS (SELECT p, q, count(*) AS n FROM (SELECT unnest([ids[1], ids[2], ids[1]]) AS p, unnest([ids[2], ids[3], ids[3]]) AS q FROM tris) GROUP BY ALL), vt AS (SELECT count(DISTINCT id) AS n FROM cross_)
 SELECT 'masked' AS frame, (SELECT count(*) FROM tris) AS n_triangles, (SELECT n FROM vt) AS n_corners, (SELECT count(*) FROM ed) AS n_edges, (SELECT count(*) FROM ed WHERE n = 1) AS n_open, (SELECT n FROM vt) - (SELECT count(*) FROM ed) + (SELECT count(*) FROM tris) AS euler, {r('(SELECT sum(area) FROM tris)', 'area')}""",
        "structured_grid": f"WITH {EVENTS} SELECT poi, CAST(ix AS BIGINT) AS i, CAST(iy AS BIGINT) AS j, CAST(iz AS BIGINT) AS k, {r('(ix * 4 + 3.5e0) * 1.5e0', 'x')}, {r('(iy * 4 + 3.5e0) * 0.5e0', 'y')}, {r('(iz * 4 + 3.5e0) * 2e0', 'z')}, confidence FROM f",
        "magnitude_percentiles": f"WITH {EVENTS}, q AS (SELECT sqrt(dz * dz + dy * dy + dx * dx) AS u, confidence FROM f WHERE valid) SELECT {r('quantile_cont(u, 0.5e0)', 'u_p50')}, {r('quantile_cont(u, 0.9e0)', 'u_p90')}, {r('quantile_cont(u, 0.99e0)', 'u_p99')}, {r('max(u)', 'u_max')}, {r('quantile_cont(confidence, 0.5e0)', 'conf_p50')}, {r('quantile_cont(confidence, 0.1e0)', 'conf_p10')}, {r('min(confidence)', 'conf_min')} FROM q",
    }
    return out
