"""Schemas of the engine's tables."""

VOXEL = "volume_id string, z int, y int, x int, value float"
MASK = "mask_id string, z int, y int, x int, value boolean"
BLOCK = "volume_id string, bz int, by int, bx int, z0 int, y0 int, x0 int, nz int, ny int, nx int, dtype string, data binary"
FLOW = "entry string, z int, y int, x int, dz float, dy float, dx float"
GRID = "poi long, iz int, iy int, ix int, z0 int, y0 int, x0 int, pz float, py float, px float"
CORR = "poi long, kz int, ky int, kx int, ncc double"
FIELD = "pair_id string, poi long, iz int, iy int, ix int, pz float, py float, px float, dz float, dy float, dx float, valid boolean, confidence float, status tinyint"
CATALOG = "store string, role string, entry string, kind string, path string, shape array<int>, dtype string"
RESULT = (
    "store string, deformation string, variant_id string, params_hash string, status string, n_total long, n_ok long, n_masked long, n_outlier long,"
    " n_low_conf long, n_out_of_range long, mae double, rmse double, p95 double, confidence_vs_error double, phase string, error string, written_at timestamp"
)
