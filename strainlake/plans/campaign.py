"""Parameter campaigns: expand a spec to variants, skip what is done, correlate and score each pair, keep going on errors.

Work is shared: pairs are loaded once per load parameters, variants that differ in the mask threshold alone are one
correlation at the loosest threshold, then filtered and tested anew; the truth is sampled once for a flow and grid, and
distances are transformed once for a mask. Results are rows appended to a Parquet table;
resuming is an anti-join on (store, deformation, params_hash).
"""

from __future__ import annotations

import datetime
import hashlib
import itertools
import json
import math
import platform
import traceback
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from strainlake import schema
from strainlake.config import CorrelateConfig, Lattice
from strainlake.functions.shipping import shared_folder, ship
from strainlake.functions.signal import distance_volume
from strainlake.functions.synth import flow_tables, sample_flow
from strainlake.operators import lattice as L, score
from strainlake.plans import campaign_tables as C, correlate as P
from strainlake.sources import fieldstore
from strainlake.sources.store import CONVENTIONS, Dataset, Manifest

#: The knobs with their defaults, in the order of slugs, and their short names there.
DEFAULTS: dict[str, Any] = {
    "window": 96,
    "overlap": 0.5,
    "mask_threshold": 0.9,
    "batch_size": "auto",
    "ncc_mode": "linear",
    "ncc_normalization": "overlap",
    "search_radius": None,
    "tukey_alpha": None,
    "mask": None,
    "dry_shape": None,
    "flow_convention": None,
}
SHORT = {"window": "w", "overlap": "ov", "mask_threshold": "mt", "batch_size": "bs", "ncc_mode": "ncc", "ncc_normalization": "nn", "search_radius": "sr", "tukey_alpha": "ta", "mask": "m", "dry_shape": "dry", "flow_convention": "fc"}
LOAD = ("mask", "dry_shape", "flow_convention")
GRID = ("window", "overlap")
COMPUTE = tuple(k for k in DEFAULTS if k not in LOAD + GRID)
#: devices is read for the sake of existing files: partitions take their place.
KEYS = ("campaign", "stores", "manifest", "strict", "select", "defaults", "sweep", "variants", "devices", "distance_bins", "out_dir")


def knob(key: str, value: Any) -> Any:
    """A knob's value in its one form; ValueError for an unknown knob or an unfit value."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    bad = ValueError(f"{key}: {value!r} is not allowed")
    if key not in DEFAULTS:
        raise ValueError(f"unknown knob {key!r}; known are {sorted(DEFAULTS)}")
    if key in ("window", "dry_shape"):
        if value is None or key == "window" and whole(value):
            return value
        if isinstance(value, (list, tuple)) and len(value) == 3 and all(map(whole, value)):
            return tuple(value)
        raise bad
    if key in ("batch_size", "search_radius"):
        if value == "auto" and key == "batch_size" or value is None and key == "search_radius" or whole(value) and value > 0:
            return value
        raise bad
    if key in ("mask", "flow_convention", "ncc_mode", "ncc_normalization"):
        if value is None and key in LOAD or isinstance(value, str) and (key != "flow_convention" or value in CONVENTIONS):
            return value
        raise bad
    if value is None and key == "tukey_alpha":
        return None
    if value is None or isinstance(value, bool) or not isinstance(value, (int, float)):
        raise bad
    return float(value)


def slug(value: Any) -> str:
    if value is None:
        return "none"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, tuple):
        return "x".join(map(slug, value))
    return f"{value:g}" if isinstance(value, float) else str(value)


@dataclass(frozen=True)
class Variant:
    name: str
    params_hash: str
    params: dict = field(hash=False)

    @property
    def variant_id(self) -> str:
        return f"{self.name}-{self.params_hash}"

    def part(self, keys: tuple[str, ...]) -> str:
        return json.dumps({k: self.params[k] for k in keys})


def params_hash(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:8]


def variants(defaults: dict | None, sweep: dict | None, explicit: list | None) -> list[Variant]:
    """Defaults with each point of the sweep's product, then explicit entries; of equal parameters the first stays."""
    base = {k: knob(k, v) for k, v in {**DEFAULTS, **(defaults or {})}.items()}
    axes = []
    for k, values in (sweep or {}).items():
        if not isinstance(values, list) or not values:
            raise ValueError(f"sweep.{k} must be a list with values")
        axes.append([(k, knob(k, v)) for v in values])
    points = [(None, dict(p)) for p in itertools.product(*axes)]
    for e in explicit or []:
        if not isinstance(e, dict):
            raise ValueError("variants must be mappings")
        name = e.get("name")
        if name is not None and (not isinstance(name, str) or not name.strip()):
            raise ValueError("a variant's name must be a string with text")
        points.append((name, {k: knob(k, v) for k, v in e.items() if k != "name"}))
    out: dict[str, Variant] = {}
    for name, overlay in points:
        params = base | overlay
        h = params_hash(params)
        auto = "-".join(f"{SHORT[k]}{slug(params[k])}" for k in DEFAULTS if params[k] != base[k]) or "base"
        out.setdefault(h, Variant(name or auto, h, params))
    return list(out.values())


@dataclass(frozen=True)
class Spec:
    campaign: str
    stores: tuple[str, ...]
    out: str
    variants: tuple[Variant, ...]
    real: Any = "all"
    synthetic: Any = "all"
    manifest: Manifest | None = None
    strict: bool = True
    distance_bins: tuple[float, ...] = ()

    @classmethod
    def parse(cls, raw: dict) -> Spec:
        if not isinstance(raw, dict):
            raise ValueError("a campaign is a mapping")
        unknown = set(raw) - set(KEYS)
        if unknown:
            raise ValueError(f"unknown keys: {sorted(unknown)}; known are {list(KEYS)}")
        stores = raw.get("stores")
        if not isinstance(raw.get("campaign"), str) or not raw["campaign"].strip() or not isinstance(stores, list) or not stores:
            raise ValueError("a campaign name and a list of stores are required")
        which = raw.get("select") or {}
        if not isinstance(which, dict) or set(which) - {"real", "synthetic"}:
            raise ValueError("select maps real and synthetic")
        for k, v in which.items():
            if v not in ("all", "none") and not isinstance(v, list):
                raise ValueError(f"select.{k} must be all, none or a list of names")
        if not isinstance(raw.get("strict", True), bool):
            raise ValueError("strict must be true or false")
        bins = tuple(map(float, raw.get("distance_bins") or ()))
        if any(a >= b for a, b in zip(bins, bins[1:])):
            raise ValueError("distance_bins must ascend")
        manifest = Manifest.from_yaml(raw["manifest"]) if raw.get("manifest") else None
        out = f"{str(raw.get('out_dir') or 'results').rstrip('/')}/{raw['campaign']}"
        expanded = tuple(variants(raw.get("defaults"), raw.get("sweep"), raw.get("variants")))
        return cls(raw["campaign"], tuple(map(str, stores)), out, expanded, which.get("real", "all"), which.get("synthetic", "all"), manifest, raw.get("strict", True), bins)

    @classmethod
    def from_yaml(cls, path: str) -> Spec:
        with open(path) as f:
            return cls.parse(yaml.safe_load(f) or {})


def chosen(listed: Any, names: list[str]) -> list[str]:
    """all, none, or a list, of which absent names are skipped."""
    if listed in ("all", None):
        return names
    if listed == "none":
        return []
    if not isinstance(listed, list):
        raise ValueError(f"expected all, none or a list, got {listed!r}")
    return [n for n in listed if n in names]


@dataclass(frozen=True)
class Job:
    store: str
    deformation: str
    kind: str
    variant: Variant


class Observer:
    """Told of each job's start and end; override what is of interest."""

    def planned(self, jobs: list[Job]) -> None: ...
    def started(self, job: Job) -> None: ...
    def ended(self, job: Job, row: dict) -> None: ...


def results(spark: SparkSession, spec: Spec) -> DataFrame:
    """All result rows so far; none if nothing was written."""
    path = f"{spec.out}/results"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema.RESULT)
    return spark.read.schema(schema.RESULT).parquet(path)


def latest(spark: SparkSession, spec: Spec) -> DataFrame:
    return C.latest(results(spark, spec).withColumn("row_id", F.lit(0)))


def plan(spark: SparkSession, spec: Spec, force: bool = False, only: dict[str, str] | None = None, stores: list[str] | None = None, datasets: dict[str, Dataset] | None = None) -> list[Job]:
    """Stores x deformations x variants, real before synthetic, less what has a result of the same parameters."""
    for k in only or {}:
        if k not in DEFAULTS:
            raise ValueError(f"unknown knob {k!r}")
    jobs = []
    for store in spec.stores:
        if stores and store not in stores and store.rstrip("/").split("/")[-1] not in stores:
            continue
        ds = (datasets or {}).get(store) or Dataset.open(spark, store, spec.manifest, spec.strict)
        names = [(n, "real") for n in chosen(spec.real, ds.list_real())] + [(n, "synthetic") for n in chosen(spec.synthetic, ds.list_synthetic())]
        jobs += [Job(store, n, k, v) for n, k in names for v in spec.variants if all(slug(v.params[x]) == y for x, y in (only or {}).items())]
    if force or not jobs:
        return jobs
    table = spark.createDataFrame([(i, j.store, j.deformation, j.variant.params_hash) for i, j in enumerate(jobs)], "i int, store string, deformation string, params_hash string")
    left = {r["i"] for r in C.pending(table, results(spark, spec)).select("i").collect()}
    return [j for i, j in enumerate(jobs) if i in left]


def config_of(params: dict) -> CorrelateConfig:
    return CorrelateConfig(params["window"], params["overlap"], params["mask_threshold"], params["ncc_mode"], params["ncc_normalization"], params["search_radius"], params["tukey_alpha"])


class _Shared:
    """What several jobs of a campaign need, made once: truth per flow and grid, distances per mask; freed by scope.

    Tables are written to the folder that driver and executors share and read again: their plans stay short and a lost
    executor costs nothing.
    """

    def __init__(self):
        self.kept: dict[str, dict[tuple, Any]] = {}
        self.paths: dict[str, list[tuple[SparkSession, str]]] = {}

    def keep(self, scope: str, t: DataFrame) -> DataFrame:
        spark, path = t.sparkSession, shared_folder(t.sparkSession, "campaign")
        t.write.parquet(path)
        self.paths.setdefault(scope, []).append((spark, path))
        return spark.read.schema(t.schema).parquet(path)

    def once(self, scope: str, key: tuple, make: Callable[[], Any]) -> Any:
        own = self.kept.setdefault(scope, {})
        if key not in own:
            own[key] = make()
        return own[key]

    def free(self, scope: str) -> None:
        self.kept.pop(scope, None)
        for spark, path in self.paths.pop(scope, []):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _fields(spark, pair, group: list[Variant], shared: _Shared) -> dict[str, DataFrame]:
    """The field of each variant of a group that differs in the mask threshold alone."""
    loosest = min(group, key=lambda v: v.params["mask_threshold"])
    config = config_of(loosest.params)
    lattice = Lattice(pair.shape, config.window, config.overlap)
    n = P.tile_size(spark, lattice, config)
    if pair.stored:
        points = shared.keep("group", P.stored_points(spark, lattice, pair.stored.get("mr"), config.mask_threshold))
        found = P.stored_peaks(spark, pair.stored, points.where("admitted").select("poi"), lattice, config, n)
    else:
        points = shared.keep("group", L.admit(L.lattice_table(spark, lattice), pair.mask, lattice, config.mask_threshold))
        found = P.voxel_peaks(pair.reference, pair.deformed, pair.mask, None, points.where("admitted").select("poi"), lattice, config, n)
    found = shared.keep("group", found.select("poi", "dz", "dy", "dx", "confidence"))
    return {v.variant_id: P.field(points.drop("admitted").withColumn("admitted", F.col("fraction") >= v.params["mask_threshold"]), found, config, pair.name) for v in group}


def jsonable(x: Any) -> Any:
    """x as JSON has it: tuples as lists, times as text, numbers that are not finite as null."""
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [jsonable(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def fields_path(spec: Spec, store: str) -> str:
    """Where the fields of a store lie: each store has a folder of its own as soon as a campaign has several."""
    return f"{spec.out}/fields" if len(spec.stores) == 1 else f"{spec.out}/fields-{store_key(store)}"


def store_key(store: str) -> str:
    return f"{slug(store.rstrip('/').split('/')[-1])}-{hashlib.sha256(store.encode()).hexdigest()[:8]}"


def _write_json(spark: SparkSession, path: str, value: Any) -> None:
    """One JSON text in a folder of its own, replaced as a whole."""
    text = json.dumps(jsonable(value), sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def provenance(spark: SparkSession) -> dict:
    from importlib.metadata import PackageNotFoundError, version

    try:
        own = version("strainlake")
    except PackageNotFoundError:
        own = None
    return {"spark": spark.version, "python": platform.python_version(), "strainlake": own, "application": spark.sparkContext.applicationId, "host": platform.node()}


SIDECAR = "value string, store string, deformation string, variant_id string"


def sidecar(spark: SparkSession, spec: Spec, store: str, deformation: str, variant_id: str) -> dict:
    """The sidecar of a result: params, params_hash, summary, provenance, scored."""
    t = spark.read.schema(SIDECAR).text(f"{spec.out}/sidecars")
    return json.loads(t.where((F.col("store") == store_key(store)) & (F.col("deformation") == deformation) & (F.col("variant_id") == variant_id)).first()[0])


def write_results(spark: SparkSession, spec: Spec, rows: list[tuple[Job, dict]], own: dict) -> list[dict]:
    """Appends the rows of jobs (job, values), all in one file, and writes the sidecars of those that are ok in one pass."""
    names = [x.split()[0] for x in schema.RESULT.split(", ")]
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    full = [dict.fromkeys(names) | {"store": j.store, "deformation": j.deformation, "variant_id": j.variant.variant_id, "params_hash": j.variant.params_hash, "written_at": now} | v for j, v in rows]
    sides = []
    for (job, _), row in zip(rows, full, strict=True):
        if row["status"] == "ok":
            summary = {k: row[k] for k in names if k not in ("store", "deformation", "variant_id", "params_hash", "phase", "error")}
            side = {"params": job.variant.params, "params_hash": job.variant.params_hash, "summary": summary, "provenance": own, "scored": row["mae"] is not None}
            sides.append((json.dumps(jsonable(side), sort_keys=True, allow_nan=False), store_key(job.store), job.deformation, job.variant.variant_id))
    if sides:
        t = spark.createDataFrame(sides, SIDECAR).coalesce(1)
        t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store", "deformation", "variant_id").text(f"{spec.out}/sidecars")
    if full:
        spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema.RESULT).coalesce(1).write.mode("append").parquet(f"{spec.out}/results")
    return full


def run(
    spark: SparkSession, spec: Spec, force: bool = False, only: dict[str, str] | None = None, stores: list[str] | None = None, observer: Observer | None = None,
    open_dataset: Callable[..., Dataset] | None = None, fields_of: Callable[..., dict[str, DataFrame]] | None = None,
    take: Callable[[Job], bool] | None = None,
) -> DataFrame:
    """Runs what is pending and returns the latest row of each job. A job that fails leaves a row and the rest goes on.

    open_dataset(spark, store, manifest, strict) and fields_of(spark, pair, variants) may take the place of the stores'
    reader and of the correlation; the latter gives variant_id -> field. take: which of the pending jobs to run, by default all. A flow's splines and the truth on each grid
    are made once for a deformation, distances once for a mask. Results, sidecars, the variants' index and the campaign
    as it was read are written below spec.out.
    """
    observer = observer or Observer()
    datasets: dict[str, Dataset] = {}
    ship(spark)
    shared, own = _Shared(), provenance(spark)

    def note(job: Job, **values) -> None:
        observer.ended(job, write_results(spark, spec, [(job, values)], own)[0])

    def failed(job: Job, phase: str) -> None:
        note(job, status="failed", phase=phase, error=traceback.format_exc()[-2000:])

    _write_json(spark, f"{spec.out}/config", {k: v for k, v in spec.__dict__.items() if k not in ("variants", "manifest")} | {"manifest": str(spec.manifest) if spec.manifest else None, "variants": [{"variant_id": v.variant_id, "params": v.params} for v in spec.variants]})
    index(spark, spec).coalesce(1).write.mode("overwrite").parquet(f"{spec.out}/variants")
    for asked in stores or []:
        if not any(asked in (s, s.rstrip("/").split("/")[-1]) for s in spec.stores):
            warnings.warn(f"no store of the campaign is named {asked!r}", stacklevel=2)
    for store in spec.stores:
        try:
            datasets[store] = (open_dataset or Dataset.open)(spark, store, spec.manifest, spec.strict)
        except Exception:
            failed(Job(store, "", "", spec.variants[0]), "open_store")
    opened = Spec(**{**spec.__dict__, "stores": tuple(datasets)})
    jobs = [j for j in plan(spark, opened, force, only, stores, datasets) if take is None or take(j)]
    for store in sorted({j.store for j in jobs if j.kind == "synthetic" and j.variant.params["flow_convention"] is None}):
        if datasets[store].manifest.convention is None:
            warnings.warn(f"{store}: no flow convention is set, {datasets[store].profile.convention} is taken", stacklevel=2)
    observer.planned(jobs)
    place = lambda j: (j.store, j.deformation, j.kind, j.variant.part(LOAD))
    before = None
    for (store, name, kind, _), of_load in itertools.groupby(sorted(jobs, key=place), place):
        if store != before:
            shared.free("store")
            before = store
        group = list(of_load)
        p = group[0].variant.params
        try:
            pair = datasets[store].load_pair(name, p["mask"], p["dry_shape"], p["flow_convention"])
        except Exception:
            for j in group:
                failed(j, "load_pair")
            continue
        alike = lambda j: j.variant.part(tuple(k for k in GRID + COMPUTE if k != "mask_threshold"))
        for _, same in itertools.groupby(sorted(group, key=alike), alike):
            of = list(same)
            try:
                fields = fields_of(spark, pair, [j.variant for j in of]) if fields_of else _fields(spark, pair, [j.variant for j in of], shared)
            except Exception:
                for j in of:
                    failed(j, "correlate")
                shared.free("group")
                continue
            for j in of:
                observer.started(j)
                phase = "correlate"
                try:
                    f = shared.keep("job", fields[j.variant.variant_id])
                    counts = score.status_counts(f).first().asDict()
                    phase = "evaluate_or_write"
                    fieldstore.save(f, fields_path(spec, store), j.variant.variant_id)
                    row = {k: counts[k] for k in counts} | {"status": "ok"}
                    if pair.flow is not None and counts["n_ok"]:
                        grid = j.variant.part(GRID)
                        tables = shared.once("pair", (), lambda: {a: shared.keep("pair", t) for a, t in flow_tables(pair.flow, pair.shape).items()})
                        truth = shared.once("pair", (grid,), lambda: shared.keep("pair", sample_flow(f.select("poi", "pz", "py", "px"), tables, pair.shape)))
                        scored = shared.keep("job", f.join(truth, "poi"))
                        e = score.report(scored).first()
                        rho = score.spearman(score.errors(scored.where("valid")), "confidence", "norm").first()["rho"]
                        if spec.distance_bins and pair.mask is not None:
                            far = shared.once("store", (p["mask"], str(p["dry_shape"])), lambda: shared.keep("store", distance_volume(pair.mask, pair.shape)))
                            table = score.strata(score.distance_to(scored, pair.mask, pair.shape, distances=far), spec.distance_bins)
                            table.withColumn("deformation", F.lit(name)).withColumn("variant_id", F.lit(j.variant.variant_id)).write.mode("append").parquet(f"{spec.out}/strata")
                        row |= {"mae": e["mae"], "rmse": e["rmse"], "p95": e["p95"], "confidence_vs_error": rho}
                    note(j, **row)
                except Exception:
                    failed(j, phase)
                finally:
                    shared.free("job")
            shared.free("group")
        shared.free("pair")
    shared.free("store")
    return latest(spark, spec)


def index(spark: SparkSession, spec: Spec) -> DataFrame:
    """variant_id, name, params_hash and params (as JSON text) of each variant."""
    return spark.createDataFrame([(v.variant_id, v.name, v.params_hash, json.dumps(v.params, sort_keys=True)) for v in spec.variants], "variant_id string, name string, params_hash string, params string")


__all__ = ["Job", "Manifest", "Observer", "Spec", "Variant", "chosen", "index", "knob", "latest", "params_hash", "plan", "results", "run", "sidecar", "slug", "variants"]
