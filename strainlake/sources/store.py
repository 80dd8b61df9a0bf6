"""Store layouts, manifests, verification, and datasets bound to a store. Only metadata is read here.

A layout (profile) names the groups of a store; a manifest beside it (<store>.yaml) or in its root attributes
(dvc_store) overrides parts of it. The catalog is a DataFrame; loads are lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strainlake import schema
from strainlake.functions.units import VoxelSpacing
from strainlake.sources import zarr_source as zarr

NO_MASK = "none"
VERSION = 1
DISCOVER = "discover"
#: Fixed values of flow metadata.
AXIS_ORDERS = ("3_zyx", "zyx_3")
VECTOR_ORDERS = ("dz_dy_dx", "dx_dy_dz")
CONVENTIONS = ("pull_back", "push_forward")


class MalformedStore(ValueError):
    """A store without its groups or its reference."""


@dataclass(frozen=True)
class Profile:
    name: str
    base: str = "base"
    reference: str = "volume0"
    default_mask: str | None = "mask"
    real: str = "iterations"
    synthetic: str = "synthetic"
    deformed: str = "volume1"
    flow: str = "flow"
    axis_order: str = "3_zyx"
    vector_order: str = "dz_dy_dx"
    convention: str = "pull_back"
    units: str = "voxel"
    dtypes: tuple[tuple[str, str], ...] = (("reference", "float32"), ("deformed", "float32"), ("mask", "bool"), ("flow", "float32"))


_profiles: dict[str, Profile] = {}


def register(profile: Profile) -> None:
    if profile.name in _profiles:
        raise ValueError(f"profile {profile.name!r} exists already")
    _profiles[profile.name] = profile


def get_profile(name: str) -> Profile:
    if name not in _profiles:
        raise KeyError(f"no profile named {name!r}")
    return _profiles[name]


def list_profiles() -> list[str]:
    return list(_profiles)


def default_profile() -> Profile:
    if len(_profiles) != 1:
        raise LookupError(f"{len(_profiles)} profiles are registered; a manifest must name one of {list(_profiles)}")
    return next(iter(_profiles.values()))


register(Profile("bone_screw_synchrotron_v1"))


@dataclass(frozen=True)
class Manifest:
    profile: str | None = None
    spacing: VoxelSpacing | None = None
    default_mask: str | None = None
    masks: tuple[str, ...] | str = DISCOVER
    iterations: tuple[str, ...] | str = DISCOVER
    synthetic: tuple[str, ...] | str = DISCOVER
    axis_order: str | None = None
    vector_order: str | None = None
    convention: str | None = None
    units: str | None = None

    @classmethod
    def parse(cls, raw: dict) -> Manifest:
        if raw.get("dvc_store_version", VERSION) != VERSION:
            raise ValueError(f"dvc_store_version {raw['dvc_store_version']} is not supported; this reads {VERSION}")

        def part(of: dict, name: str) -> dict:
            x = of.get(name) or {}
            if not isinstance(x, dict):
                raise ValueError(f"{name} must be a mapping")
            return x

        def entries(x, name: str):
            if x is None or x == DISCOVER:
                return DISCOVER
            if isinstance(x, list) and all(isinstance(e, str) for e in x):
                return tuple(x)
            raise ValueError(f"{name} must be {DISCOVER!r} or a list of strings")

        def text(x, name: str, allowed: tuple[str, ...] | None = None):
            if x is not None and (not isinstance(x, str) or allowed and x not in allowed):
                raise ValueError(f"{name}: expected {allowed or 'a string'}, got {x!r}")
            return x

        spacing = None
        if raw.get("spacing") is not None:
            s = part(raw, "spacing")
            values = s.get("values")
            if not isinstance(values, (list, tuple)) or len(values) != 3:
                raise ValueError("spacing.values must have three entries")
            spacing = VoxelSpacing(*map(float, values), s.get("unit", "voxel"))
        base, synthetic = part(raw, "base"), part(raw, "synthetic")
        flow = part(synthetic, "flow")
        return cls(
            text(raw.get("store_format"), "store_format"), spacing, text(base.get("default_mask"), "base.default_mask"), entries(base.get("masks"), "base.masks"),
            entries(part(raw, "iterations").get("entries"), "iterations.entries"), entries(synthetic.get("entries"), "synthetic.entries"),
            text(flow.get("axis_order"), "axis_order", AXIS_ORDERS), text(flow.get("vector_order"), "vector_order", VECTOR_ORDERS), text(flow.get("convention"), "convention", CONVENTIONS), flow.get("units"),
        )

    @classmethod
    def from_yaml(cls, path: str) -> Manifest:
        with open(path) as f:
            return cls.parse(yaml.safe_load(f) or {})

    @classmethod
    def discover(cls, store: str) -> Manifest | None:
        """The sidecar's manifest or the root attributes'; both must agree if both exist."""
        store = store.rstrip("/")
        folder, _, name = store.rpartition("/")
        raw = zarr.read_bytes(folder or ".", f"{name}.yaml")
        side = cls.parse(yaml.safe_load(raw) or {}) if raw is not None else None
        held = zarr.attributes(store).get("dvc_store")
        own = cls.parse(held) if held is not None else None
        if side is not None and own is not None and side != own:
            raise ValueError(f"{store}: the sidecar and the root attributes hold different manifests")
        return side or own

    def as_dict(self) -> dict:
        listed = lambda x: x if x == DISCOVER else list(x)
        flow = {k: v for k in ("axis_order", "vector_order", "convention", "units") if (v := getattr(self, k)) is not None}
        out: dict = {"dvc_store_version": VERSION, "base": {"masks": listed(self.masks)}, "iterations": {"entries": listed(self.iterations)}, "synthetic": {"entries": listed(self.synthetic)}}
        if self.profile:
            out["store_format"] = self.profile
        if self.default_mask:
            out["base"]["default_mask"] = self.default_mask
        if flow:
            out["synthetic"]["flow"] = flow
        if self.spacing:
            out["spacing"] = {"values": [self.spacing.z, self.spacing.y, self.spacing.x], "unit": self.spacing.unit}
        return out

    def to_yaml(self, path: str) -> None:
        with open(path, "w") as f:
            yaml.safe_dump(self.as_dict(), f, sort_keys=False)


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def _chosen(listed, found: list[str], section: str, report: Report) -> list[str]:
    if listed == DISCOVER:
        return found
    for name in listed:
        if name not in found:
            report.errors.append(f"{section}: {name!r} is listed but not in the store")
    return [x for x in found if x in listed]


def verify(store: str, profile: Profile, manifest: Manifest | None = None) -> Report:
    """Structural errors: groups, arrays, types, shapes, the flow's vector axis, listed names. No voxel is read."""
    report, m = Report(), manifest or Manifest()
    dtypes = dict(profile.dtypes)
    err = report.errors.append
    for group in (profile.base, profile.real, profile.synthetic):
        kind = zarr.node(store, group)
        if kind != "group":
            err(f"expected group {group!r}" if kind is None else f"{group!r} is not a group")
    if report.errors:
        return report

    def array(path: str, role: str, shape: tuple[int, ...] | None, dims: int = 3) -> zarr.ArrayMeta | None:
        a = zarr.node(store, path)
        if a is None or a == "group":
            err(f"{path}: missing" if a is None else f"{path}: expected array, got group")
            return None
        if np.dtype(a.dtype).name != np.dtype(dtypes[role]).name:
            err(f"{path}: expected {dtypes[role]}, got {np.dtype(a.dtype).name}")
        if len(a.shape) != dims:
            err(f"{path}: expected {dims} dimensions, got {len(a.shape)}")
        elif shape is not None and dims == 3 and a.shape != shape:
            err(f"{path}: shape {a.shape} differs from the reference's {shape}")
        return a

    ref = array(f"{profile.base}/{profile.reference}", "reference", None)
    if ref is None:
        return report
    shape = ref.shape if len(ref.shape) == 3 else None
    arrays = [x for x in zarr.children(store, profile.base) if isinstance(zarr.node(store, f"{profile.base}/{x}"), zarr.ArrayMeta)]
    masks = [x for x in arrays if x != profile.reference]
    for name in _chosen(m.masks, masks, "base.masks", report):
        array(f"{profile.base}/{name}", "mask", shape)
    default = m.default_mask or profile.default_mask
    if default is not None and default not in masks:
        err(f"default mask {default!r} is not in {profile.base}/")
    order = m.axis_order or profile.axis_order
    for section, listed in ((profile.real, m.iterations), (profile.synthetic, m.synthetic)):
        found = [x for x in zarr.children(store, section) if zarr.node(store, f"{section}/{x}") == "group"]
        for entry in _chosen(listed, found, f"{section}.entries", report):
            array(f"{section}/{entry}/{profile.deformed}", "deformed", shape)
            if section == profile.synthetic:
                path = f"{section}/{entry}/{profile.flow}"
                flow = array(path, "flow", shape, 4)
                if flow is not None and len(flow.shape) == 4:
                    axis = 0 if order == "3_zyx" else 3
                    if flow.shape[axis] != 3:
                        err(f"{path}: {'leading' if axis == 0 else 'trailing'} axis must be 3 for {order}, got {flow.shape[axis]}; is it {AXIS_ORDERS[1 - AXIS_ORDERS.index(order)]}?")
                    elif shape is not None and tuple(n for i, n in enumerate(flow.shape) if i != axis) != shape:
                        err(f"{path}: spatial shape differs from the reference's {shape}")
    return report


def check_catalog(catalog: DataFrame, shape: Column, dtypes: dict[str, str], axis_order: str = "zyx_3") -> DataFrame:
    """entry, role and error for each row of a catalog (role, entry, path, shape, dtype) with a fault.

    shape: the reference's shape. dtypes: role -> type. A null path is a missing array. The checks of verify(), as
    columns, for catalogs of many stores.
    """
    axis = 0 if axis_order == "3_zyx" else 3
    is_flow, own = F.col("role") == "flow", F.col("shape")
    want = F.create_map(*[F.lit(x) for kv in dtypes.items() for x in kv])
    spatial = F.slice(own, 2, 3) if axis == 0 else F.slice(own, 1, 3)
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    dims = F.when(is_flow, 4).otherwise(3)
    faults = F.array(
        F.when(F.col("path").isNull(), F.lit("missing")),
        F.when(F.col("path").isNotNull() & (F.col("dtype") != F.try_element_at(want, F.col("role"))), say("expected ", F.try_element_at(want, F.col("role")), ", got ", F.col("dtype"))),
        F.when(F.size(own) != dims, say("expected ", dims, " dimensions, got ", F.size(own))),
        F.when((F.size(own) == dims) & ~is_flow & (own != shape), F.lit("shape differs from the reference's")),
        F.when((F.size(own) == dims) & is_flow & (F.get(own, F.lit(axis)) != 3), say(f"vector axis {axis} must be 3, got ", F.get(own, F.lit(axis)))),
        F.when((F.size(own) == dims) & is_flow & (F.get(own, F.lit(axis)) == 3) & (spatial != shape), F.lit("spatial shape differs from the reference's")),
    )
    return catalog.select("entry", "role", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("error"))


@dataclass
class LoadedPair:
    """Lazy tables of one deformation."""

    name: str
    kind: str
    shape: tuple[int, int, int]
    reference: DataFrame
    deformed: DataFrame
    mask: DataFrame | None
    flow: DataFrame | None
    spacing: VoxelSpacing | None
    #: Where the whole volumes lie (r, d and mr -> store, array), so that plans may open chunks; None for a crop.
    stored: dict[str, tuple[str, str]] | None = None


class Dataset:
    """A store bound to its layout. Broken entries are listed, not bound."""

    def __init__(self, spark: SparkSession, store: str, profile: Profile, manifest: Manifest, report: Report):
        self.spark, self.store, self.profile, self.manifest, self.report = spark, store, profile, manifest, report
        p = profile
        ref = zarr.node(store, f"{p.base}/{p.reference}")
        if not isinstance(ref, zarr.ArrayMeta) or any(zarr.node(store, g) != "group" for g in (p.base, p.real, p.synthetic)):
            raise MalformedStore(f"{store}: " + "; ".join(report.errors))
        self.shape = ref.shape
        is_array = lambda x: isinstance(zarr.node(store, x), zarr.ArrayMeta)
        pick = lambda listed, found: [x for x in found if listed == DISCOVER or x in listed]
        self._masks = pick(manifest.masks, [x for x in zarr.children(store, p.base) if x != p.reference and is_array(f"{p.base}/{x}")])
        self.entries: dict[str, str] = {}
        self.broken: dict[str, list[str]] = {}
        for section, kind, listed, roles in ((p.real, "real", manifest.iterations, [p.deformed]), (p.synthetic, "synthetic", manifest.synthetic, [p.deformed, p.flow])):
            for e in pick(listed, [x for x in zarr.children(store, section) if zarr.node(store, f"{section}/{x}") == "group"]):
                missing = [r for r in roles if not is_array(f"{section}/{e}/{r}")]
                if missing:
                    self.broken[e] = missing
                else:
                    self.entries[e] = kind

    @classmethod
    def open(cls, spark: SparkSession, store: str, manifest: Manifest | None = None, strict: bool = True) -> Dataset:
        store = store.rstrip("/")
        if zarr.node(store, "") != "group":
            raise FileNotFoundError(f"no store at {store}")
        m = manifest or Manifest.discover(store) or Manifest()
        profile = get_profile(m.profile) if m.profile else default_profile()
        report = verify(store, profile, m)
        if strict and not report.ok:
            raise MalformedStore(f"{store}: " + "; ".join(report.errors))
        return cls(spark, store, profile, m, report)

    def list_real(self) -> list[str]:
        return sorted(k for k, v in self.entries.items() if v == "real")

    def list_synthetic(self) -> list[str]:
        return sorted(k for k, v in self.entries.items() if v == "synthetic")

    def list_all(self) -> list[str]:
        return self.list_real() + self.list_synthetic()

    def list_masks(self) -> list[str]:
        return sorted(self._masks)

    def list_broken(self) -> list[str]:
        return sorted(self.broken)

    @property
    def default_mask(self) -> str | None:
        return self.manifest.default_mask or self.profile.default_mask

    def _path(self, entry: str, role: str) -> str:
        if entry in self.broken:
            raise ValueError(f"{entry!r} is broken: {', '.join(self.broken[entry])} missing")
        if entry not in self.entries:
            raise KeyError(f"no deformation {entry!r} in {self.store}")
        return f"{self.profile.real if self.entries[entry] == 'real' else self.profile.synthetic}/{entry}/{role}"

    def load_reference(self, crop=None) -> DataFrame:
        return zarr.load_volume(self.spark, self.store, f"{self.profile.base}/{self.profile.reference}", crop)

    def load_mask(self, name: str | None = None, crop=None) -> DataFrame:
        name = name or self.default_mask
        if name not in self._masks:
            raise KeyError(f"no mask {name!r} in {self.store}")
        return zarr.load_mask(self.spark, self.store, f"{self.profile.base}/{name}", crop, tuple(crop or self.shape))

    def load_image(self, entry: str, crop=None) -> DataFrame:
        return zarr.load_volume(self.spark, self.store, self._path(entry, self.profile.deformed), crop)

    def load_flow(self, entry: str, crop=None, convention: str | None = None) -> DataFrame:
        if self.entries.get(entry, "synthetic") != "synthetic":
            raise ValueError(f"{entry!r} is a real deformation: it has no flow")
        m, p = self.manifest, self.profile
        if (m.vector_order or p.vector_order) != "dz_dy_dx":
            raise ValueError(f"vector order {m.vector_order or p.vector_order!r} cannot be read, only dz_dy_dx")
        return zarr.load_flow(self.spark, self.store, self._path(entry, p.flow), m.axis_order or p.axis_order, convention or m.convention or p.convention, crop)

    def check_flow(self, entry: str) -> None:
        """Raises if the flow's vector axis or its spatial shape does not fit; reads no voxel."""
        m, p = self.manifest, self.profile
        a, order = zarr.node(self.store, self._path(entry, p.flow)), m.axis_order or p.axis_order
        axis = 0 if order == "3_zyx" else 3
        if len(a.shape) != 4 or a.shape[axis] != 3 or tuple(n for i, n in enumerate(a.shape) if i != axis) != tuple(self.shape):
            raise ValueError(f"{entry}: flow of shape {tuple(a.shape)} does not fit {order} on {tuple(self.shape)}")

    def load_pair(self, entry: str, mask: str | None = None, crop=None, convention: str | None = None) -> LoadedPair:
        """mask: a name, None for the default, NO_MASK for none."""
        image = self.load_image(entry, crop)
        kind = self.entries[entry]
        m = None if mask == NO_MASK or mask is None and self.default_mask is None else self.load_mask(mask, crop)
        flow = self.load_flow(entry, crop, convention) if kind == "synthetic" else None
        base = self.profile.base
        stored = {"r": (self.store, f"{base}/{self.profile.reference}"), "d": (self.store, self._path(entry, self.profile.deformed))}
        stored |= {"mr": (self.store, f"{base}/{mask or self.default_mask}")} if m is not None else {}
        return LoadedPair(entry, kind, tuple(crop or self.shape), self.load_reference(crop), image, m, flow, self.manifest.spacing, None if crop else stored)

    def catalog(self) -> DataFrame:
        """One row per array of the store, and one for each missing role of broken entries (path null)."""
        p, rows = self.profile, []

        def row(role, entry, kind, path):
            a = zarr.node(self.store, path)
            rows.append((self.store, role, entry, kind, path if isinstance(a, zarr.ArrayMeta) else None, list(a.shape) if isinstance(a, zarr.ArrayMeta) else None, np.dtype(a.dtype).name if isinstance(a, zarr.ArrayMeta) else None))

        row("reference", None, "base", f"{p.base}/{p.reference}")
        for x in self.list_masks():
            row("mask", x, "base", f"{p.base}/{x}")
        for section, kind in ((p.real, "real"), (p.synthetic, "synthetic")):
            for e in zarr.children(self.store, section):
                if e in self.entries or e in self.broken:
                    row("deformed", e, kind, f"{section}/{e}/{p.deformed}")
                    if kind == "synthetic":
                        row("flow", e, kind, f"{section}/{e}/{p.flow}")
        return self.spark.createDataFrame(rows, schema.CATALOG)

    def with_manifest(self, **changes) -> Dataset:
        return Dataset.open(self.spark, self.store, replace(self.manifest, **changes), strict=False)
