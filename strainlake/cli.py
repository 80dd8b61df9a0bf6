"""Command line: inspect a store, plan memory, correlate one pair, run a campaign.

python -m strainlake.cli inspect STORE [--json] [--verbose] [--manifest FILE]
python -m strainlake.cli budget --shape Z Y X --window W [--mode M --normalization N --free-gib G]
python -m strainlake.cli pair STORE DEFORMATION [--window W ...] [--overlap F] [--mask NAME] [--threshold F] [--out FOLDER] [--json]
python -m strainlake.cli run SPEC [--dry-run] [--force] [--only KEY=VALUE ...] [--store NAME ...] [--quiet]

Exit codes: 0 fine, 1 found errors, 2 could not start.
"""

from __future__ import annotations

import argparse
import json
import resource
import sys
import time

from strainlake.plans import budget, campaign, together
from strainlake.sources.store import Dataset, MalformedStore, Manifest


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("strainlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def inspect(args) -> int:
    try:
        manifest = Manifest.from_yaml(args.manifest) if args.manifest else None
        ds = Dataset.open(session(), args.store, manifest, strict=False)
    except (MalformedStore, FileNotFoundError, ValueError, KeyError, LookupError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    told = {"store": ds.store, "profile": ds.profile.name, "shape": list(ds.shape), "masks": ds.list_masks(), "default_mask": ds.default_mask, "real": ds.list_real(), "synthetic": ds.list_synthetic(), "broken": ds.broken, "ok": ds.report.ok, "errors": ds.report.errors}
    if args.verbose:
        told["arrays"] = [r.asDict() for r in ds.catalog().collect()]
    if args.json:
        print(json.dumps(told, indent=2))
    else:
        for k, v in told.items():
            print(f"{k}: {v}" if not isinstance(v, list) or k == "shape" else f"{k}: {len(v)}" + "".join(f"\n  {x}" for x in v))
    return 0 if ds.report.ok else 1


def plan_memory(args) -> int:
    try:
        f = budget.footprint(args.window[0] if len(args.window) == 1 else tuple(args.window), args.mode, args.normalization)
        batch = budget.largest_batch(int(args.free_gib * 2**30), tuple(args.shape), args.window[0] if len(args.window) == 1 else tuple(args.window), args.mode, args.normalization, args.distinct_deformed_mask, args.headroom)
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    told = {"resident_bytes": budget.resident(tuple(args.shape), args.distinct_deformed_mask), "bytes_per_window": f.per_point, "fixed_bytes": f.once, "batch": batch}
    print(json.dumps(told) if args.json else "\n".join(f"{k}: {v}" for k, v in told.items()))
    return 0


def pair(args) -> int:
    """One pair from end to end: seconds and the driver's peak memory by phase, counts, magnitudes, and errors where the truth is known."""
    from strainlake.config import CorrelateConfig, Lattice
    from strainlake.functions.shipping import shared_folder, ship
    from strainlake.functions.synth import sample_flow
    from strainlake.operators import score
    from strainlake.plans.correlate import correlate_pair
    from strainlake.sources import fieldstore

    told: dict = {"store": args.store, "deformation": args.deformation, "phases": {}}
    began = time.time()

    def ended(phase: str) -> None:
        nonlocal began
        told["phases"][phase] = {"seconds": round(time.time() - began, 3), "peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}
        began = time.time()

    spark = session()
    try:
        config = CorrelateConfig(args.window[0] if len(args.window) == 1 else tuple(args.window), args.overlap, args.threshold)
        p = Dataset.open(spark, args.store, strict=False).load_pair(args.deformation, args.mask)
        Lattice(p.shape, config.window, config.overlap)
    except (MalformedStore, FileNotFoundError, ValueError, KeyError, LookupError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    ship(spark)
    ended("open")
    f = correlate_pair(p, config)
    out = args.out or shared_folder(spark, "pair")
    fieldstore.save(f, out)
    f = fieldstore.load(spark, out, p.name, "base")
    ended("correlate")
    told |= {"field": out, "counts": score.status_counts(f).first().asDict(), "magnitudes": score.magnitudes(f).first().asDict()}
    ended("report")
    if p.flow is not None and told["counts"]["n_ok"]:
        told["errors"] = score.report(f.join(sample_flow(f.select("poi", "pz", "py", "px"), p.flow, p.shape), "poi")).first().asDict()
        ended("evaluate")
    print(json.dumps(campaign.jsonable(told), indent=2) if args.json else "\n".join(f"{k}: {v}" for k, v in told.items()))
    return 0


class _Printed(campaign.Observer):
    def planned(self, jobs):
        print(f"{len(jobs)} jobs")

    def ended(self, job, row):
        print(f"{job.deformation} {job.variant.variant_id}: {row['status']}" + (f" mae {row['mae']:.4f}" if row["mae"] is not None else "") + (f" in {row['phase']}" if row["phase"] else ""))


def run(args) -> int:
    try:
        spec = campaign.Spec.from_yaml(args.spec)
        only = dict(x.split("=", 1) for x in args.only)
        spark = session()
        if args.dry_run:
            for j in campaign.plan(spark, spec, args.force, only, args.store):
                print(j.store, j.deformation, j.variant.variant_id)
            return 0
    except (ValueError, FileNotFoundError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    rows = (together if args.together else campaign).run(spark, spec, args.force, only, args.store, campaign.Observer() if args.quiet else _Printed())
    return 1 if rows.where("status = 'failed'").limit(1).count() else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strainlake")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("inspect")
    i.add_argument("store")
    i.add_argument("--manifest")
    i.add_argument("--json", action="store_true")
    i.add_argument("--verbose", action="store_true")
    i.set_defaults(do=inspect)
    b = sub.add_parser("budget")
    b.add_argument("--shape", nargs=3, type=int, required=True)
    b.add_argument("--window", nargs="+", type=int, default=[96])
    b.add_argument("--mode", default="linear")
    b.add_argument("--normalization", default="overlap")
    b.add_argument("--free-gib", type=float, default=48)
    b.add_argument("--headroom", type=float, default=0.15)
    b.add_argument("--distinct-deformed-mask", action="store_true")
    b.add_argument("--json", action="store_true")
    b.set_defaults(do=plan_memory)
    o = sub.add_parser("pair")
    o.add_argument("store")
    o.add_argument("deformation")
    o.add_argument("--window", nargs="+", type=int, default=[96])
    o.add_argument("--overlap", type=float, default=0.5)
    o.add_argument("--mask")
    o.add_argument("--threshold", type=float, default=0.9)
    o.add_argument("--out")
    o.add_argument("--json", action="store_true")
    o.set_defaults(do=pair)
    r = sub.add_parser("run")
    r.add_argument("spec")
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--force", action="store_true")
    r.add_argument("--only", nargs="*", default=[])
    r.add_argument("--store", nargs="*", default=None)
    r.add_argument("--quiet", action="store_true")
    r.add_argument("--together", action="store_true", help="all pairs and thresholds of a store in one plan")
    r.set_defaults(do=run)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.do(args)


__all__ = ["main", "parser"]

if __name__ == "__main__":
    sys.exit(main())
