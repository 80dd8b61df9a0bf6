"""A campaign as few plans: all pairs and mask thresholds of a store that share a lattice and a kernel are one correlation.

Each pair is a key of the exchange of blocks, so one shuffle serves all of them; each job is a key of the neighbourhood
test, the counts and the scores. How many Spark jobs run follows from the stores, the windows and the flows, not from the
variants. A chunk that cannot be read is a fault of the pairs that need it: their jobs fail, all others go on.
"""

from __future__ import annotations

import itertools
import logging
import traceback
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from strainlake.config import Lattice
from strainlake.functions.shipping import ship
from strainlake.functions.signal import distance_volume
from strainlake.functions.synth import flow_tables, sample_flow
from strainlake.operators import blocks as B, lattice as L, score
from strainlake.plans import campaign as C, correlate as P
from strainlake.sources.store import Dataset
from strainlake.sources.zarr_source import open_array

_log = logging.getLogger("strainlake.campaign")


class _Group:
    """Jobs of one store whose correlations differ in the pair and the mask threshold alone."""

    def __init__(self, spark: SparkSession, spec: C.Spec, jobs: list[C.Job], pairs: dict[str, object], shared: C._Shared, digits: int | None):
        self.spark, self.spec, self.jobs, self.shared, self.digits = spark, spec, jobs, shared, digits
        self.config = C.config_of(jobs[0].variant.params)
        load = [f"{j.deformation}|{j.variant.part(C.LOAD)}" for j in jobs]
        self.pair_of = load
        self.pairs = {k: pairs[k] for k in dict.fromkeys(load)}
        self.shape = next(iter(self.pairs.values())).shape
        self.lattice = Lattice(self.shape, self.config.window, self.config.overlap)
        rows = [(str(i), k, j.variant.params["mask_threshold"]) for i, (j, k) in enumerate(zip(jobs, load, strict=True))]
        self.table = F.broadcast(spark.createDataFrame(rows, "job string, pair string, threshold double"))  # a row for each job

    def union(self, tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables)

    def points(self) -> DataFrame:
        """pair, the lattice, and fraction: the mask's support, found once for each mask."""
        lattice = L.lattice_table(self.spark, self.lattice)
        frames = {k: p.stored.get("mr") for k, p in self.pairs.items()}
        own = self.spark.createDataFrame([(k, "|".join(m) if m else None) for k, m in frames.items()], "pair string, frame string")
        t = F.broadcast(own).crossJoin(lattice)
        masks = {"|".join(m): m for m in frames.values() if m}
        if not masks:
            return t.drop("frame").withColumn("fraction", F.lit(1.0))
        support = B.window_support(self.union([B.of_array(self.spark, *m, k)[0] for k, m in masks.items()]), self.lattice)
        found = t.join(support, ["frame", "poi"], "left")
        return found.withColumn("fraction", F.when(F.col("frame").isNull(), 1.0).otherwise(F.coalesce("fraction", F.lit(0.0)))).drop("frame")

    def peaks(self, points: DataFrame) -> DataFrame:
        """pair, poi, peaks and fault of every point that some threshold of its pair admits."""
        arrays, uses = {}, []
        for k, p in self.pairs.items():
            for role, a in p.stored.items():
                frame = "|".join(a)
                arrays[frame] = a
                uses.append((k, role, frame, *open_array(*a).chunks))
        least = self.table.groupBy("pair").agg(F.min("threshold").alias("least"))
        wanted = points.join(F.broadcast(least), "pair").where("fraction >= least").select(F.col("pair").alias("pair_id"), "poi")
        masked = "mr" in next(iter(self.pairs.values())).stored
        n = P.tile_size(self.spark, self.lattice, self.config, pairs=len(self.pairs))
        found = B.peaks(arrays, self.spark.createDataFrame(uses, B.USE), wanted, self.lattice, self.config, n, (masked, False), digits=self.digits, faults=True)
        return found.select(F.col("pair_id").alias("pair"), "poi", "dz", "dy", "dx", "confidence", "fault")

    def per_pair(self, make, scope_of) -> DataFrame | None:
        """make(pair), keyed by pair, written once for what scope_of names and reused in other groups."""
        tables = []
        for k, p in self.pairs.items():
            scope = scope_of(p, k)
            if scope is not None:
                t = self.shared.once("store", scope, lambda p=p: self.shared.keep("store", make(p)))
                tables.append(t.withColumn("pair", F.lit(k)))
        return self.union(tables) if tables else None

    def truth(self) -> DataFrame | None:
        grid = self.jobs[0].variant.part(C.GRID)

        def make(p):
            tables = self.shared.once("store", ("flow", p.name, flow[id(p)]), lambda: {a: self.shared.keep("store", t) for a, t in flow_tables(p.flow, p.shape).items()})
            return sample_flow(L.lattice_table(self.spark, self.lattice).select("poi", "pz", "py", "px"), tables, p.shape)

        flow = {id(p): k.split("|", 1)[1] for k, p in self.pairs.items()}
        return self.per_pair(make, lambda p, k: ("truth", k, grid) if p.flow is not None else None)

    def distances(self) -> DataFrame | None:
        grid = self.jobs[0].variant.part(C.GRID)

        def make(p):
            far = self.shared.once("store", ("far", *p.stored["mr"]), lambda: self.shared.keep("store", distance_volume(p.mask, p.shape)))
            at = L.lattice_table(self.spark, self.lattice).select("poi", "pz", "py", "px")
            return score.distance_to(at, p.mask, p.shape, distances=far).select("poi", "distance")

        return self.per_pair(make, lambda p, k: ("distance", *p.stored["mr"], grid) if p.mask is not None and p.flow is not None else None)

    def run(self) -> list[tuple[C.Job, dict]]:
        """The values of each job's row; fields and strata are written."""
        keep = lambda t: self.shared.keep("group", t)
        points = keep(self.points())
        found = keep(self.peaks(points))
        # One row for each broken pair.
        faults = {r["pair"]: r["fault"] for r in found.where("fault is not null").groupBy("pair").agg(F.min("fault").alias("fault")).collect()}
        sound = self.table.where(~F.col("pair").isin(list(faults))) if faults else self.table
        of_job = lambda t: t.join(F.broadcast(sound), "pair").withColumnRenamed("job", "pair_id")
        admitted = of_job(points).withColumn("admitted", F.col("fraction") >= F.col("threshold")).drop("pair", "threshold")
        f = keep(P.field(admitted, of_job(found).select("pair_id", "poi", "dz", "dy", "dx", "confidence"), self.config, None))
        counts = {r["pair_id"]: r.asDict() for r in score.status_counts(f, ("pair_id",)).collect()}  # a row for each job
        names = F.broadcast(self.spark.createDataFrame([(str(i), j.deformation, j.variant.variant_id) for i, j in enumerate(self.jobs)], "pair_id string, deformation string, variant_id string"))
        named = f.join(names, "pair_id").drop("pair_id").withColumnRenamed("deformation", "pair_id")
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair_id", "variant_id").parquet(C.fields_path(self.spec, self.jobs[0].store))
        scores = self.scores(f, sound, names)
        out = []
        for i, (job, pair) in enumerate(zip(self.jobs, self.pair_of, strict=True)):
            if pair in faults:
                out.append((job, {"status": "failed", "phase": "correlate", "error": faults[pair][-2000:]}))
            else:
                own = {k: v for k, v in counts[str(i)].items() if k != "pair_id"}
                out.append((job, own | {"status": "ok"} | (scores.get(str(i), {}) if own["n_ok"] else {})))
        return out

    def scores(self, f: DataFrame, sound: DataFrame, names: DataFrame) -> dict[str, dict]:
        truth = self.truth()
        if truth is None:
            return {}
        pair = sound.select(F.col("job").alias("pair_id"), "pair")
        scored = self.shared.keep("group", f.join(F.broadcast(pair), "pair_id").join(truth, ["pair", "poi"]))
        rho = score.spearman(score.errors(scored.where("valid")), "confidence", "norm", ("pair_id",))
        rows = score.report(scored, ("pair_id",)).join(rho, "pair_id", "left").collect()  # a row for each job
        far = self.distances() if self.spec.distance_bins else None
        if far is not None:
            table = score.strata(scored.join(far, ["pair", "poi"]), self.spec.distance_bins, keys=("pair_id",))
            table.join(names, "pair_id").drop("pair_id").coalesce(1).write.mode("append").parquet(f"{self.spec.out}/strata")
        return {r["pair_id"]: {"mae": r["mae"], "rmse": r["rmse"], "p95": r["p95"], "confidence_vs_error": r["rho"]} for r in rows}


def run(spark: SparkSession, spec: C.Spec, force: bool = False, only: dict[str, str] | None = None, stores: list[str] | None = None, observer: C.Observer | None = None, digits: int | None = None) -> DataFrame:
    """As campaign.run(), with the same results, fields and sidecars, in a number of plans that variants do not add to.

    Jobs of cropped pairs, of stores and pairs that cannot be opened, and of groups whose plan failed as a whole are left
    to campaign.run(), one after the other. A job that fails leaves a row, and the next call takes it up again.
    """
    observer = observer or C.Observer()
    ship(spark)
    datasets = {}
    for store in spec.stores:
        try:
            datasets[store] = Dataset.open(spark, store, spec.manifest, spec.strict)
        except Exception:  # campaign.run() notes it
            continue
    opened = C.Spec(**{**spec.__dict__, "stores": tuple(datasets)})
    jobs = C.plan(spark, opened, force, only, stores, datasets)
    own, shared, done = C.provenance(spark), C._Shared(), set()
    for store, of_store in itertools.groupby(jobs, key=lambda j: j.store):
        groups, pairs = {}, {}
        for j in of_store:
            p = j.variant.params
            key = f"{j.deformation}|{j.variant.part(C.LOAD)}"
            try:
                if key not in pairs:
                    pair = datasets[store].load_pair(j.deformation, p["mask"], p["dry_shape"], p["flow_convention"])
                    fits = pair.stored and all(tuple(open_array(*a).shape) == tuple(pair.shape) for a in pair.stored.values())
                    pairs[key] = pair if fits else None
            except Exception:
                pairs[key] = None
            if pairs[key] is not None:
                alike = (j.variant.part(tuple(k for k in C.GRID + C.COMPUTE if k != "mask_threshold")), "mr" in pairs[key].stored)
                groups.setdefault(alike, []).append(j)
        for group in groups.values():
            for j in group:
                observer.started(j)
            try:
                rows = _Group(spark, spec, group, pairs, shared, digits).run()
            except Exception:
                _log.warning("%s: %d jobs are run one by one, as their common plan failed:\n%s", store, len(group), traceback.format_exc()[-2000:])
                continue
            finally:
                shared.free("group")
            for (j, _), row in zip(rows, C.write_results(spark, spec, rows, own), strict=True):
                observer.ended(j, row)
            done |= {(j.store, j.deformation, j.variant.variant_id) for j in group}
        shared.free("store")
    return C.run(spark, spec, force, only, stores, observer, take=lambda j: (j.store, j.deformation, j.variant.variant_id) not in done)
