"""Campaign planning as DataFrames: sweep expansion, identity hashes, pending jobs, selection, latest results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def sweep(axes: list[DataFrame]) -> DataFrame:
    """The Cartesian product of one-column tables of values: a sweep is as many rows as asked for."""
    return reduce(lambda a, b: a.crossJoin(b), axes)


def canonical_json(columns: list[str]) -> Column:
    """{"a": 1, "b": "x"} with sorted keys and one space after colon and comma; text columns are quoted, null is null."""
    parts = []
    for c in sorted(columns):
        parts.append(F.concat(F.lit(f'"{c}": '), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def params_hash(json: Column) -> Column:
    """Eight hex digits of the SHA-256 of a parameter set."""
    return F.substring(F.sha2(json, 256), 1, 8)


def expand(points: DataFrame, explicit: DataFrame, params: list[str]) -> DataFrame:
    """Sweep points, then explicit variants; of equal parameter sets the first stays. Both need name and place (order)."""
    t = points.withColumn("part", F.lit(0)).unionByName(explicit.withColumn("part", F.lit(1)))
    t = t.withColumn("params_hash", params_hash(canonical_json(params)))
    w = Window.partitionBy("params_hash").orderBy("part", "place")
    t = t.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "part", "place")
    return t.withColumn("variant_id", F.concat_ws("-", "name", "params_hash"))


def pending(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs without a finished result of the same parameters."""
    done = results.where(F.col("status") == "ok").select("store", "deformation", "params_hash")
    return jobs.join(done, ["store", "deformation", "params_hash"], "left_anti")


def select(entries: DataFrame, names: DataFrame | None) -> DataFrame:
    """Entries by name, real before synthetic, names sorted; names that do not exist are skipped; None: all."""
    t = entries if names is None else entries.join(names.select("name"), "name", "left_semi")
    return t.orderBy(F.col("kind") != "real", "name")


def latest(results: DataFrame) -> DataFrame:
    """The last row written of each job: results are appended, reruns leave earlier rows."""
    w = Window.partitionBy("store", "deformation", "variant_id").orderBy(F.desc("written_at"), F.desc("row_id"))
    return results.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def missing_roles(catalog: DataFrame, required: list[str]) -> DataFrame:
    """entry, roles, missing (sorted) and status of each entry: healthy with all required roles, else broken."""
    g = catalog.groupBy("entry").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    lack = F.array_except(F.array(*[F.lit(r) for r in sorted(required)]), F.col("roles"))
    return g.select("entry", "roles", lack.alias("missing"), F.when(F.size(lack) == 0, "healthy").otherwise("broken").alias("status"))
