"""Mixing sources to target weights by iterative proportional fitting (raking), then calibrated sampling.

Token counts are summed to cells of (source, lang, topic); the cells' weights are raked until their sums over each
dimension meet the targets; each cell's keep probability is proportional to weight over tokens, capped at 1 and scaled
so that the expected tokens are a set share of all. The cap holds within the raking, until the targets are met; the
kept share is lowered where they need it, down to a floor, and a gap that remains is logged. A document stays when a
hash of its id falls below its probability. Native: DataFrame functions only; the text is read once, all later steps
see one row per cell.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window, functions as F

from strainlake.llm.common import free, words, written

DIMENSIONS = ("source", "lang", "topic")
#: Without given targets a dimension's shares are its token shares to this power, scaled to 1: below 1 flattens.
TEMPER = {"source": 0.7, "lang": 0.9, "topic": 0.95}
KEEP = 0.9
#: Rounds in one plan: each is a window over every dimension, on cells alone.
ROUNDS_A_PLAN = 4
#: Targets count as met within this share; rounds after which raking gives up; the floor of a lowered kept share.
TOLERANCE = 1e-4
MOST_ROUNDS = 60
LEAST = 0.5
#: The kept share falls by this factor when raking under the cap no longer halves the gap.
LOWER = 0.97
#: Up to so many cells the probabilities are broadcast; beyond, the join is salted.
BROADCAST_CELLS = 50_000
SALTS = 32


def form(text: Column) -> Column:
    """A topic for texts that carry none: what the text is mostly made of."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    return (
        F.when(20 * F.regexp_count(t, F.lit(r"\|")) > n, "table")
        .when(5 * F.regexp_count(t, F.lit("[0-9]")) > n, "numbers")
        .when(20 * F.regexp_count(t, F.lit(r"[{}()<>=;#$%&*]")) > n, "symbols")
        .when(F.length(t) < 600, "short")
        .otherwise("prose")
    )


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) drawn from the id alone: eight hex digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _targets(cells: DataFrame, targets: dict[str, dict[str, float]], temper: dict[str, float]) -> DataFrame:
    """cells with a target share t_<dim> of each dimension."""
    for dim in DIMENSIONS:
        by = Window.partitionBy(dim)
        if dim in targets:
            given = targets[dim]
            pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))]
            cells = cells.withColumn(f"t_{dim}", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(dim)), F.lit(0.0)) if pairs else F.lit(0.0))
        else:
            cells = cells.withColumn(f"t_{dim}", F.pow(F.sum("tokens").over(by), F.lit(temper.get(dim, 1.0))))
    sums = {}
    for dim in DIMENSIONS:  # one row each: the sum over a dimension's values
        sums[dim] = cells.groupBy(dim).agg(F.first(f"t_{dim}").alias("t")).agg(F.sum("t")).first()[0] or 1.0
    return cells.select("*", *[(F.col(f"t_{d}") / F.lit(sums[d])).alias(f"s_{d}") for d in DIMENSIONS]).drop(*[f"t_{d}" for d in DIMENSIONS])


def gaps(cells: DataFrame, amount: Column) -> dict[str, float]:
    """Dimension -> largest distance of a value's share of amount from its target s_<dim>."""
    out = {}
    for dim in DIMENSIONS:
        by = cells.groupBy(dim).agg(F.sum(amount).alias("x"), F.first(f"s_{dim}").alias("s"))
        total = by.agg(F.sum("x")).first()[0] or 1.0
        out[dim] = by.agg(F.max(F.abs(F.col("x") / F.lit(float(total)) - F.col("s")))).first()[0] or 0.0
    return out


def rake(cells: DataFrame, keep: float = KEEP, least: float = LEAST, rounds: int = MOST_ROUNDS) -> tuple[DataFrame, float]:
    """cells (source, lang, topic, tokens, s_<dim>) with weight, and the kept share.

    Weights are shares of 1 whose marginals approach s_<dim>, at most tokens / (kept share x all tokens) each. The share starts at what each value's tokens allow, and is lowered to least at most while the targets are not met.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.withColumn("weight", F.lit(0.0)), keep
    share = keep
    for dim in DIMENSIONS:
        by = cells.groupBy(dim).agg((F.sum("tokens") / F.lit(total)).alias("x"), F.first(f"s_{dim}").alias("s"))
        share = min(share, by.where("x > 0 AND s > 0").agg(F.min(F.col("x") / F.col("s"))).first()[0] or share)
    least = min(least, keep)
    share = max(share, least)
    cells = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    before = float("inf")
    for begin in range(0, rounds, ROUNDS_A_PLAN):
        cap = F.col("tokens") / F.lit(total * share)
        for _ in range(min(ROUNDS_A_PLAN, rounds - begin)):
            for dim in DIMENSIONS:
                own = F.sum("weight").over(Window.partitionBy(dim))
                cells = cells.withColumn("weight", F.when(own > 0, F.least(cap, F.col("weight") * F.col(f"s_{dim}") / own)).otherwise(0.0))
        cells = written(cells, "raked")
        gap = max(gaps(cells, F.col("weight")).values())
        if gap <= TOLERANCE or (share == least and gap > 0.9 * before):
            break
        if gap > before / 2:
            share = max(least, share * LOWER)
        before = gap
    return cells, share


def calibrated(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """cells with prob = min(1, c weight / tokens), where c makes the expected tokens keep x all tokens."""
    cells = cells.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    total, top, least = cells.agg(F.sum("tokens"), F.max("ratio"), F.min(F.when(F.col("ratio") > 0, F.col("ratio")))).first()
    if not total or not top:
        return cells.withColumn("prob", F.lit(1.0) if not total else F.lit(0.0))
    budget, lo, hi = keep * total, 0.0, 2 / least
    for _ in range(4):  # a grid narrows the bracket; then c is exact for the cells that are capped
        grid = [lo + (hi - lo) * (i / 64) ** (4 if lo == 0 else 1) for i in range(1, 65)]
        kept = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("ratio") * F.lit(c))) for c in grid]).first()
        i = next((i for i, x in enumerate(kept) if x >= budget), 63)
        lo, hi = (grid[i - 1] if i else lo), grid[i]
    capped, open_ = cells.agg(F.sum(F.when(F.col("ratio") * F.lit(hi) >= 1, F.col("tokens")).otherwise(0)), F.sum(F.when(F.col("ratio") * F.lit(hi) < 1, F.col("tokens") * F.col("ratio")).otherwise(0.0))).first()
    c = (budget - capped) / open_ if open_ else hi
    return cells.withColumn("prob", F.least(F.lit(1.0), F.col("ratio") * F.lit(float(c))))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | str | None = None,
    targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, keep: float = KEEP, rounds: int = MOST_ROUNDS,
    least: float = LEAST,
) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight (of its cell), prob, selected.

    The targets are met under the cap, for which the kept share may fall from keep to least; what is left of a gap after
    so many rounds is logged.
    A null source, language or topic counts as ''; a null text has no tokens. Cells without tokens have probability 0
    unless no cell has any: then all stay. Texts of any length are counted whole. Rows with one id share their fate, null
    ids one of their own; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    at = F.col(topic) if isinstance(topic, str) else form(F.col(text)) if topic is None else topic
    d = docs.select(
        F.col(doc_id).alias("doc_id"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((F.col(source), "source"), (F.col(lang), "lang"), (at, "topic"))],
        F.coalesce(F.size(words(F.coalesce(F.col(text), F.lit("")))), F.lit(0)).cast("long").alias("n_tokens"),
    )
    d = written(d, "measured")
    cells = d.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    cells = written(_targets(written(cells, "cells"), targets or {}, temper), "targets")
    raked, share = rake(cells, keep, least, rounds)
    cells = written(calibrated(raked, share), "probabilities")
    gap = gaps(cells, F.col("tokens") * F.col("prob"))
    logging.getLogger(__name__).log(logging.WARNING if max(gap.values()) > TOLERANCE else logging.INFO, "kept share %.4f of tokens, gaps to the targets %s", share, gap)
    cells = cells.select(*DIMENSIONS, "weight", "prob")
    if cells.count() <= BROADCAST_CELLS:
        out = d.join(F.broadcast(cells), list(DIMENSIONS))
    else:
        salted = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = d.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*DIMENSIONS, "salt"])
    return out.select("doc_id", *DIMENSIONS, "n_tokens", "weight", "prob", (uniform(F.col("doc_id")) < F.col("prob")).alias("selected"))


def kept(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns as they are, that mix() selects."""
    (stay,) = free(docs, "stay")
    ids = mix(docs, doc_id, **options).where("selected").select(F.col("doc_id").alias(stay)).distinct()
    return docs.join(ids, F.col(doc_id).eqNullSafe(F.col(stay)), "left_semi")
