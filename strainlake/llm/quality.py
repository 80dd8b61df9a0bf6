"""Quality rules at host level: rule failures per host, rates shrunk by an empirical beta prior, verdicts joined back.

Native: DataFrame functions only. The text is read once; what later steps need of it is one short row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strainlake.llm.common import words, written

SYMBOLS = r"[#*$%&|<>]"
#: Rules on the measured columns. A host is judged by the share of its documents that fail each of them.
RULES = {
    "too_short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}
#: A host is rejected when a rule's shrunk failure rate lies Z posterior standard deviations above TIMES the mean rate of
#: all hosts, and above LEAST: credibly a worse host than others, and one that fails often.
Z, TIMES, LEAST = 2.33, 2.0, 0.2
#: Up to so many hosts the verdicts are broadcast; beyond, the join is salted.
BROADCAST_HOSTS = 10_000
SALTS = 32


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: Column | str = "source") -> DataFrame:
    """doc_id, host and the text's measures: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text has no words. Repeated rows are measured each for itself; other columns are ignored.
    """
    host = F.col(host) if isinstance(host, str) else host
    d = docs.select(F.col(doc_id).alias("doc_id"), host.cast("string").alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("w", words(F.col("t")))
    w = F.col("w")
    triples = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    d = d.select(
        "doc_id",
        "host",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size(w) >= 3, triples).otherwise(F.array().cast("array<string>")).alias("tri"),
    )
    # Only a text with an equal pair of windows is worth sorting.
    tri, at = F.col("tri"), F.col("at")
    d = d.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(tri)) < F.size(tri), F.sort_array(F.transform(tri, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))).alias("at"),
    )
    same = lambda i, j: F.coalesce(F.get(at, i)["t"] == F.get(at, j)["t"], F.lit(False))
    d = d.withColumn(
        "at",
        F.when(
            at.isNotNull(),
            F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(at, i)["i"])),
        ),
    )
    # Sorted window starts: each covers three words, less what the next start covers again.
    covered = F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(3).cast("long"), lambda n, i: n + F.least(F.lit(3), F.get(at, i) - F.get(at, i - 1)).cast("long"))
    return d.withColumn("n_repeat_words", F.when(F.size(at) >= 2, covered).otherwise(F.lit(0).cast("long"))).drop("at")


def host_rates(measured: DataFrame, rules: dict[str, str] = RULES, z: float = Z, times: float = TIMES, least: float = LEAST) -> DataFrame:
    """One row per host and rule: documents n, failures k, shrunk rate, its credible lower bound, and the limit of that.

    The prior's mean m and strength come from the hosts themselves by moments: strength m(1-m)/v - 1, where v is the
    spread of the host rates beyond what drawing documents explains. Without such spread all hosts get the mean. The
    bound lies z posterior standard deviations below the rate; the limit is times the mean, least at the lowest.
    """
    fails = [F.count_if(F.coalesce(F.expr(e), F.lit(False))).alias(k) for k, e in rules.items()]
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *fails)
    moments = hosts.agg(
        F.count("*").alias("hosts"),
        *[F.expr(f"avg({k} / n)").alias(f"{k}_m") for k in rules],
        *[F.expr(f"avg(power({k} / n, 2)) - power(avg({k} / n), 2)").alias(f"{k}_v") for k in rules],
        F.avg(1 / F.col("n")).alias("inv_n"),
    ).first()
    rows = []
    for k in rules:
        m, v = float(moments[f"{k}_m"] or 0), float(moments[f"{k}_v"] or 0)
        between = v - m * (1 - m) * float(moments["inv_n"] or 0)
        strength = min(1e9, max(1.0, m * (1 - m) / between - 1)) if between > 0 else 1e9
        weight = F.col("n") + F.lit(strength)
        rows.append(F.struct(F.lit(k).alias("rule"), F.col(k).alias("k"), ((F.col(k) + F.lit(m * strength)) / weight).alias("rate"), weight.alias("weight"), F.lit(max(least, times * m)).alias("limit")))
    out = hosts.select("host", "n", F.explode(F.array(*rows)).alias("r")).select("host", "n", "r.*")
    rate = F.col("rate")
    return out.withColumn("bound", rate - F.lit(z) * F.sqrt(F.greatest(F.lit(0.0), rate * (1 - rate)) / (F.col("weight") + 1))).drop("weight")


def host_verdicts(measured: DataFrame, rules: dict[str, str] = RULES, z: float = Z, times: float = TIMES, least: float = LEAST) -> DataFrame:
    """host, host_rate (the worst shrunk rate) and host_ok: no rule's rate is credibly over its limit."""
    by = host_rates(measured, rules, z, times, least).groupBy("host")
    return by.agg(F.max("rate").alias("host_rate"), F.min(F.col("bound") <= F.col("limit")).alias("host_ok"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: Column | str = "source", rules: dict[str, str] = RULES, z: float = Z, times: float = TIMES, least: float = LEAST) -> DataFrame:
    """One row per document with its measures, base_failed, its host's verdict, and kept.

    Null text: no words, so it fails. A null host is a host of its own. Repeated rows stay repeated; an empty table
    gives no rows; columns other than the three named are ignored.
    """
    m = written(measure(docs, doc_id, text, host), "quality")
    verdicts = host_verdicts(m, rules, z, times, least)
    if m.select("host").distinct().limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = m.alias("m").join(F.broadcast(verdicts.withColumnRenamed("host", "h")), F.col("host").eqNullSafe(F.col("h")), "left")
    else:  # a hot host's documents are dealt over SALTS keys
        salted = verdicts.select(F.col("host").alias("h"), "host_rate", "host_ok", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("hs"))
        joined = m.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, F.col("host").eqNullSafe(F.col("h")) & (F.col("s") == F.col("hs")), "left")
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "host_rate", "host_ok", (~base & F.coalesce(F.col("host_ok"), F.lit(True))).alias("kept"),
    )
