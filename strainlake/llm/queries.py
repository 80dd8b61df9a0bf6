"""The operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strainlake.llm.common import ship


def docs_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import quality

    j = quality.judge(docs_of(spark, sf_dir)).withColumn("host_rate", F.round("host_rate", 5))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", "host_ok")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import mixing

    m = mixing.mix(docs_of(spark, sf_dir))
    return m.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("prob", 6).alias("prob"), "selected")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import exact_dedup

    return exact_dedup.dedup(docs_of(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import jaccard

    return jaccard.join(docs_of(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import toxicity

    docs = docs_of(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, docs_of(spark, sf_dir, "labels")))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import ngram_lm

    return ngram_lm.score(docs_of(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import packing

    return packing.pack(docs_of(spark, sf_dir), vocabulary())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import line_dedup

    return line_dedup.dedup(docs_of(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import secret_scan

    return secret_scan.scan(docs_of(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import token_files

    return token_files.round_trip(docs_of(spark, sf_dir), vocabulary())


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import dual_tree

    return dual_tree.cluster(docs_of(spark, sf_dir, "embeddings"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strainlake.llm import word_bpe

    return word_bpe.digests(docs_of(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (op1_quality_rules, op2_mixing, op3_exact_dedup, op4_ngram_jaccard, op5_toxicity, op6_lm_scoring, op7_packing, op8_line_dedup, op9_secret_scan, op10_token_files, op11_dual_tree_lloyd, op12_word_bpe)
    return {f.__name__: f for f in all_of}


_OP3 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
h AS (SELECT doc_id, length(t) AS points, sha256(n) AS text_sha256 FROM t),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


_WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


#: The rules once more, as DuckDB has them, so that a wrong rule cannot be wrong on both sides.
_OP1_FAILS = {
    "too_short": "n_words < 50",
    "repetitive": "n_repeat_words > n_words / 2e0",
    "symbol_heavy": "n_symbols > n_words / 1e1",
    "duplicate_lines": "n_dup_lines * 1e1 > n_lines * 3e0",
    "word_length": "word_chars / 2e0 < n_words OR word_chars / 2e1 > n_words",
}


def _op1() -> str:
    names = list(_OP1_FAILS)
    fails = ", ".join(f"count(*) FILTER (WHERE {e}) AS k_{k}" for k, e in _OP1_FAILS.items())
    moments = ", ".join(f"avg(k_{k} / n) AS m_{k}, avg(power(k_{k} / n, 2)) - power(avg(k_{k} / n), 2) - avg(k_{k} / n) * (1 - avg(k_{k} / n)) * avg(1 / n) AS b_{k}" for k in names)
    strength = ", ".join(f"CASE WHEN b_{k} > 0 THEN least(1e9, greatest(1, m_{k} * (1 - m_{k}) / b_{k} - 1)) ELSE 1e9 END AS s_{k}" for k in names)
    rates = ", ".join(f"(k_{k} + m_{k} * s_{k}) / (n + s_{k}) AS r_{k}" for k in names)
    good = " AND ".join(f"r_{k} - 2.33e0 * sqrt(greatest(0e0, r_{k} * (1 - r_{k})) / (n + s_{k} + 1)) <= greatest(0.2e0, 2 * m_{k})" for k in names)
    return rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, {_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, sum(c) AS c FROM (SELECT doc_id, least(3, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 3)) AS c FROM dup) GROUP BY 1),
m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {fails} FROM m GROUP BY 1), q AS (SELECT {moments} FROM h), p AS (SELECT *, {strength} FROM h, q), u AS (SELECT *, {rates} FROM p),
v AS (SELECT host, {good} AS host_ok, round(greatest({', '.join(f'r_{k}' for k in names)}), 5) AS host_rate FROM u),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept, host_rate, host_ok FROM b JOIN v ON b.host IS NOT DISTINCT FROM v.host
"""


def _op2() -> str:
    from strainlake.llm import mixing

    dims = mixing.DIMENSIONS
    count = lambda p: f"(length(t) - length(regexp_replace(t, '{p}', '', 'g')))"
    ctes = [
        "d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents)",
        f"""m AS (SELECT doc_id, source, lang, CASE WHEN 20 * {count('[|]')} > greatest(length(t), 1) THEN 'table' WHEN 5 * {count('[0-9]')} > greatest(length(t), 1) THEN 'numbers' WHEN 20 * {count('[{}()<>=;#$%&*]')} > greatest(length(t), 1) THEN 'symbols' WHEN length(t) < 600 THEN 'short' ELSE 'prose' END AS topic, CAST(len({_WORDS}) AS BIGINT) AS n_tokens FROM d)""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM m GROUP BY ALL)",
        *[f"t_{x} AS (SELECT {x}, power(sum(tokens), {mixing.TEMPER[x]}e0) / sum(power(sum(tokens), {mixing.TEMPER[x]}e0)) OVER () AS s_{x} FROM c GROUP BY {x})" for x in dims],
        f"w AS (SELECT * FROM c {' '.join(f'JOIN t_{x} USING ({x})' for x in dims)})",
        # What each value's tokens allow, before any round.
        f"s0 AS (SELECT greatest({mixing.LEAST}e0, least({mixing.KEEP}e0, {', '.join(f'(SELECT min(x / s) FROM (SELECT sum(tokens) / (SELECT sum(tokens) FROM c) AS x, any_value(s_{x}) AS s FROM w GROUP BY {x}) WHERE x > 0 AND s > 0)' for x in dims)})) AS share, CAST('inf' AS DOUBLE) AS before, false AS done)",
        "w0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight, sum(tokens) OVER () AS total FROM w)",
    ]
    n, blocks = 0, mixing.MOST_ROUNDS // mixing.ROUNDS_A_PLAN
    for k in range(blocks):
        for _ in range(mixing.ROUNDS_A_PLAN):
            for x in dims:
                own = f"sum(weight) OVER (PARTITION BY {x})"
                ctes.append(f"w{n + 1} AS MATERIALIZED (SELECT w{n}.* REPLACE (CASE WHEN done THEN weight WHEN {own} > 0 THEN least(tokens / (total * share), weight * s_{x} / {own}) ELSE 0 END AS weight) FROM w{n}, s{k})")
                n += 1
        gap = ", ".join(f"(SELECT max(abs(x / (SELECT sum(weight) FROM w{n}) - s)) FROM (SELECT sum(weight) AS x, any_value(s_{x}) AS s FROM w{n} GROUP BY {x}))" for x in dims)
        ctes += [
            f"g{k} AS MATERIALIZED (SELECT greatest({gap}) AS gap)",
            f"e{k} AS MATERIALIZED (SELECT *, done OR gap <= {mixing.TOLERANCE!r} OR (share = {mixing.LEAST}e0 AND gap > 0.9e0 * before) AS stop FROM s{k}, g{k})",
            f"s{k + 1} AS MATERIALIZED (SELECT CASE WHEN NOT stop AND gap > before / 2 THEN greatest({mixing.LEAST}e0, share * {mixing.LOWER}e0) ELSE share END AS share, gap AS before, stop AS done FROM e{k})",
        ]
    ctes += [
        f"r AS (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio FROM w{n})",
        "o AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(tokens * ratio) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER () AS total FROM r)",
        f"k AS (SELECT (share * total - above) / rest AS c FROM o, s{blocks} WHERE rest > 0 AND (share * total - above) / rest * ratio <= 1 ORDER BY ratio DESC LIMIT 1)",
        "p AS (SELECT source, lang, topic, least(1, c * ratio) AS prob FROM r, k)",
    ]
    return f"""WITH {', '.join(ctes)} SELECT doc_id, source, lang, topic, n_tokens, round(prob, 6) AS prob, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 < prob AS selected FROM m JOIN p USING (source, lang, topic)"""


def _op11(rounds: int = 10) -> str:
    """Plain rounds: every vector against every centroid."""
    square = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = lambda n: f"a{n} AS MATERIALIZED (SELECT vid, vec_id, q, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.vid, v.vec_id, v.q, c.k, CAST({square} AS BIGINT) AS d FROM v, c{n} c) GROUP BY vid, vec_id, q)"
    ctes = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS vid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q FROM (SELECT q, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, q LIMIT 8))",
    ]
    for n in range(rounds):
        ctes += [
            nearest(n),
            f"s{n} AS (SELECT k, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT k, unnest(range(64)) AS i, unnest(q) AS x FROM a{n}) GROUP BY k, i)",
            # // truncates towards zero: one less where a negative sum leaves a rest.
            f"m{n} AS (SELECT k, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS q FROM s{n} GROUP BY k)",
            f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m USING (k))",
        ]
    ctes.append(nearest(rounds))
    return f"""WITH {', '.join(ctes)}
SELECT vec_id, CAST(a.k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1(), "op2_mixing": _op2(), "op3_exact_dedup": _OP3, "op11_dual_tree_lloyd": _op11()}
