"""DuckDB SQL for the quality rules: the counts anew, then the same estimate step by step."""

from __future__ import annotations

from chronoplane.llm.quality import MIN_GROUP, P, PAIRS, SUPPORT, better_sql, bin_sql, covariance_sql, deviation_sql, distance_sql, inverse_factor_sql, pulled_sql, vector_sql, verdict_sql

_COUNTS = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams),
cover AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY 1),
counted AS (SELECT d.rid, doc_id, coalesce('=' || lang, '-') AS pool, coalesce('=' || source, '-') AS src, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(t) - length(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g')) AS BIGINT) AS n_marks,
    CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN cover c ON c.rid = d.rid),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)"""


#: Steps written out; a start that has ended repeats itself, so more do no harm.
STEPS = 24


def quality_sql() -> str:
    xs = ", ".join(f"{x} AS x{j}" for j, x in enumerate(vector_sql()))
    every = range(P)
    start = ["m%d" % j for j in every] + [f"i{i}{j}" for i, j in PAIRS]
    totals = [f"t{j}" for j in every] + [f"t{i}{j}" for i, j in PAIRS]
    sums = ", ".join([f"sum(x{j}) AS t{j}" for j in every] + [f"sum(x{i} * x{j}) AS t{i}{j}" for i, j in PAIRS])
    doubles = ", ".join(f"CAST(sum({t}) AS DOUBLE) AS {t}" for t in totals)
    factor = ", ".join(f"{e} AS {a}" for a, e in inverse_factor_sql())
    covariance = ", ".join([f"t{j} / n AS m{j}" for j in every] + [f"{covariance_sql(i, j)} AS c{i}{j}" for i, j in PAIRS])
    parts = [
        ("v", f"SELECT rid, pool, src, n_words, {xs} FROM based WHERE NOT base_failed"),
        ("u", "SELECT DISTINCT pool, src, " + ", ".join(f"x{j}" for j in every) + " FROM v"),
        ("sized", "SELECT pool, src, count(*) AS n, sum(count(*)) OVER (PARTITION BY pool) AS m FROM u GROUP BY 1, 2"),
        ("judges", f"SELECT pool, src, CASE WHEN n >= {MIN_GROUP} THEN 'g' || pool || chr(1) || src WHEN m >= {MIN_GROUP} THEN 'p' || pool ELSE 'a' END AS g FROM sized"),
        ("f", "SELECT u.*, e.g FROM u, (SELECT DISTINCT g FROM judges) e WHERE e.g IN ('a', 'p' || pool, 'g' || pool || chr(1) || src)"),
        ("mid", "SELECT g, " + ", ".join(f"quantile_disc(x{j}, 0.5) AS m{j}" for j in every) + " FROM f GROUP BY 1"),
        ("dev", "SELECT g, " + ", ".join(f"quantile_disc(abs(x{j} - m{j}), 0.5) AS s{j}" for j in every) + " FROM f JOIN mid USING (g) GROUP BY 1"),
        ("middle", "SELECT *, " + ", ".join(f"{deviation_sql(j)} AS r{j}" for j in every) + " FROM mid JOIN dev USING (g)"),
        ("others", "SELECT g, 1 AS s, " + ", ".join(f"x{j}" for j in every) + " FROM f UNION ALL SELECT g, 2, " + ", ".join(pulled_sql(j) for j in every) + " FROM f JOIN middle USING (g)"),
        ("osum", f"SELECT g, s, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'CAST(sum({e}) AS DOUBLE) AS {t}' for t, e in zip(totals, [f'x{j}' for j in every] + [f'x{i} * x{j}' for i, j in PAIRS]))} FROM others GROUP BY 1, 2"),
        ("ocov", f"SELECT g, s, {covariance} FROM osum"),
        ("omodel", f"SELECT *, {factor} FROM ocov"),
        (
            "model0",
            "SELECT g, 0 AS s, " + ", ".join([f"CAST(m{j} AS DOUBLE) AS m{j}" for j in every] + [(f"1e0 / r{j}" if i == j else "0e0") + f" AS i{i}{j}" for i, j in PAIRS]) + ", CAST('inf' AS DOUBLE) AS d FROM middle "
            f"UNION ALL SELECT g, s, {', '.join(start)}, CAST('inf' AS DOUBLE) FROM omodel",
        ),
    ]
    for k in range(STEPS):
        parts += [
            (f"cell{k}", f"SELECT g, s, {bin_sql(distance_sql())} AS b, count(*) AS n, {sums} FROM f JOIN model{k} USING (g) GROUP BY 1, 2, 3"),
            (f"near{k}", f"SELECT *, sum(n) OVER (PARTITION BY g, s ORDER BY b ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY g, s) AS every FROM cell{k}"),
            (f"sum{k}", f"SELECT g, s, CAST(sum(n) AS DOUBLE) AS n, {doubles} FROM near{k} WHERE before < {SUPPORT}e0 * every GROUP BY 1, 2"),
            (f"cov{k}", f"SELECT g, s, {covariance} FROM sum{k}"),
            (f"new{k}", f"SELECT *, {factor} FROM cov{k}"),
            (f"model{k + 1}", "SELECT g, s, " + ", ".join(f"CASE WHEN {better_sql('b.d', 'a.d')} THEN b.{c} ELSE a.{c} END AS {c}" for c in [*start, "d"]) + f" FROM model{k} a JOIN new{k} b USING (g, s)"),
        ]
    parts += [
        ("best", f"SELECT * FROM model{STEPS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY d, s) = 1"),
        ("far", f"SELECT v.rid, {verdict_sql(distance_sql())} AS near FROM v JOIN judges USING (pool, src) JOIN best USING (g)"),
    ]
    return (
        "WITH " + _COUNTS.strip() + ",\n" + ",\n".join(f"{name} AS MATERIALIZED ({query})" for name, query in parts) + "\n"
        "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
        "NOT base_failed AND near AS kept FROM based LEFT JOIN far USING (rid)"
    )
