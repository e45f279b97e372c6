"""Quality rules: fixed base rules, then robust multivariate outliers.

Every text gets counts (words, distinct words, marks, symbols, repeated lines,
repeated 3-word windows).  Texts that pass the base rules become vectors of logs:
length, word length, share of marks, distinct words.  Each varies in ordinary texts,
so each has a scatter to estimate: per language and source a
minimum-covariance-determinant estimate gives their centre and scatter, and a vector
far away by Mahalanobis distance is rejected.  How many distinct words a text should
have follows from its length by their covariance.

A short text's shares are noisy: its squared distance counts by the share
``n_words / (n_words + SHORT)``.  Equal vectors of a group count once in the estimate,
so copies of a text don't make a group look tighter than it is.

The estimate is the deterministic kind.  Three starts per group (coordinate-wise
medians and median absolute deviations; mean and covariance of all rows; the same
of rows pulled in to two deviations) run concentration steps.  A step measures all
distances, takes the nearest ``SUPPORT`` share of the group, and refits on it.  A
start ends when its determinant hardly falls any more, and the start with the least
determinant is the group's estimate.  Distances are binned on a fixed logarithmic
grid, so the share is the smallest whole number of bins that holds it, and one
aggregation by group, start and bin yields both the threshold and the moments.
Values are whole numbers on a grid of ``1 / GRID``, so their sums are exact and
don't depend on the order of rows.  Everything is DataFrame expressions.

A group with fewer than ``MIN_GROUP`` distinct vectors is judged by the estimate of its whole
language, and a language with fewer by that of all rows, so every row that passes
the base rules is judged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.llm.shared import WORD, materialize, packed

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"

#: Share of a group that a concentration step keeps.
SUPPORT = 0.75
#: A smaller group is judged by the next wider estimate.
MIN_GROUP = 60
#: Tail of the chi-square distribution beyond which a vector is an outlier.
TAIL = 1e-6
GRID = 4096
#: Least deviations, for groups whose texts hardly differ, which would have no inverse: 1 % in
#: length, word length and distinct words; and a mark in 600 characters, where texts have none.
LEAST = (0.01, 0.01, 0.03, 0.01)
P = len(LEAST)
#: Words at which a text's distance counts by half.
SHORT = 200
#: ASCII marks that are no letters, digits or spaces.
MARKS = r"[!-/:-@\[-`{-~]"
#: A start ends when a step lowers its determinant by no more than this part.
FALL = 0.001
#: A group's rows meet its model in this many parts, so no task takes a group whole.
PARTS = 32
BINS_PER_OCTAVE = 16


def _chi2_cdf(x: float, df: int) -> float:
    """Regularised lower incomplete gamma by its series."""
    a, half = df / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= half / n
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, df) < p else (lo, mid)
    return hi


#: Scales the covariance of the nearest SUPPORT share of a normal cloud up to the whole.
CONSISTENCY = SUPPORT / _chi2_cdf(chi2_quantile(SUPPORT, P), P + 2)
CUTOFF = chi2_quantile(1 - TAIL, P)


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts of the text column; a null text has no words."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("w", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    out = out.withColumn("n_words", F.size("w").cast("long"))
    out = out.withColumn(
        "h",
        F.when(
            F.col("n_words") >= 3,
            F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2))),
        ),
    )
    # Only texts with a repeated window pay for the sort.
    out = out.withColumn("s", F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("s", lambda x, j: same(x, j + 1) | same(x, j - 1))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    return (
        out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
        .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
        .withColumn("n_distinct", F.size(F.array_distinct("w")).cast("long"))
        .withColumn("n_marks", F.regexp_count(body, F.lit(MARKS)).cast("long"))
        .withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
        .withColumn("lines", lines)
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .drop("w", "h", "s", "lines")
    )


def vector_sql() -> list[str]:
    """The coordinates as whole numbers on the grid; valid in Spark and DuckDB."""
    raw = [
        "ln(1e0 + n_words)",
        "ln(CAST(word_chars AS DOUBLE) / n_words)",
        "ln(0.05e0 + CAST(n_marks AS DOUBLE) / word_chars)",
        "ln(1e0 + n_distinct)",
    ]
    return [f"CAST(floor({GRID}e0 * CAST({x} AS DOUBLE) + 0.5e0) AS BIGINT)" for x in raw]


def distance_sql() -> str:
    """Squared Mahalanobis distance from means m* and the inverse Cholesky factor i*."""
    rows = [" + ".join(f"i{k}{j} * (x{j} - m{j})" for j in range(k + 1)) for k in range(P)]
    return " + ".join(f"({r}) * ({r})" for r in rows)


def bin_sql(d2: str) -> str:
    return f"CAST(floor({BINS_PER_OCTAVE}e0 * ln(({d2}) + 0.0009765625e0) / ln(2e0)) AS BIGINT)"


def inverse_factor_sql() -> list[tuple[str, str]]:
    """(alias, expression) in order: Cholesky factor l*, then its inverse i*, from c*."""
    out = []
    for j in range(P):
        out.append((f"l{j}{j}", f"sqrt(greatest(c{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j)) + f", {float((LEAST[j] * GRID) ** 2)!r}e0))"))
        for i in range(j + 1, P):
            out.append((f"l{i}{j}", f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j}"))
    for j in range(P):
        out.append((f"i{j}{j}", f"1e0 / l{j}{j}"))
        for i in range(j + 1, P):
            out.append((f"i{i}{j}", "-(" + " + ".join(f"l{i}{k} * i{k}{j}" for k in range(j, i)) + f") / l{i}{i}"))
    out.append(("d", " * ".join(f"l{j}{j}" for j in range(P))))
    return out


def _group(lang: str, source: str) -> tuple[Column, Column]:
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.concat(F.length(tag(lang)), F.lit(":"), tag(lang), tag(source)), tag(lang)


def _vectors(counted: DataFrame) -> DataFrame:
    """g, pool, x0.. of each row that passes the base rules."""
    fine, pool = _group("lang", "source")
    some = counted.where(~F.col("base_failed"))
    return some.select(fine.alias("fine"), pool.alias("pool"), *[F.expr(x).alias(f"x{j}") for j, x in enumerate(vector_sql())])


def _groups(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fine -> g that judges its rows, fine -> every g that its rows feed).

    One row per language and source; the few languages meet in one task.
    """
    sizes = materialize(vectors.groupBy("fine", "pool").agg(F.count(F.lit(1)).alias("n")), "sizes")
    pools = sizes.groupBy("pool").agg(F.sum("n").alias("m"))
    own, pool = F.concat(F.lit("g"), F.col("fine")), F.concat(F.lit("p"), F.col("pool"))
    judge = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("m") >= MIN_GROUP, pool).otherwise(F.lit("a"))
    judged = materialize(sizes.join(pools, "pool").select("fine", "pool", judge.alias("g")), "groups")
    used = judged.select("g").distinct()
    feeds = judged.select("fine", F.explode(F.array(own, pool, F.lit("a"))).alias("g")).join(used, "g", "left_semi")
    return judged.select("fine", "g"), materialize(feeds, "feeds")


def _middle(values: DataFrame) -> DataFrame:
    """Per g and coordinate j, the lower median of the whole number v.

    Counts per value meet, not rows; the number of values is bounded by the grid.
    """
    counts = values.groupBy("g", "j", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("g", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("g", "j")
    ranked = counts.select("g", "j", "v", F.sum("n").over(upto).alias("upto"), F.sum("n").over(every).alias("all"))
    return ranked.where(2 * F.col("upto") >= F.col("all")).groupBy("g", "j").agg(F.min("v").alias("v"), F.max("all").alias("n"))


def _long(vectors: DataFrame, *keep: str) -> DataFrame:
    parts = ", ".join(f"{j}, x{j}" for j in range(P))
    return vectors.selectExpr("g", *keep, f"stack({P}, {parts}) AS (j, v)")


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MODEL = [f"m{j}" for j in range(P)] + [f"i{i}{j}" for i, j in PAIRS] + ["d"]


def fit(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, models) for the vectors of all rows that pass the base rules; equal ones of a group count once."""
    vectors = materialize(vectors.distinct(), "distinct")
    groups, feeds = _groups(vectors)
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).alias("part")
    data = materialize(vectors.join(feeds, "fine").drop("fine", "pool").select("*", part), "vectors")
    models = materialize(_starts(data), "model")
    while not models.where("NOT done").isEmpty():
        open_ = models.where("NOT done")
        new = _step(data, open_).select("g", "s", *[F.col(c).alias(f"_{c}") for c in MODEL])
        better = F.expr(better_sql("_d", "d"))
        moved = models.join(new, ["g", "s"], "left").select("g", "s", *[F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in MODEL], (~F.coalesce(better, F.lit(False))).alias("done"))
        models = materialize(moved, "model")
    best = models.groupBy("g").agg(F.min(F.struct("d", "s", *MODEL[:-1])).alias("best"))
    return groups, materialize(best.select("g", *[F.col(f"best.{c}").alias(c) for c in MODEL[:-1]]), "model")


def better_sql(new: str, old: str) -> str:
    """Whether a step made the determinant fall by more than a part of FALL."""
    return f"{new} < {1 - FALL!r}e0 * {old}"


def _beside(data: DataFrame, models: DataFrame) -> DataFrame:
    """Rows beside their group's models, joined by group and part."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part")
    return data.join(models.select("*", parts), ["g", "part"])


def _starts(data: DataFrame) -> DataFrame:
    """Per group and start s: a model of no determinant yet."""
    centre = materialize(_middle(_long(data)), "centre")
    wide = materialize(centre.groupBy("g").agg(*[F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"m{j}") for j in range(P)]), "wide")
    off = _beside(data, wide).select("g", *[F.abs(F.col(f"x{j}") - F.col(f"m{j}")).alias(f"x{j}") for j in range(P)])
    mad = _middle(_long(off)).groupBy("g").agg(*[F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"s{j}") for j in range(P)])
    middle = materialize(wide.join(mad, "g").selectExpr("g", *[f"m{j}" for j in range(P)], *[f"{deviation_sql(j)} AS r{j}" for j in range(P)]), "middle")
    first = middle.selectExpr("g", "0 AS s", *[f"CAST(m{j} AS DOUBLE) AS m{j}" for j in range(P)], *[(f"1e0 / r{j}" if i == j else "0e0") + f" AS i{i}{j}" for i, j in PAIRS])
    pulled = _beside(data, middle).selectExpr("g", "2 AS s", *[f"{pulled_sql(j)} AS x{j}" for j in range(P)])
    others = data.selectExpr("g", "1 AS s", *[f"x{j}" for j in range(P)]).unionByName(pulled)
    sums = others.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), *_moments())
    others = _model(sums.selectExpr("g", "s", "CAST(n AS DOUBLE) AS n", *[f"CAST({t} AS DOUBLE) AS {t}" for t in _moment_names()])).select(*first.columns)
    return first.unionByName(others).withColumn("d", F.lit(float("inf"))).withColumn("done", F.lit(False))


def deviation_sql(j: int) -> str:
    return f"greatest(1.4826e0 * s{j}, {float(LEAST[j] * GRID)!r}e0)"


def pulled_sql(j: int) -> str:
    """The coordinate, pulled in to two deviations from the median."""
    return f"least(greatest(x{j}, m{j} - CAST(floor(2e0 * r{j}) AS BIGINT)), m{j} + CAST(floor(2e0 * r{j}) AS BIGINT))"


def _moment_names() -> list[str]:
    return [f"t{j}" for j in range(P)] + [f"t{i}{j}" for i, j in PAIRS]


def _moments() -> list[Column]:
    exact = lambda e: F.expr(f"sum(CAST({e} AS DECIMAL(20, 0)))")
    return [exact(f"x{j}").alias(f"t{j}") for j in range(P)] + [exact(f"x{i} * x{j}").alias(f"t{i}{j}") for i, j in PAIRS]


def _model(sums: DataFrame) -> DataFrame:
    """Means, inverse factor and determinant from the moments of n rows."""
    model = sums.selectExpr("g", "s", *[f"t{j} / n AS m{j}" for j in range(P)], *[covariance_sql(i, j) + f" AS c{i}{j}" for i, j in PAIRS])
    for name, expr in inverse_factor_sql():
        model = model.withColumn(name, F.expr(expr))
    return model.select("g", "s", *MODEL)


def _step(data: DataFrame, models: DataFrame) -> DataFrame:
    """One concentration step: refit each group and start on its nearest share."""
    cells = _beside(data, models).withColumn("b", F.expr(bin_sql(distance_sql()))).groupBy("g", "s", "b").agg(F.count(F.lit(1)).alias("n"), *_moments())
    before = Window.partitionBy("g", "s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    near = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("g", "s")))
    near = near.where(F.col("before") < SUPPORT * F.col("all"))
    return _model(near.groupBy("g", "s").agg(F.sum("n").cast("double").alias("n"), *[F.sum(t).cast("double").alias(t) for t in _moment_names()]))


def covariance_sql(i: int, j: int) -> str:
    """Scatter of the kept share, made consistent."""
    return f"{CONSISTENCY!r}e0 * (t{i}{j} - t{i} * t{j} / n) / n"


def verdict_sql(d2: str) -> str:
    """Whether a text is near enough to its group."""
    return f"({d2}) * n_words <= {CUTOFF!r}e0 * (n_words + {SHORT}e0)"


def _judged(counted: DataFrame, groups: DataFrame, models: DataFrame) -> DataFrame:
    """Add kept to rows with the base counts, by two lookups of group tables."""
    fine, _ = _group("lang", "source")
    out = counted.withColumn("fine", fine)
    for j, x in enumerate(vector_sql()):
        out = out.withColumn(f"x{j}", F.when(~F.col("base_failed"), F.expr(x)))
    model = groups.join(models, "g").drop("g").withColumnRenamed("fine", "_fine")
    out = out.join(materialize(model, "verdicts"), F.col("fine") == F.col("_fine"), "left")
    # One expression over both sides: a part of it pushed below the counts would
    # be computed by substitution, once for every word.
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.expr(verdict_sql(distance_sql())), F.lit(True))))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: its base counts, base_failed and kept.

    A null or empty text has no words and fails the base rules.  A null language
    or source is a group like any other.  Repeated rows each count and each get
    a row; ties in distance share a bin, so they are kept together.  Texts of any
    length are counted whole.  Other columns are ignored.  An empty table gives
    an empty result.
    """
    counted = materialize(text_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "counts")
    groups, models = fit(_vectors(counted))
    return _judged(counted, groups, models).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Nulls, empty and repeated rows and ties are treated as in ``quality_report``;
    columns may have any names.  Rows are written once beside their counts, which
    cost more than the writing; the models are small, so no text is shuffled.
    """
    counted = materialize(text_counts(packed(docs, "text", "lang", "source")).drop("text"), "counts")
    groups, models = fit(_vectors(counted))
    return _judged(counted, groups, models).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
