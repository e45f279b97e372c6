"""Queries on the health of replays, labels, coverage, digests and eligibility of days."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.functions import recursions as rec
from chronoplane.operators import health
from chronoplane.operators.folds import run_fold
from chronoplane.operators.rolling import Frames, exo_pretransform
from chronoplane.plans.inputs import DAYS_SQL, MEMBERS_SQL, WEEKS_SQL, days, members, weeks
from chronoplane.plans.registry import neat, query, table

_METRICS = ["maha", "huber_weight", "condition_number_raw", "condition_number_reg"]
_REPLAY = f"""{DAYS_SQL}, replay AS (SELECT series_id, day, price, spread / 1e5 AS maha, least(1e0, 25e4 / greatest(spread, 1)) AS huber_weight, CASE WHEN n_orders > 1 THEN price / 1e4 END AS condition_number_raw, price / 2e4 AS condition_number_reg,
    row_number() OVER (PARTITION BY series_id ORDER BY day) > 260 AS is_warm, CASE WHEN open_share > 0.6 THEN 1 ELSE 0 END AS drift_flag, price < 1e5 AS floored, CASE WHEN n_orders > 1 THEN open_share < 0.9 END AS state_ok, n_orders, open_share FROM days)"""


def _replay(spark, sf_dir):
    by = Window.partitionBy("series_id").orderBy("day")
    many = F.col("n_orders") > 1
    return days(spark, sf_dir).select(
        "series_id", "day", "price", (F.col("spread") / 1e5).alias("maha"), F.least(F.lit(1.0), 25e4 / F.greatest("spread", F.lit(1.0))).alias("huber_weight"), F.when(many, F.col("price") / 1e4).alias("condition_number_raw"), (F.col("price") / 2e4).alias("condition_number_reg"),
        (F.row_number().over(by) > 260).alias("is_warm"), F.when(F.col("open_share") > 0.6, 1).otherwise(0).alias("drift_flag"), (F.col("price") < 1e5).alias("floored"), F.when(many, F.col("open_share") < 0.9).alias("state_ok"), "n_orders", "open_share",
    )


@query(
    "health_distributions",
    f"WITH {_REPLAY}, l AS (SELECT series_id, unnest([{', '.join(f'{chr(39)}{m}{chr(39)}' for m in _METRICS)}]) AS metric, unnest([{', '.join(_METRICS)}]) AS value FROM replay) SELECT series_id, metric, count(value) AS n, " + ", ".join(f"round(quantile_cont(value, {p}), 6) + 0.0 AS {name}" for name, p in health.LEVELS.items()) + " FROM l GROUP BY 1, 2",
)
def health_distributions(spark, sf_dir):
    return health.health_distributions(_replay(spark, sf_dir), "series_id", _METRICS).withColumns({c: neat(c) for c in health.LEVELS})


@query(
    "health_counts",
    f"""WITH {_REPLAY} SELECT series_id, count(*) AS n_rows, count(*) FILTER (NOT is_warm) AS warmup_rows, count(*) FILTER (is_warm) AS warm_rows, CAST(sum(drift_flag) AS BIGINT) AS drift_flag_count, round(avg(CAST(floored AS INTEGER)), 6) + 0.0 AS floored_frequency,
    round(avg(CAST(NOT coalesce(state_ok, false) AS INTEGER)), 6) + 0.0 AS degradation_frequency, round(avg(CAST(huber_weight < 1 AS INTEGER)), 6) + 0.0 AS huber_below_1_frequency FROM replay GROUP BY 1""",
)
def health_counts(spark, sf_dir):
    return health.health_counts(_replay(spark, sf_dir), "series_id").withColumns({c: neat(c) for c in ("floored_frequency", "degradation_frequency", "huber_below_1_frequency")})


@query(
    "warmup_neighbourhood",
    f"WITH {_REPLAY}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM replay), o AS (SELECT *, i - min(i) FILTER (is_warm) OVER (PARTITION BY series_id) AS k FROM i) SELECT series_id, day, is_warm, CAST(k AS INTEGER) AS \"offset\" FROM o WHERE abs(k) <= 10",
)
def warmup_neighbourhood(spark, sf_dir):
    return health.around_boundary(_replay(spark, sf_dir), "series_id", "day").select("series_id", "day", "is_warm", F.col("offset").cast("int").alias("offset"))


_WINDOWS = [("first", "1995-03-01", "1995-09-30"), ("middle", "1997-01-01", "1997-12-31"), ("late", "2000-06-01", "2001-12-31"), ("never", "2010-01-01", "2010-12-31")]


@query(
    "window_coverage",
    f"""WITH {_REPLAY}, e AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _WINDOWS)}) t(win, s, e)), k AS (SELECT DISTINCT series_id, win, s, e FROM replay, e),
    a AS (SELECT k.series_id, k.win, count(r.day) AS n, count(r.condition_number_raw) AS nc, count(r.maha) AS nm, coalesce(max(r.day), any_value(k.e)) AS last FROM k LEFT JOIN replay r ON r.series_id = k.series_id AND r.day BETWEEN k.s AND k.e GROUP BY 1, 2)
    SELECT series_id, win AS "window", n AS rows_total, nc AS rows_finite_condition_number_raw, nm AS rows_finite_maha, n > 0 AND nc >= 0.95 * n AND NOT DATE '2001-06-30' < last AS coverage_ok,
    CASE WHEN DATE '2001-06-30' < last THEN 'incomplete_due_to_source_coverage' WHEN n > 0 AND nc >= 0.95 * n THEN 'ok' ELSE 'incomplete' END AS window_status FROM a""",
)
def window_coverage(spark, sf_dir):
    windows = spark.createDataFrame(_WINDOWS, "name string, start string, end string").select("name", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    return health.window_coverage(_replay(spark, sf_dir), windows, "series_id", "day", ["condition_number_raw", "maha"], F.lit("2001-06-30").cast("date"))


_CENTRES = f"""{DAYS_SQL}, pts AS (SELECT series_id, CAST(n_orders * 7 % 5 AS INTEGER) AS cluster, price / 1e5 AS h, open_share + spread / 1e6 AS i FROM days)"""


def _points(spark, sf_dir):
    return days(spark, sf_dir).select("series_id", (F.col("n_orders") * 7 % 5).cast("int").alias("cluster"), (F.col("price") / 1e5).alias("h"), (F.col("open_share") + F.col("spread") / 1e6).alias("i"))


@query(
    "semantic_labels",
    f"""WITH {_CENTRES}, m AS (SELECT series_id, cluster, median(h) AS h, median(i) AS i FROM pts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY h, cluster) AS r FROM m),
    b AS (SELECT *, CASE WHEN r <= 2 THEN 0 WHEN r = 3 THEN 1 ELSE 2 END AS b FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY series_id, b ORDER BY CASE WHEN b = 2 THEN -i ELSE i END, r) AS q FROM b)
    SELECT series_id, cluster, CASE b WHEN 0 THEN 'S' || q WHEN 1 THEN 'S3' ELSE 'S' || (3 + q) END AS label FROM q""",
)
def semantic_labels(spark, sf_dir):
    centres = _points(spark, sf_dir).groupBy("series_id", "cluster").agg(F.median("h").alias("h"), F.median("i").alias("i"))
    return health.semantic_labels(centres, "series_id").select("series_id", "cluster", "label")


@query("first_state", f"WITH {_CENTRES}, m AS (SELECT series_id, cluster, median(h) AS h, median(i) AS i FROM pts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY h, cluster) AS r FROM m) SELECT series_id, CASE WHEN count(*) >= 5 THEN arg_min(cluster, (i, cluster)) FILTER (r <= 2) END AS s1_cluster, count(*) AS n_clusters FROM r GROUP BY 1")
def first_state(spark, sf_dir):
    return health.first_state(_points(spark, sf_dir), "series_id")


@query(
    "source_gaps",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 5 GROUP BY 1, 2), r AS (SELECT * FROM (VALUES ('purchase', 1), ('signup', 2), ('refund', 3), ('click', 4)) t(name, p)), u AS (SELECT DISTINCT user_id FROM events),
    j AS (SELECT u.user_id, r.name, r.p, coalesce(c.n, 0) AS n FROM u CROSS JOIN r LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = r.name)
    SELECT user_id, coalesce(string_agg(name, ',' ORDER BY p) FILTER (n = 0), '') AS missing, coalesce(string_agg(name, ',' ORDER BY p) FILTER (n > 0 AND n < 20), '') AS insufficient FROM j GROUP BY 1""",
)
def source_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("known", F.when(F.col("value") > 5, F.col("value")))
    return health.source_gaps(e, "user_id", "event_type", "known", ["purchase", "signup", "refund", "click"], 20)


@query(
    "frame_digest",
    "WITH l AS (SELECT c_nationkey, c_custkey, coalesce(CAST(c_custkey AS VARCHAR), '') || ',' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END || ',' || c_name AS line FROM customer) SELECT c_nationkey, CAST(count(*) AS INTEGER) AS n_rows, sha256('c_custkey,c_mktsegment,c_name' || chr(10) || string_agg(line, chr(10) ORDER BY c_custkey) || chr(10)) AS digest FROM l GROUP BY 1",
)
def frame_digest(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    return health.frame_digest(c, ["c_nationkey"], ["c_name", "c_mktsegment", "c_custkey"], ["c_custkey"])


@query(
    "weights_last_row",
    "SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS ticker, arg_max(l_discount, (l_orderkey * 10 + l_linenumber, l_discount)) AS weight FROM lineitem WHERE CAST(l_shipdate AS DATE) - 3 <= DATE '1999-06-30' GROUP BY 1, 2",
)
def weights_last_row(spark, sf_dir):
    """Of rows with equal places in the file the larger weight is the last one."""
    place = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.col("l_discount").alias("weight"))
    facts = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("ticker"), F.date_sub(F.to_date("l_shipdate"), 3).alias("known_at"), place.alias("place"), F.col("l_discount").alias("weight"))
    return health.weights_at(facts, ["day", "ticker"], "known_at", "place", "weight", F.lit("1999-06-30").cast("date"))


_STRICT = f"""{MEMBERS_SQL}, d AS (SELECT DISTINCT day FROM members UNION SELECT DISTINCT day + 1000 FROM members), w AS (SELECT CASE WHEN month(day) = 3 THEN day + 5000 ELSE day END AS day, ticker, weight * CASE WHEN month(day) = 7 THEN 1.2e0 ELSE 1e0 END AS weight FROM members),
    p AS (SELECT day, ticker FROM (SELECT day, ticker, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM members) WHERE i >= 20),
    g AS (SELECT day FROM w GROUP BY 1 HAVING abs(sum(weight) - 1) <= 0.01), u AS (SELECT m.day, count(*) AS used, count(*) FILTER (p.ticker IS NULL) AS bare FROM members m JOIN w USING (day, ticker) JOIN g USING (day) LEFT JOIN p ON p.day = m.day AND p.ticker = m.ticker WHERE w.weight > 0 GROUP BY 1),
    n AS (SELECT DISTINCT day FROM members), b AS (SELECT d.day, concat_ws(',', CASE WHEN n.day IS NULL THEN 'historical_constituent_coverage_incomplete' END, CASE WHEN n.day IS NOT NULL AND u.day IS NULL THEN 'historical_weight_coverage_incomplete' END,
      CASE WHEN bare > 0 THEN 'pit_coverage_incomplete,rename_identity_coverage_incomplete' END) AS blockers FROM d LEFT JOIN n ON n.day = d.day LEFT JOIN u ON u.day = d.day)"""


@query("strict_days", f"WITH {_STRICT} SELECT day, blockers, blockers = '' AS eligible FROM b")
def strict_days(spark, sf_dir):
    m = members(spark, sf_dir)
    every = m.select("day").distinct().union(m.select(F.date_add("day", 1000)).distinct())
    # Weights of March are dated years later, so March has none.
    weights = m.withColumn("weight", F.col("weight") * F.when(F.month("day") == 7, 1.2).otherwise(1.0)).withColumn("day", F.when(F.month("day") == 3, F.date_add("day", 5000)).otherwise(F.col("day")))
    windows = m.withColumn("i", F.row_number().over(Window.partitionBy("ticker").orderBy("day"))).where("i >= 20")
    return health.strict_days(every, m, weights, windows, "day", "ticker", "weight")


@query(
    "rank_functions",
    f"""WITH {WEEKS_SQL} SELECT series_id, week_end, CAST(rank() OVER w AS INTEGER) AS rank, CAST(dense_rank() OVER w AS INTEGER) AS dense_rank, CAST(ntile(4) OVER t AS INTEGER) AS quarter, round(percent_rank() OVER w, 9) + 0.0 AS percent_rank, round(cume_dist() OVER w, 9) + 0.0 AS cume_dist,
    lead(n_orders, 1, -1) OVER t AS next_orders FROM weeks WINDOW w AS (PARTITION BY series_id ORDER BY n_orders), t AS (PARTITION BY series_id ORDER BY n_orders, week_end)""",
)
def rank_functions(spark, sf_dir):
    w, t = Window.partitionBy("series_id").orderBy("n_orders"), Window.partitionBy("series_id").orderBy("n_orders", "week_end")
    return weeks(spark, sf_dir).select(
        "series_id", "week_end", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.ntile(4).over(t).alias("quarter"), neat(F.percent_rank().over(w), 9).alias("percent_rank"), neat(F.cume_dist().over(w), 9).alias("cume_dist"), F.lead("n_orders", 1, -1).over(t).alias("next_orders"),
    )


_H = "(2e0 ** (-1e0 / 52))"
_G = "least(greatest(k.x - e.m, -4e0 * sqrt(e.v + 1e-12)), 4e0 * sqrt(e.v + 1e-12))"


@query(
    "exogenous_memory",
    f"""WITH RECURSIVE {DAYS_SQL}, s AS (SELECT series_id, day, ln(1 + greatest(spread, 0)) AS x, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM days),
    r AS (SELECT series_id, day, CASE WHEN count(x) OVER w = 60 THEN (x - quantile_cont(x, 0.5) OVER w) / (1.4826 * mad(x) OVER w + 1e-12) END AS z FROM s WINDOW w AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
    e AS (SELECT series_id, day, i, x AS m, 0e0 AS v, CAST(NULL AS DOUBLE) AS z FROM s WHERE i = 1 UNION ALL SELECT k.series_id, k.day, k.i, {_H} * e.m + (1 - {_H}) * k.x, {_H} * e.v + (1 - {_H}) * ({_G}) ** 2, (k.x - ({_H} * e.m + (1 - {_H}) * k.x)) / sqrt({_H} * e.v + (1 - {_H}) * ({_G}) ** 2 + 1e-12) FROM e JOIN s k ON k.series_id = e.series_id AND k.i = e.i + 1),
    d AS (SELECT e.series_id, e.day, 0.5 * r.z + 0.5 * CASE WHEN e.i > 13 THEN e.z END AS z FROM e JOIN r USING (series_id, day)) SELECT series_id, day, round(CASE WHEN z IS NOT NULL THEN least(5.0, greatest(-5.0, z)) END, 6) + 0.0 AS exo FROM d""",
)
def exogenous_memory(spark, sf_dir):
    """Half robust, half clipped exponentially weighted score of the transformed input, cut at five."""
    f, x = Frames("series_id", "day"), F.col("x")
    base = days(spark, sf_dir).select("series_id", "day", exo_pretransform(F.col("spread")).alias("x"))
    slow = run_fold(base, "series_id", "day", lambda: rec.EwZ(52, clip=4.0), ["x"], "e double", keep=["x"])
    both = slow.withColumn("z", 0.5 * f.robust_z(x, 60) + 0.5 * F.col("e"))
    return both.select("series_id", "day", neat(F.when(F.col("z").isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(-5.0), F.col("z"))))).alias("exo"))


@query(
    "record_fields",
    """WITH r AS (SELECT event_id, '{"H": ' || value || ', "I": ' || (value - 50) || ', "p_t": [0.1, ' || (event_id % 10) / 10e0 || ', 0.25], "drift": {"flag": ' || CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END || '}}' AS j FROM events)
    SELECT event_id, round(CAST(json_extract(j, '$.H') AS DOUBLE), 6) AS h, round(CAST(json_extract(j, '$.I') AS DOUBLE), 6) + 0.0 AS i, list_max(CAST(json_extract(j, '$.p_t') AS DOUBLE[])) AS max_p, CAST(json_extract_string(j, '$.drift.flag') = 'true' AS INTEGER) AS drift_flag FROM r""",
)
def record_fields(spark, sf_dir):
    """Values, the largest share and the drift flag out of a JSON record."""
    e = table(spark, sf_dir, "events")
    record = F.to_json(F.struct(F.col("value").alias("H"), (F.col("value") - 50).alias("I"), F.array(F.lit(0.1), (F.col("event_id") % 10) / 10, F.lit(0.25)).alias("p_t"), F.struct((F.col("event_id") % 5 == 0).alias("flag")).alias("drift")))
    parsed = e.select("event_id", F.from_json(record, "H double, I double, p_t array<double>, drift struct<flag: boolean>").alias("r"))
    return parsed.select("event_id", F.round("r.H", 6).alias("h"), neat("r.I").alias("i"), F.array_max("r.p_t").alias("max_p"), F.coalesce(F.col("r.drift.flag"), F.lit(False)).cast("int").alias("drift_flag"))
