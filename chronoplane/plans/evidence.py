"""Queries on evidence and prediction: canonical payloads, order lines, splices by regression, warm-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.functions import canonical
from chronoplane.operators import ops, stats
from chronoplane.operators.rolling import Frames
from chronoplane.plans.inputs import WEEKS_SQL, weeks
from chronoplane.plans.registry import neat, query, table

_DOCS = """d AS (SELECT event_id, '{"holdings":[{"weight":"' || CAST(json_extract_string(props, '$.k') AS INTEGER) || '"},{"weight":"0.25"}],"k":"' || json_extract_string(props, '$.k') || '","t":"\\u00e9' || event_type || '"}' AS payload, json_extract_string(props, '$.k') AS k FROM events)"""


@query("canonical_payload", f"WITH {_DOCS} SELECT event_id, payload, sha256(payload) AS payload_sha256, 'holdings,k,t,weight' AS fields, CAST(2 AS BIGINT) AS payload_rows, CAST(CAST(k AS DECIMAL(18,2)) + 0.25 AS VARCHAR) AS payload_weight_sum FROM d")
def canonical_payload(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit('{"t": "é'), "event_type", F.lit('", "k" : '), k, F.lit('.000, "holdings": [{"weight": '), k, F.lit('.0}, {"weight": 2.5e-1}]}'))
    out = canonical.with_canonical(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", "payload").drop("raw")
    return out.withColumn("fields", F.array_join("payload_fields", ",")).drop("payload_fields")


@query("order_lines", "SELECT CAST(event_id AS VARCHAR) || ',' || event_type || ',' || printf('%.10f', value) AS line FROM events")
def order_lines(spark, sf_dir):
    return ops.order_lines(table(spark, sf_dir, "events"), ["event_id", "event_type"], "value")


@query(
    "ols_splice",
    f"""WITH {WEEKS_SQL}, m AS (SELECT series_id, count(*) AS n, var_pop(n_orders) AS aa, var_pop(open_share) AS bb, covar_pop(n_orders, open_share) AS ab, covar_pop(n_orders, spread) AS ay, covar_pop(open_share, spread) AS by_, var_pop(spread) AS yy,
    avg(n_orders) AS ma, avg(open_share) AS mb, avg(spread) AS my FROM weeks GROUP BY 1), s AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS sa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS sb FROM m)
    SELECT series_id, n, round(sa / 1000, 6) + 0.0 AS slope_a, round(sb / 1000, 6) + 0.0 AS slope_b, round((my - sa * ma - sb * mb) / 1000, 6) + 0.0 AS intercept, round((sa * ay + sb * by_) / yy, 6) + 0.0 AS r2 FROM s""",
)
def ols_splice(spark, sf_dir):
    out = stats.fit_two(weeks(spark, sf_dir), "series_id", "spread", "n_orders", "open_share")
    return out.select("series_id", "n", *[neat(F.col(c) / 1000).alias(c) for c in ("slope_a", "slope_b", "intercept")], neat("r2").alias("r2"))


@query(
    "predictive_grid",
    f"""WITH {WEEKS_SQL}, l AS (SELECT series_id, signal, x, h AS horizon, CASE h WHEN 1 THEN lead(price, 1) OVER t WHEN 4 THEN lead(price, 4) OVER t ELSE lead(price, 8) OVER t END AS y
      FROM (SELECT series_id, week_end, price, unnest(['spread', 'open_share']) AS signal, unnest([spread, open_share]) AS x FROM weeks), (VALUES (1), (4), (8)) v(h) WINDOW t AS (PARTITION BY series_id, signal, h ORDER BY week_end)),
    k AS (SELECT series_id, signal, horizon, rank() OVER (PARTITION BY series_id, signal, horizon ORDER BY x) + (count(*) OVER (PARTITION BY series_id, signal, horizon, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY series_id, signal, horizon ORDER BY y) + (count(*) OVER (PARTITION BY series_id, signal, horizon, y) - 1) / 2.0 AS ry FROM l WHERE y IS NOT NULL)
    SELECT series_id, signal, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS spearman FROM k GROUP BY 1, 2, 3""",
)
def predictive_grid(spark, sf_dir):
    base = weeks(spark, sf_dir).select("series_id", "week_end", "price", "spread", "open_share")
    return stats.predictive_grid(base, "series_id", "week_end", ["spread", "open_share"], "price", [1, 4, 8]).withColumn("spearman", neat("spearman"))


@query(
    "warmup_dependency_map",
    f"""WITH {WEEKS_SQL}, s AS (SELECT *, CASE WHEN count(price) OVER (PARTITION BY series_id ORDER BY week_end ROWS 51 PRECEDING) = 52 THEN 1 END AS m, CASE WHEN count(price) OVER (PARTITION BY series_id ORDER BY week_end ROWS BETWEEN 104 PRECEDING AND 1 PRECEDING) = 104 THEN 1 END AS z FROM weeks)
    SELECT series_id, min(week_end) FILTER (price IS NOT NULL) AS first_price, min(week_end) FILTER (m IS NOT NULL) AS first_mean, min(week_end) FILTER (z IS NOT NULL) AS first_score FROM s GROUP BY 1""",
)
def warmup_dependency_map(spark, sf_dir):
    f, p = Frames("series_id", "week_end"), F.col("price")
    staged = weeks(spark, sf_dir).withColumn("m", f.mean(p, 52)).withColumn("z", f.median_prior(p, 104))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.col("week_end")))
    return staged.groupBy("series_id").agg(first("price").alias("first_price"), first("m").alias("first_mean"), first("z").alias("first_score"))
