"""Queries on panels and portfolios: micro measures, risk, backtests, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.functions import recursions as rec
from chronoplane.operators import micro, portfolio, risk, stats
from chronoplane.operators.folds import run_fold
from chronoplane.plans.inputs import MEMBERS_SQL, PANEL_SQL, WEEKS_SQL, members, panel, weeks
from chronoplane.plans.registry import neat, query, table

_AGES = f"""{MEMBERS_SQL}, d AS (SELECT day, row_number() OVER (ORDER BY day) AS o FROM (SELECT DISTINCT day FROM members)),
    s AS (SELECT members.*, o, CASE WHEN o - lag(o) OVER (PARTITION BY ticker ORDER BY o) - 1 > 3 THEN 1 ELSE 0 END AS f FROM members JOIN d USING (day)),
    g AS (SELECT *, sum(f) OVER (PARTITION BY ticker ORDER BY o ROWS UNBOUNDED PRECEDING) AS span FROM s),
    ages AS (SELECT *, row_number() OVER (PARTITION BY ticker, span ORDER BY o) AS age FROM g)"""


@query("member_ages", f"WITH {_AGES} SELECT day, ticker, CAST(age AS INTEGER) AS age FROM ages")
def member_ages(spark, sf_dir):
    return micro.member_ages(members(spark, sf_dir), "day", "ticker").select("day", "ticker", "age")


@query("mature_sets", f"WITH {_AGES} SELECT day, count(*) FILTER (age >= 20) AS n_first, count(*) FILTER (age >= 60) AS n_second, count(*) AS n_members FROM ages GROUP BY 1")
def mature_sets(spark, sf_dir):
    return micro.mature_counts(micro.member_ages(members(spark, sf_dir), "day", "ticker"), "day")


@query(
    "giant_weight_guard",
    f"""WITH {_AGES}, n AS (SELECT *, coalesce(lead(o) OVER (PARTITION BY ticker ORDER BY o), o + 4) AS nxt FROM ages),
    a AS (SELECT n.o + k AS o, weight FROM n, (VALUES (1), (2), (3)) t(k) WHERE n.o + k < nxt), l AS (SELECT o, sum(weight) AS missing FROM a GROUP BY 1),
    f AS (SELECT day, list_sort(list(weight), 'DESC')[5] AS fifth FROM members GROUP BY 1)
    SELECT d.day, round(coalesce(missing, 0), 6) + 0.0 AS missing, round(fifth, 6) + 0.0 AS fifth, coalesce(coalesce(missing, 0) > 0.5 * fifth, false) AS hold FROM d LEFT JOIN l USING (o) JOIN f ON f.day = d.day""",
)
def giant_weight_guard(spark, sf_dir):
    held = members(spark, sf_dir)
    out = micro.missing_weight_guard(micro.member_ages(held, "day", "ticker"), held, "day", "ticker", "weight")
    return out.withColumn("missing", neat("missing")).withColumn("fifth", neat("fifth"))


_DAILY = f"""{_AGES}, nd AS (SELECT d.day, d.o, count(*) AS n, count(*) FILTER (kept) AS k FROM (SELECT *, o - lag(o) OVER (PARTITION BY ticker ORDER BY o) = 1 AS kept FROM ages) a JOIN d USING (day) GROUP BY 1, 2),
    ch AS (SELECT day, o, coalesce(n <> lag(n) OVER (ORDER BY o) OR k <> lag(n) OVER (ORDER BY o), false) AS changed FROM nd),
    gr AS (SELECT ch.o, t.ticker, coalesce(m.weight, 0.0) AS w, changed FROM ch CROSS JOIN (SELECT DISTINCT ticker FROM members) t LEFT JOIN members m ON m.day = ch.day AND m.ticker = t.ticker),
    sm AS (SELECT ticker, o, w, NULL::DOUBLE AS v FROM gr WHERE o = 1 UNION ALL SELECT g.ticker, g.o, g.w, CASE WHEN g.changed THEN sm.v ELSE 2 ** (-0.2) * coalesce(sm.v, 0.0) + (1 - 2 ** (-0.2)) * sm.w END FROM sm JOIN gr g ON g.ticker = sm.ticker AND g.o = sm.o + 1),
    nx AS (SELECT ticker, o, coalesce(lead(o) OVER (PARTITION BY ticker ORDER BY o), o + 4) AS nxt FROM ages), aw AS (SELECT nx.o + k AS o, nx.ticker FROM nx, (VALUES (1), (2), (3)) t(k) WHERE nx.o + k < nxt),
    lost AS (SELECT aw.o, sum(coalesce(sm.v, 0.0)) AS lost FROM aw JOIN sm ON sm.o = aw.o AND sm.ticker = aw.ticker GROUP BY 1), ff AS (SELECT o, list_sort(list(v), 'DESC')[5] AS fifth FROM sm WHERE v > 0 GROUP BY 1),
    hd AS (SELECT a.day, a.o, a.ticker, a.price, a.age, sm.v, avg(a.price) OVER (PARTITION BY a.ticker ORDER BY a.o ROWS 9 PRECEDING) AS ma, row_number() OVER (PARTITION BY a.ticker ORDER BY a.o) AS p FROM ages a JOIN sm ON sm.o = a.o AND sm.ticker = a.ticker),
    bb AS (SELECT o, CASE WHEN sum(v) > 1e-12 THEN least(1.0, greatest(0.0, 1 - sum(CASE WHEN price > ma THEN v ELSE 0 END) / (sum(v) + 1e-12))) END AS b0 FROM hd WHERE age >= 10 AND v > 0 GROUP BY 1),
    mm AS (SELECT o, ticker, v, p, count(*) OVER (PARTITION BY o) AS m, v / (sum(v) OVER (PARTITION BY o) + 1e-12) AS sh FROM hd WHERE age >= 15 AND v > 0),
    rr AS (SELECT mm.o, mm.ticker, mm.m, mm.sh, y.o AS t, y.price / x.price - 1 AS r FROM mm JOIN hd y ON y.ticker = mm.ticker AND y.p BETWEEN mm.p - 13 AND mm.p JOIN hd x ON x.ticker = y.ticker AND x.p = y.p - 1 AND x.o = y.o - 1 WHERE mm.m > 1),
    rs AS (SELECT *, count(*) OVER (PARTITION BY o, t) AS k FROM rr), rk AS (SELECT * FROM rs WHERE k = m),
    cp AS (SELECT a.o, a.sh AS wa, b.sh AS wb, corr(a.r, b.r) AS rho, count(*) AS n FROM rk a JOIN rk b ON a.o = b.o AND a.t = b.t AND a.ticker < b.ticker GROUP BY a.o, a.ticker, b.ticker, a.sh, b.sh),
    cc AS (SELECT cp.o, CASE WHEN min(n) > 1 AND bool_and(isfinite(rho)) AND count(rho) = count(*) THEN 2 * sum(wa * wb * rho) / (1 - any_value(sq) + 1e-12) END AS c0 FROM cp JOIN (SELECT o, sum(sh * sh) AS sq FROM mm GROUP BY 1) s USING (o) GROUP BY 1),
    al AS (SELECT ch.day, ch.o, coalesce(coalesce(lost, 0.0) > 0.5 * fifth, false) AND ch.o > 1 AS hold, changed, lost.o IS NOT NULL AS away, b0, c0 FROM ch LEFT JOIN lost USING (o) LEFT JOIN ff USING (o) LEFT JOIN bb USING (o) LEFT JOIN cc USING (o)),
    ow AS (SELECT *, CASE WHEN NOT hold AND o > 1 THEN b0 END AS b1, CASE WHEN NOT hold AND o > 1 THEN c0 END AS c1 FROM al),
    daily AS (SELECT day, CASE WHEN hold THEN last_value(b1 IGNORE NULLS) OVER w ELSE b1 END AS b, CASE WHEN hold THEN last_value(c1 IGNORE NULLS) OVER w ELSE c1 END AS c, CASE WHEN o > 1 AND (changed OR away OR hold) THEN 0.3 ELSE 1.0 END AS z_weight, hold FROM ow WINDOW w AS (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _daily(spark, sf_dir):
    return micro.daily_frame(members(spark, sf_dir), "day", "ticker", "price", "weight", 10, 15)


@query("micro_daily", f"WITH RECURSIVE {_DAILY} SELECT day, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c, CAST(z_weight AS DOUBLE) AS z_weight, hold FROM daily")
def micro_daily(spark, sf_dir):
    return _daily(spark, sf_dir).withColumns({x: neat(x) for x in ("b", "c")})


def _score_sql(x: str) -> str:
    return f"""p{x} AS (SELECT a.week, a.{x} AS cur, b.{x} AS v, b.z_weight AS w, b.week AS j FROM wk a JOIN wk b ON b.i BETWEEN a.i - 52 AND a.i - 1 AND b.{x} IS NOT NULL), q{x} AS (SELECT *, sum(w) OVER (PARTITION BY week ORDER BY v, w, j ROWS UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY week) AS t FROM p{x}),
    m{x} AS (SELECT week, any_value(cur) AS cur, min(v) FILTER (u >= 0.5 * t) AS med FROM q{x} GROUP BY 1), d{x} AS (SELECT p.week, abs(p.v - m.med) AS v, w, j FROM p{x} p JOIN m{x} m USING (week)), e{x} AS (SELECT *, sum(w) OVER (PARTITION BY week ORDER BY v, w, j ROWS UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY week) AS t FROM d{x}),
    z{x} AS (SELECT m.week, (any_value(cur) - any_value(med)) / (1.4826 * min(v) FILTER (u >= 0.5 * t) + 1e-12) AS z FROM e{x} e JOIN m{x} m USING (week) GROUP BY 1)"""


@query(
    "micro_weekly",
    f"""WITH RECURSIVE {_DAILY}, wk AS (SELECT *, row_number() OVER (ORDER BY week) AS i FROM (SELECT CAST(date_trunc('month', day) AS DATE) AS week, median(b) AS b, median(c) AS c, min(CAST(z_weight AS DOUBLE)) AS z_weight FROM daily GROUP BY 1)), {_score_sql('b')}, {_score_sql('c')}
    SELECT wk.week, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c, z_weight, round(1 / (1 + exp(-(0.5 * zb.z + 0.5 * zc.z))), 5) + 0.0 AS h FROM wk LEFT JOIN zb USING (week) LEFT JOIN zc USING (week)""",
)
def micro_weekly(spark, sf_dir):
    """The panel's days are weeks, so its weeks are months here."""
    out = micro.weekly_score(_daily(spark, sf_dir).withColumn("week", F.trunc("day", "month")), "week", 52)
    return out.select("week", neat("b").alias("b"), neat("c").alias("c"), "z_weight", neat("h", 5).alias("h"))


@query(
    "smoothed_weights",
    f"""WITH RECURSIVE {PANEL_SQL}, g AS (SELECT a.day, b.ticker, coalesce(p.weight, 0.0) AS w FROM (SELECT DISTINCT day FROM panel) a CROSS JOIN (SELECT DISTINCT ticker FROM panel) b LEFT JOIN panel p ON p.day = a.day AND p.ticker = b.ticker),
    s AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i, month(day) = 6 AS rule FROM g),
    f AS (SELECT ticker, day, i, w, NULL::DOUBLE AS v FROM s WHERE i = 1 UNION ALL
      SELECT s.ticker, s.day, s.i, s.w, CASE WHEN s.rule THEN f.v ELSE 2 ** (-0.2) * coalesce(f.v, 0.0) + (1 - 2 ** (-0.2)) * f.w END FROM f JOIN s ON s.ticker = f.ticker AND s.i = f.i + 1)
    SELECT day, ticker, round(v, 6) + 0.0 AS smoothed FROM f""",
)
def smoothed_weights(spark, sf_dir):
    grid = micro.dense(panel(spark, sf_dir), "day", "ticker", "weight").withColumn("rule", F.month("day") == 6)
    return run_fold(grid, "ticker", "day", rec.SmoothedWeights, ["weight", "rule"], "smoothed double").withColumn("smoothed", neat("smoothed"))


@query(
    "weighted_breadth",
    f"""WITH {PANEL_SQL}, m AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(price) OVER w END AS ma FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS 19 PRECEDING))
    SELECT day, round(least(1.0, greatest(0.0, 1 - sum(CASE WHEN price > ma THEN weight ELSE 0 END) / sum(weight))), 6) + 0.0 AS breadth FROM m WHERE ma IS NOT NULL GROUP BY 1""",
)
def weighted_breadth(spark, sf_dir):
    return micro.breadth(panel(spark, sf_dir), "day", "ticker", "price", "weight", 20).withColumn("breadth", neat("breadth"))


@query(
    "correlation_concentration",
    f"""WITH {PANEL_SQL}, d AS (SELECT day, row_number() OVER (ORDER BY day) AS o FROM (SELECT DISTINCT day FROM panel)),
    s AS (SELECT p.*, o, CASE WHEN o - lag(o) OVER w = 1 THEN price / lag(price) OVER w - 1 END AS r FROM panel p JOIN d USING (day) WINDOW w AS (PARTITION BY ticker ORDER BY o)),
    h AS (SELECT a.day, a.ticker, any_value(a.weight) AS weight, stddev_samp(b.r) AS sd FROM s a JOIN s b ON a.ticker = b.ticker AND b.o BETWEEN a.o - 11 AND a.o AND b.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 12 AND stddev_samp(b.r) > 0),
    q AS (SELECT h.*, weight / sum(weight) OVER (PARTITION BY day) AS share, d.o FROM h JOIN d USING (day)),
    pairs AS (SELECT x.day, x.ticker AS a, y.ticker AS b, any_value(x.share) AS wa, any_value(y.share) AS wb, corr(ra.r, rb.r) AS rho
      FROM q x JOIN q y ON x.day = y.day AND x.ticker < y.ticker JOIN s ra ON ra.ticker = x.ticker AND ra.o BETWEEN x.o - 11 AND x.o JOIN s rb ON rb.ticker = y.ticker AND rb.o = ra.o GROUP BY 1, 2, 3),
    t AS (SELECT day, count(*) AS n_members, sum(share * share) AS sq FROM q GROUP BY 1)
    SELECT day, any_value(n_members) AS n_members, round(2 * sum(wa * wb * rho) / (1 - any_value(sq) + 1e-12), 6) + 0.0 AS concentration FROM pairs JOIN t USING (day) GROUP BY 1""",
)
def correlation_concentration(spark, sf_dir):
    out = micro.concentration(panel(spark, sf_dir), "day", "ticker", "price", "weight", 12)
    return out.withColumn("concentration", neat("concentration"))


_SHARES = """c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'error') AS b, count(*) FILTER (event_type = 'purchase') AS c,
    count(*) FILTER (event_type = 'signup') AS d, count(*) FILTER (event_type = 'view') AS e, max(value) / 101.0 AS s, min(value) / 37 AS drift FROM events GROUP BY 1, 2)"""
_OMEGA = "(1 - least(1.0, greatest(0.0, (abs(drift) - 1.2) / (1.8 - 1.2)))) * (1.0 * a / n + 0.7 * b / n + 0.3 * c / n + 0.6 * d / n + 0.9 * e / n) + least(1.0, greatest(0.0, (abs(drift) - 1.2) / (1.8 - 1.2))) * 0.6"


@query(
    "risk_scores",
    f"""WITH {_SHARES}, o AS (SELECT *, {_OMEGA} AS omega FROM c), r AS (SELECT *, 1 - (1 - least(1.0, greatest(0.0, omega * s))) * (1 - 0.75 * least(1.0, greatest(0.0, 2 * greatest(s - 0.5, 0.0)))) AS rho FROM o)
    SELECT user_id, day, round(omega, 6) + 0.0 AS omega, round(rho, 6) + 0.0 AS rho, CAST(CASE WHEN rho < 0.2 THEN 0 WHEN rho < 0.4 THEN 1 WHEN rho < 0.6 THEN 2 WHEN rho < 0.8 THEN 3 ELSE 4 END AS INTEGER) AS bucket FROM r""",
)
def risk_scores(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    cells = events.groupBy("user_id", "day").agg(F.array(*[F.count_if(F.col("event_type") == k) / F.count(F.lit(1)) for k in kinds]).alias("p"), (F.max("value") / 101).alias("s"), (F.min("value") / 37).alias("drift"))
    scored = cells.withColumn("omega", risk.state_weight(F.col("p"), F.col("drift"))).withColumn("rho", risk.risk_score(F.col("omega"), F.col("s"), F.col("s")))
    return scored.select("user_id", "day", neat("omega").alias("omega"), neat("rho").alias("rho"), risk.bucket(F.col("rho"), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).alias("bucket"))


_TWO = f"""{WEEKS_SQL}, two AS (SELECT x.series_id AS run, x.week_end, x.price AS a, y.price AS b, 1 - least(1.0, greatest(0.0, x.open_share)) AS w FROM weeks x JOIN weeks y ON y.week_end = x.week_end AND left(y.series_id, 1) = CAST(CAST(left(x.series_id, 1) AS INTEGER) % 5 + 1 AS VARCHAR)),
    g AS (SELECT *, w * (lead(a) OVER t / a - 1) + (1 - w) * (lead(b) OVER t / b - 1) AS gross, coalesce(abs(w - lag(w) OVER t), 0.0) AS turnover FROM two WINDOW t AS (PARTITION BY run ORDER BY week_end)),
    n AS (SELECT *, turnover * 5.0 / 10000 AS cost, gross - turnover * 5.0 / 10000 AS ret FROM g WHERE gross IS NOT NULL),
    v AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY run ORDER BY week_end)) AS nav FROM n),
    x AS (SELECT *, 1 - nav / max(nav) OVER (PARTITION BY run ORDER BY week_end) AS dd, CASE WHEN count(*) OVER f = 4 THEN exp(sum(ln(1 + ret)) OVER f) - 1 END AS r4 FROM v WINDOW f AS (PARTITION BY run ORDER BY week_end ROWS 3 PRECEDING))"""


def _two(spark, sf_dir):
    """A run per series: its price against that of the next one, weighted by its open share."""
    own = weeks(spark, sf_dir)
    number = F.left("series_id", F.lit(1)).cast("int")
    other = own.select(number.alias("_n"), "week_end", F.col("price").alias("b"))
    first = own.select(F.col("series_id").alias("run"), (number % 5 + 1).alias("_n"), "week_end", F.col("price").alias("a"), (1 - risk.unit(F.col("open_share"))).alias("w"))
    return first.join(other, ["_n", "week_end"]).drop("_n")


@query("backtest", f"WITH {_TWO} SELECT run, week_end, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(cost, 8) + 0.0 AS cost, round(ln(nav), 6) + 0.0 AS log_nav, round(dd, 6) + 0.0 AS drawdown FROM x")
def backtest(spark, sf_dir):
    rows = portfolio.backtest(_two(spark, sf_dir), "run", "week_end", "w", "a", "b").withColumn("dd", portfolio.drawdown("run", "week_end", F.col("nav")))
    return rows.select("run", "week_end", neat("gross").alias("gross"), neat("turnover").alias("turnover"), neat("cost", 8).alias("cost"), neat(F.log("nav")).alias("log_nav"), neat("dd").alias("drawdown"))


_MEASURES = {
    "annual_return": "exp(sum(ln(1 + ret)) * 52 / count(*)) - 1",
    "annual_vol": "stddev_samp(ret) * sqrt(52.0)",
    "sharpe": "avg(ret) * 52 / (stddev_samp(ret) * sqrt(52.0))",
    "sortino": "avg(ret) * 52 / (sqrt(sum(least(ret, 0.0) ** 2) / count(*)) * sqrt(52.0))",
    "max_drawdown": "max(dd)",
    "calmar": "(exp(sum(ln(1 + ret)) * 52 / count(*)) - 1) / max(dd)",
    "turnover": "avg(turnover) * 52",
    "cost_drag": "avg(cost) * 52",
    "hit_ratio": "CAST(count(*) FILTER (ret > 0) AS DOUBLE) / count(*)",
    "worst_week": "min(ret)",
    "worst_four": "min(r4)",
}


@query("performance_metrics", f"WITH {_TWO} SELECT run, " + ", ".join(f"round({e}, 6) + 0.0 AS {m}" for m, e in _MEASURES.items()) + " FROM x GROUP BY 1")
def performance_metrics(spark, sf_dir):
    rows = portfolio.backtest(_two(spark, sf_dir), "run", "week_end", "w", "a", "b")
    return portfolio.performance(rows, "run", "week_end").select("run", *[neat(m).alias(m) for m in _MEASURES])


_COMPARED = ("annual_return", "annual_vol", "sharpe", "sortino", "max_drawdown", "calmar", "hit_ratio", "worst_week", "worst_four")


@query(
    "comparison_table",
    f"""WITH {_TWO}, p AS (SELECT run, week_end, unnest(['strategy', 'first', 'second', 'blend']) AS portfolio, unnest([ret, a1, b1, 0.6 * a1 + 0.4 * b1]) AS ret FROM (SELECT *, lead(a) OVER t / a - 1 AS a1, lead(b) OVER t / b - 1 AS b1 FROM g WINDOW t AS (PARTITION BY run ORDER BY week_end)) JOIN (SELECT run, week_end, ret FROM n) USING (run, week_end)),
    q AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY run, portfolio ORDER BY week_end)) AS nav FROM p), z AS (SELECT *, 1 - nav / max(nav) OVER (PARTITION BY run, portfolio ORDER BY week_end) AS dd, CASE WHEN count(*) OVER f = 4 THEN exp(sum(ln(1 + ret)) OVER f) - 1 END AS r4 FROM q WINDOW f AS (PARTITION BY run, portfolio ORDER BY week_end ROWS 3 PRECEDING))
    SELECT run, portfolio, {', '.join(f'round({_MEASURES[m]}, 6) + 0.0 AS {m}' for m in _COMPARED)} FROM z GROUP BY 1, 2""",
)
def comparison_table(spark, sf_dir):
    """All measures of the strategy beside holding either side, or a fixed blend of both."""
    w = Window.partitionBy("run").orderBy("week_end")
    ahead = {"first": F.lead("a").over(w) / F.col("a") - 1, "second": F.lead("b").over(w) / F.col("b") - 1}
    prices = _two(spark, sf_dir)
    wide = portfolio.backtest(prices, "run", "week_end", "w", "a", "b").select("run", "week_end", F.col("ret").alias("strategy")).join(prices.withColumns(ahead).select("run", "week_end", "first", "second"), ["run", "week_end"])
    long = wide.withColumn("blend", 0.6 * F.col("first") + 0.4 * F.col("second")).unpivot(["run", "week_end"], ["strategy", "first", "second", "blend"], "portfolio", "ret")
    long = long.withColumn("cell", F.concat_ws("|", "run", "portfolio")).withColumns({"turnover": F.lit(0.0), "cost": F.lit(0.0)})
    value = Window.partitionBy("cell").orderBy("week_end").rowsBetween(Window.unboundedPreceding, 0)
    out = portfolio.performance(long.withColumn("nav", F.exp(F.sum(F.log(1 + F.col("ret"))).over(value))), "cell", "week_end")
    return out.select(F.split_part("cell", F.lit("|"), F.lit(1)).alias("run"), F.split_part("cell", F.lit("|"), F.lit(2)).alias("portfolio"), *[neat(m).alias(m) for m in _COMPARED])


_RANKS = """k AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, value FROM events),
    g AS (SELECT event_type, count(*) AS n, sum(r) AS rs FROM k GROUP BY 1), t AS (SELECT sum(c) AS total, sum(CAST(c * c * c - c AS DOUBLE)) AS ties FROM (SELECT count(*) AS c FROM events GROUP BY value))"""


@query(
    "kruskal_wallis",
    f"""WITH {_RANKS}, h AS (SELECT CAST(any_value(total) AS BIGINT) AS total, (12.0 / (any_value(total) * (any_value(total) + 1)) * sum(rs * rs / n) - 3 * (any_value(total) + 1)) / (1 - any_value(ties) / (CAST(any_value(total) AS DOUBLE) ** 3 - any_value(total))) AS h FROM g, t)
    SELECT total, round(h, 6) + 0.0 AS h, round(exp(-h / 2) * (1 + h / 2), 6) + 0.0 AS p_value FROM h""",
)
def kruskal_wallis(spark, sf_dir):
    out = stats.kruskal(stats.rank_sums(table(spark, sf_dir, "events"), "event_type", "value"), 5)
    return out.select("total", neat("h").alias("h"), neat("p_value").alias("p_value"))


def _tail_sql(z: str) -> str:
    t = f"(1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2e0)))"
    return f"({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-({z}) * ({z}) / 2e0))"


@query(
    "dunn_holm",
    f"""WITH {_RANKS}, z AS (SELECT x.event_type AS a, y.event_type AS b, (x.rs / x.n - y.rs / y.n) / sqrt((total * (total + 1) / 12.0 - ties / (12.0 * (total - 1))) * (1.0 / x.n + 1.0 / y.n)) AS z FROM g x JOIN g y ON x.event_type < y.event_type, t),
    p AS (SELECT *, {_tail_sql('z')} AS p FROM z), s AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1)) AS sc FROM p)
    SELECT a, b, round(z, 6) + 0.0 AS z, round(p, 6) + 0.0 AS p, round(max(sc) OVER (ORDER BY p, a, b), 6) + 0.0 AS p_holm FROM s""",
)
def dunn_holm(spark, sf_dir):
    out = stats.dunn_holm(stats.rank_sums(table(spark, sf_dir, "events"), "event_type", "value"), "event_type")
    return out.withColumns({c: neat(c) for c in ("z", "p", "p_holm")})


@query("cliffs_delta", "SELECT round(avg(sign(x.value - y.value)), 6) + 0.0 AS delta FROM events x, events y WHERE x.event_type = 'click' AND y.event_type = 'purchase'")
def cliffs_delta(spark, sf_dir):
    return stats.cliffs_delta(table(spark, sf_dir, "events"), "event_type", "value", "click", "purchase").select(neat("delta").alias("delta"))


@query(
    "spearman",
    f"""WITH {WEEKS_SQL}, k AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY spread) + (count(*) OVER (PARTITION BY series_id, spread) - 1) / 2.0 AS x, rank() OVER (PARTITION BY series_id ORDER BY n_orders) + (count(*) OVER (PARTITION BY series_id, n_orders) - 1) / 2.0 AS y FROM weeks)
    SELECT series_id, count(*) AS n, round(corr(x, y), 6) + 0.0 AS spearman FROM k GROUP BY 1""",
)
def spearman(spark, sf_dir):
    return stats.spearman(weeks(spark, sf_dir), "series_id", "spread", "n_orders").withColumn("spearman", neat("spearman"))


@query(
    "ols_hac",
    f"""WITH {WEEKS_SQL}, b AS (SELECT series_id, week_end, spread / 1000 AS y, n_orders AS x FROM weeks),
    l AS (SELECT series_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, avg(x) AS mx, count(*) AS n FROM b GROUP BY 1),
    g AS (SELECT b.*, slope, intercept, n, x - mx AS c, (x - mx) * (y - intercept - slope * x) AS g FROM b JOIN l USING (series_id)),
    k AS (SELECT *, coalesce(lag(g, 1) OVER t, 0) AS l1, coalesce(lag(g, 2) OVER t, 0) AS l2, coalesce(lag(g, 3) OVER t, 0) AS l3 FROM g WINDOW t AS (PARTITION BY series_id ORDER BY week_end)),
    s AS (SELECT series_id, any_value(slope) AS slope, any_value(n) AS n, sqrt(sum(g * g) + 1.5 * sum(g * l1) + 1.0 * sum(g * l2) + 0.5 * sum(g * l3)) / sum(c * c) AS se FROM k GROUP BY 1)
    SELECT series_id, n, round(slope, 6) + 0.0 AS slope, round(se, 6) + 0.0 AS se, round(slope / se, 6) + 0.0 AS t, round({_tail_sql('(slope / se)')}, 6) + 0.0 AS p FROM s""",
)
def ols_hac(spark, sf_dir):
    base = weeks(spark, sf_dir).select("series_id", "week_end", (F.col("spread") / 1000).alias("y"), F.col("n_orders").alias("x"))
    out = stats.ols_hac(base, "series_id", "week_end", "y", "x", 3)
    return out.select("series_id", "n", *[neat(c).alias(c) for c in ("slope", "se", "t", "p")])


@query(
    "tercile_spread",
    f"""WITH {WEEKS_SQL}, c AS (SELECT series_id, quantile_cont(price, 1.0 / 3) AS lo, quantile_cont(price, 2.0 / 3) AS hi FROM weeks GROUP BY 1)
    SELECT series_id, round(median(spread) FILTER (price >= hi) - median(spread) FILTER (price <= lo), 4) + 0.0 AS tercile_spread FROM weeks JOIN c USING (series_id) GROUP BY 1""",
)
def tercile_spread(spark, sf_dir):
    return stats.tercile_spread(weeks(spark, sf_dir), "series_id", "price", "spread").withColumn("tercile_spread", neat("tercile_spread", 4))
