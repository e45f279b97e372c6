"""Queries on portfolio policies: bucket sets, gated targets, simulated orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoplane.operators import cycles, policy, portfolio
from chronoplane.operators.folds import run_fold
from chronoplane.plans.cycles import _LATEST, SNAPS_SQL, snapshots
from chronoplane.plans.inputs import PANEL_SQL, panel
from chronoplane.plans.registry import neat, query, table

_SETS = """sets AS (SELECT c_nationkey AS policy, i AS place, 'b' || i AS name, i / 4e0 - CASE WHEN c_nationkey % 7 = 3 AND i = 2 THEN 0.1e0 ELSE 0 END + CASE WHEN c_nationkey % 11 = 5 AND i = 0 THEN 0.05e0 ELSE 0 END AS lower,
      (i + 1) / 4e0 - CASE WHEN c_nationkey % 5 = 2 AND i = 1 THEN 0.1e0 ELSE 0 END - CASE WHEN c_nationkey % 13 = 6 AND i = 3 THEN 0.1e0 ELSE 0 END AS upper, i = 0 OR c_nationkey % 3 = 0 AS lower_inclusive,
      i = 3 OR c_nationkey % 3 <> 0 OR c_nationkey % 6 = 0 AS upper_inclusive FROM (SELECT DISTINCT c_nationkey FROM customer), range(4) r(i))"""


def _sets(spark, sf_dir):
    n, i = F.col("policy"), F.col("place")
    every = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("policy")).distinct().withColumn("place", F.explode(F.array(*[F.lit(x) for x in range(4)])))
    shift = lambda by, at, edge, much: F.when((n % by == at) & (i == edge), much).otherwise(0.0)
    return every.select(
        "policy", "place", F.concat(F.lit("b"), i).alias("name"), (i / F.lit(4.0) - shift(7, 3, 2, 0.1) + shift(11, 5, 0, 0.05)).alias("lower"), ((i + 1) / F.lit(4.0) - shift(5, 2, 1, 0.1) - shift(13, 6, 3, 0.1)).alias("upper"),
        ((i == 0) | (n % 3 == 0)).alias("lower_inclusive"), ((i == 3) | (n % 3 != 0) | (n % 6 == 0)).alias("upper_inclusive"),
    )


@query(
    "bucket_sets",
    f"""WITH {_SETS}, s AS (SELECT *, lag(upper) OVER w AS up, lag(upper_inclusive) OVER w AS inc, row_number() OVER w AS a, count(*) OVER (PARTITION BY policy) AS n FROM sets WINDOW w AS (PARTITION BY policy ORDER BY lower, upper)),
    f AS (SELECT policy, n, CASE WHEN a = 1 AND (lower <> 0 OR NOT lower_inclusive) THEN [0, lower, 0] WHEN a = n AND (upper <> 1 OR NOT upper_inclusive) THEN [1, lower, 1] WHEN up < lower - 1e-9 THEN [2, lower, 2] WHEN up > lower + 1e-9 THEN [2, lower, 3] WHEN inc AND lower_inclusive THEN [2, lower, 4] WHEN NOT inc AND NOT lower_inclusive THEN [2, lower, 5] END AS fault FROM s)
    SELECT policy, CASE min(fault)[3] WHEN 0 THEN 'start' WHEN 1 THEN 'end' WHEN 2 THEN 'gap' WHEN 3 THEN 'overlap' WHEN 4 THEN 'bound_in_both' WHEN 5 THEN 'bound_in_neither' ELSE 'ok' END AS verdict, any_value(n) AS n_buckets FROM f GROUP BY 1""",
)
def bucket_sets(spark, sf_dir):
    return policy.check_buckets(_sets(spark, sf_dir), "policy")


@query(
    "bucket_lookup",
    f"""WITH {_SETS}, c AS (SELECT c_custkey, c_nationkey AS policy, (c_custkey % 41) / 40e0 AS score FROM customer), h AS (SELECT c.c_custkey, arg_min(s.name, s.place) AS bucket FROM c JOIN sets s ON s.policy = c.policy AND (score > lower OR lower_inclusive AND score = lower) AND (score < upper OR upper_inclusive AND score = upper) GROUP BY 1)
    SELECT c.c_custkey, bucket FROM c LEFT JOIN h USING (c_custkey)""",
)
def bucket_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("policy"), ((F.col("c_custkey") % 41) / F.lit(40.0)).alias("score"))
    return policy.locate(asked, _sets(spark, sf_dir), "policy", "score").select("c_custkey", "bucket")


#: Weights of a bucket, by symbol.
_WEIGHTS = {"calm": {"EQ": 0.9, "BD": 0.1}, "mid": {"EQ": 0.5, "BD": 0.3, "CASH": 0.2}, "high": {"CASH": 1.0}}
_SYMBOLS = ["EQ", "BD", "CASH"]
_GATE = """gated AS (SELECT *, CASE WHEN backfill_mode = 'degraded_backfill' THEN 'degraded_backfill_signal' WHEN backfill_mode = 'block' THEN 'block_signal' WHEN mode <> 'strict' THEN 'not_strict_mode' WHEN NOT execution_permitted THEN 'execution_not_permitted' WHEN NOT strict_gate_passed THEN 'strict_gate_failed'
    WHEN h_t IS NULL THEN 'h_t_missing' WHEN rho_t IS NULL THEN 'rho_t_missing' WHEN k_hat IS NULL THEN 'k_hat_t_missing' WHEN s_t IS NULL THEN 's_t_missing' WHEN backfill_mode = 'other' THEN 'not_strict_mode' ELSE 'eligible_strict_signal' END AS reason FROM latest)"""


@query(
    "target_weights",
    f"""WITH {SNAPS_SQL}, {_LATEST}, {_GATE}, g AS (SELECT *, reason = 'eligible_strict_signal' AS ok, CASE WHEN rho_t < 0.3e0 THEN 'calm' WHEN rho_t < 0.7e0 THEN 'mid' WHEN rho_t IS NOT NULL THEN 'high' END AS bucket, run_id % 4 = 0 AS fresh FROM gated)
    SELECT book, week_end, CASE WHEN ok THEN bucket END AS bucket, {', '.join(f"CASE WHEN ok THEN CASE bucket {' '.join(f'''WHEN '{b}' THEN {float(w.get(s, 0.0))!r}e0''' for b, w in _WEIGHTS.items())} END WHEN fresh THEN {1.0 if s == 'CASH' else 0.0!r}e0 ELSE {dict(EQ=0.25, BD=0.75, CASH=0.0)[s]!r}e0 END AS {s}" for s in _SYMBOLS)},
    CASE WHEN ok THEN 'policy_bucket_mapping' ELSE 'hold_prior_or_policy_default' END AS generation_mode, CASE WHEN ok THEN 'eligible_strict_signal' WHEN fresh THEN 'no_prior_target_defensive_cash_proxy' ELSE reason END AS target_reason, 1e0 AS gross_exposure, 1e0 AS net_exposure FROM g""",
)
def target_weights(spark, sf_dir):
    latest = cycles.signal_eligibility(cycles.latest_view(snapshots(spark, sf_dir), ["book", "week_end"]))
    bounds = [("calm", 0.0, 0.3, True, False), ("mid", 0.3, 0.7, True, False), ("high", 0.7, 1.0, True, True)]
    sets = spark.createDataFrame([("own", i, *b) for i, b in enumerate(bounds)], "policy string, place int, name string, lower double, upper double, lower_inclusive boolean, upper_inclusive boolean")
    prior = F.when(F.col("run_id") % 4 != 0, F.create_map(F.lit("EQ"), F.lit(0.25), F.lit("BD"), F.lit(0.75), F.lit("CASH"), F.lit(0.0)))
    out = policy.target_weights(policy.locate(latest.withColumn("policy", F.lit("own")), sets, "policy", "rho_t").withColumn("prior", prior), _WEIGHTS, _SYMBOLS, "CASH", "prior")
    return out.select("book", "week_end", F.when(F.col("signal_eligible"), F.col("bucket")).alias("bucket"), *[F.col("target")[s].alias(s) for s in _SYMBOLS], "generation_mode", "target_reason", neat("gross_exposure", 9).alias("gross_exposure"), neat("net_exposure", 9).alias("net_exposure"))


_BOOKS = f"""{PANEL_SQL}, t AS (SELECT day + 7 AS day, ticker, weight AS target, price FROM panel),
    b AS (SELECT day, ticker, coalesce(weight, 0.0) AS weight, coalesce(target, 0.0) AS target, coalesce(p.price, t.price) AS price FROM panel p FULL OUTER JOIN t USING (day, ticker)), x AS (SELECT *, target - weight AS delta, sum(abs(target - weight)) OVER (PARTITION BY day) / 2 AS turnover FROM b)"""


def _books(spark, sf_dir):
    """Each week's holdings against the weights of the week before as targets."""
    p = panel(spark, sf_dir)
    target = p.select(F.date_add("day", 7).alias("day"), "ticker", F.col("weight").alias("target"), F.col("price").alias("_price"))
    both = portfolio.portfolio_delta(p.select("day", "ticker", "weight", "price"), target, ["day"], "ticker", 0.3)
    return both.withColumn("price", F.coalesce("price", "_price"))


@query("portfolio_delta", f"WITH {_BOOKS} SELECT day, ticker, round(delta, 6) + 0.0 AS delta, round(turnover, 6) + 0.0 AS turnover, turnover >= 0.3 - 1e-12 AS trades FROM x")
def portfolio_delta(spark, sf_dir):
    return _books(spark, sf_dir).select("day", "ticker", neat("delta").alias("delta"), neat("turnover").alias("turnover"), "trades")


_ORDERS = f"""{_BOOKS}, o AS (SELECT day, ticker, price, CASE WHEN turnover >= 0.3 - 1e-12 THEN 10000 * delta ELSE 0 END AS d, row_number() OVER (PARTITION BY day ORDER BY delta >= 0, ticker) AS i FROM x),
    f AS (SELECT DISTINCT day, CAST(NULL AS INTEGER) AS ticker, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS price, '' AS side, 40.0::DOUBLE AS cash, 0 AS seq FROM o UNION ALL
      SELECT day, ticker, i, CASE WHEN size >= 50 THEN size END, price, CASE WHEN size < 50 THEN '' WHEN d < 0 THEN 'SELL' ELSE 'BUY' END, CASE WHEN size < 50 THEN cash WHEN d < 0 THEN cash + size - (size * 0.0005e0 + 1.5e0) ELSE greatest(0, cash - size - (size * 0.0005e0 + 1.5e0)) END, seq + CAST(size >= 50 AS INTEGER)
      FROM (SELECT o.day, o.ticker, o.i, o.d, o.price, f.cash, f.seq, CASE WHEN o.d < 0 THEN -o.d ELSE least(o.d, greatest(0, (f.cash - 1.5e0) / 1.0015e0)) END AS size FROM f JOIN o ON o.day = f.day AND o.i = f.i + 1))"""


def _simulated(spark, sf_dir):
    orders = _books(spark, sf_dir).withColumn("notional_wanted", F.when(F.col("trades"), 10_000 * F.col("delta")).otherwise(0.0)).withColumn("place", F.when(F.col("delta") >= 0, F.lit(1_000_000)).otherwise(F.lit(0)) + F.col("ticker"))
    return run_fold(orders, "day", "place", lambda: policy.OrderSimulation(cash=40.0, commission=1.5), ["notional_wanted", "price"], policy.OrderSimulation.SCHEMA, keep=["ticker", "trades"])


@query(
    "order_ledger",
    f"""WITH RECURSIVE {_ORDERS} SELECT day, ticker, side, round(size, 4) + 0.0 AS notional, round(size / price, 6) + 0.0 AS quantity, round(size * 0.0005e0, 6) + 0.0 AS slippage_cost, round(size * 0.0005e0 + 1.5e0, 6) + 0.0 AS total_cost, 'paper-' || strftime(day, '%Y-%m-%d') || '-' || printf('%04d', seq) AS order_id, round(cash, 4) + 0.0 AS cash
    FROM f WHERE side <> ''""",
)
def order_ledger(spark, sf_dir):
    out = _simulated(spark, sf_dir).where("side IS NOT NULL")
    ident = F.concat(F.lit("paper-"), F.date_format("day", "yyyy-MM-dd"), F.lit("-"), F.lpad(F.col("sequence").cast("string"), 4, "0"))
    return out.select("day", "ticker", "side", neat("notional", 4).alias("notional"), neat("quantity").alias("quantity"), neat("slippage_cost").alias("slippage_cost"), neat("total_cost").alias("total_cost"), ident.alias("order_id"), neat("cash", 4).alias("cash"))


@query(
    "order_summary",
    f"""WITH RECURSIVE {_ORDERS}, w AS (SELECT day, bool_and(turnover >= 0.3 - 1e-12) AS ok FROM x GROUP BY 1), s AS (SELECT day, count(*) FILTER (side <> '') AS n, coalesce(sum(size * 0.0005e0), 0) AS slip, arg_max(cash, i) AS cash FROM f WHERE i > 0 GROUP BY 1)
    SELECT day, n AS orders_count, round(slip, 6) + 0.0 AS estimated_slippage_cost, round(slip + 1.5e0 * n, 6) + 0.0 AS estimated_total_cost, round(cash, 4) + 0.0 AS cash_after_orders, CASE WHEN NOT ok THEN 'rebalance_not_required' WHEN n > 0 THEN 'orders_generated' ELSE 'no_orders_generated' END AS reason FROM s JOIN w USING (day)""",
)
def order_summary(spark, sf_dir):
    out = policy.order_summary(_simulated(spark, sf_dir), ["day"], F.col("trades"))
    return out.select("day", "orders_count", neat("estimated_slippage_cost").alias("estimated_slippage_cost"), neat("estimated_total_cost").alias("estimated_total_cost"), neat("cash_after_orders", 4).alias("cash_after_orders"), "reason")
