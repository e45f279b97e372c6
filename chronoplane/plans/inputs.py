"""Series, vintages and panels that the catalogue makes from the star schema.

The tables have no market data, so each input has a stand-in of the same shape.
Sums of money are decimal, so they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.operators.timeaxis import week_end
from chronoplane.plans.registry import table


def exact_mean(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))


def _stats(orders: DataFrame, by: str) -> DataFrame:
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), by).agg(
        exact_mean("o_totalprice").alias("price"),
        (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"),
        F.count(F.lit(1)).alias("n_orders"),
        (F.count_if(F.col("o_orderstatus") == "O") / F.count(F.lit(1))).alias("open_share"),
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per order priority, one step per day with orders."""
    return _stats(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day")


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by weeks that end on Friday."""
    return _stats(table(spark, sf_dir, "orders").withColumn("week_end", week_end(F.to_date("o_orderdate"))), "week_end")


_STATS = """CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price,
  max(o_totalprice) - min(o_totalprice) AS spread, count(*) AS n_orders,
  CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) / count(*) AS open_share"""
FRIDAY = "CAST({0} + CAST((5 - dayofweek({0}) + 7) % 7 AS INTEGER) AS DATE)"
DAYS_SQL = f"days AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS day, {_STATS} FROM orders GROUP BY 1, 2)"
WEEKS_SQL = f"weeks AS (SELECT o_orderpriority AS series_id, {FRIDAY.format('CAST(o_orderdate AS DATE)')} AS week_end, {_STATS} FROM orders GROUP BY 1, 2)"


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by supplier and order day with the day each became known, the order day at the earliest."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("shipped"), "l_extendedprice", "l_discount")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("known_at", F.greatest("shipped", "day"))
    return both.select(F.col("l_suppkey").alias("ticker"), "day", "known_at", F.col("l_extendedprice").alias("value"), "l_discount")


VINTAGES_SQL = """vintages AS (SELECT l_suppkey AS ticker, CAST(o_orderdate AS DATE) AS day, greatest(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS known_at,
  l_extendedprice AS value, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly prices and weights of supplier nations: (day, ticker, price, weight)."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity", week_end(F.to_date("l_shipdate")).alias("day"))
    nations = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("ticker"))
    sums = lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("day", "ticker").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("money"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("pieces")
    )
    total = F.sum("money").over(Window.partitionBy("day"))
    return sums.select("day", "ticker", (F.col("money").cast("double") / F.col("pieces").cast("double")).alias("price"), (F.col("money").cast("double") / total.cast("double")).alias("weight"))


PANEL_SQL = f"""panel AS (SELECT day, ticker, CAST(money AS DOUBLE) / CAST(pieces AS DOUBLE) AS price,
  CAST(money AS DOUBLE) / CAST(sum(money) OVER (PARTITION BY day) AS DOUBLE) AS weight FROM (
  SELECT {FRIDAY.format('CAST(l_shipdate AS DATE)')} AS day, s_nationkey AS ticker, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS money, sum(CAST(l_quantity AS DECIMAL(18,2))) AS pieces
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2))"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly prices and weights of suppliers, who come and go: (day, ticker, price, weight)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), "l_extendedprice", "l_quantity", week_end(F.to_date("l_shipdate")).alias("day"))
    sums = lines.groupBy("day", "ticker").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("money"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("pieces"))
    total = F.sum("money").over(Window.partitionBy("day")).cast("double")
    return sums.select("day", "ticker", (F.col("money").cast("double") / F.col("pieces").cast("double")).alias("price"), (F.col("money").cast("double") / total).alias("weight"))


MEMBERS_SQL = f"""members AS (SELECT day, ticker, CAST(money AS DOUBLE) / CAST(pieces AS DOUBLE) AS price, CAST(money AS DOUBLE) / CAST(sum(money) OVER (PARTITION BY day) AS DOUBLE) AS weight FROM (
  SELECT {FRIDAY.format('CAST(l_shipdate AS DATE)')} AS day, l_suppkey AS ticker, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS money, sum(CAST(l_quantity AS DECIMAL(18,2))) AS pieces FROM lineitem GROUP BY 1, 2))"""
