"""Readers and writers with fixed contracts: required and forbidden columns, checks, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class ContractError(ValueError):
    """The input breaks its contract; nothing is guessed or filled."""


#: Column contracts of the inputs: name -> DDL.
CONTRACTS = {
    "raw_prices": "trade_date date, ticker string, raw_close double, source_label string, asof_timestamp timestamp",
    "constituents": "trade_date date, ticker string, asof_timestamp timestamp",
    "weights": "trade_date date, ticker string, weight double, asof_timestamp timestamp",
    "corp_actions": "ticker string, event_type string, effective_date date, announcement_timestamp timestamp, equivalent_factor double, normalization_status string, source_label string, asof_timestamp timestamp",
    "symbol_identity": "old_symbol string, new_symbol string, effective_date date, identity_type string, source_label string, asof_timestamp timestamp",
    "macro_prices": "trade_date date, ticker string, close double, source_name string, fetch_timestamp timestamp, price_basis string",
    "override_series": "trade_date date, value double, source_name string, source_timestamp timestamp, license_tag string",
}
#: Columns that would carry hindsight into a point-in-time store.
FORBIDDEN = {"raw_prices": {"adj_close", "adjusted_close", "adj close"}}
#: Columns without which a row is dropped, where these are not all of them.
NEEDED = {
    "corp_actions": ["ticker", "effective_date", "equivalent_factor", "asof_timestamp"],
    "macro_prices": ["trade_date", "ticker", "close", "fetch_timestamp"],
}
#: The one use that market closes without vintages are good for, and what they may be; fixed values.
REPLAY_SCOPE = "state_stress_only"
PRICE_BASES = ("vendor_backward_adjusted", "vendor_raw_close", "official_market_close")
#: Days that an override must cover to warm the chain up, a fixed value.
WARMUP_ROWS = 525


def read_contract(spark: SparkSession, path: str, contract: str, upper: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Read CSV under a contract: headers cleaned, columns checked, values coerced.

    Values that don't parse become null, and rows that lack a needed value are dropped.
    """
    return _typed(spark, path, contract, upper).dropna(subset=NEEDED.get(contract))


def _typed(spark: SparkSession, path: str, contract: str, upper: tuple[str, ...] = ("ticker",)) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    names = [c.strip().lower() for c in raw.columns]
    raw = raw.toDF(*names)
    schema = T._parse_datatype_string(CONTRACTS[contract])
    if missing := [f.name for f in schema if f.name not in names]:
        raise ContractError(f"{contract}: missing columns {missing}")
    if bad := sorted(set(names) & FORBIDDEN.get(contract, set())):
        raise ContractError(f"{contract}: forbidden columns {bad}")
    typed = raw.select(*[F.expr(f"try_cast(trim({f.name}) AS {f.dataType.simpleString()})").alias(f.name) for f in schema])
    return typed.withColumns({c: F.upper(c) for c in upper if c in typed.columns})


def read_macro_closes(spark: SparkSession, path: str, scope: str = REPLAY_SCOPE) -> DataFrame:
    """Market closes for the replay of states only: positive, of one known price basis, at least one row."""
    if scope != REPLAY_SCOPE:
        raise ContractError(f"macro_prices: not for {scope}")
    rows = read_contract(spark, path, "macro_prices")
    known = F.coalesce(F.col("price_basis").isin(*PRICE_BASES), F.lit(False))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min("close").alias("least"), F.count_if(~known).alias("odd"), F.min("price_basis").alias("a"), F.max("price_basis").alias("b")).first()
    if not facts["n"] or facts["least"] <= 0 or facts["odd"] or facts["a"] != facts["b"]:
        raise ContractError(f"macro_prices: need positive closes of one known basis: {facts}")
    return rows


def closes_between(rows: DataFrame, ticker: str, start: str, end: str) -> DataFrame:
    """(trade_date, close) of a ticker, both ends in; the latest fetch of a day counts."""
    held = rows.where((F.col("ticker") == ticker) & F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return held.groupBy("trade_date").agg(F.max_by("close", "fetch_timestamp").alias("close"))


def read_override(spark: SparkSession, path: str) -> DataFrame:
    """A licensed series: every day and value known and finite, days strictly increasing in the file.

    The order of a file is that of its rows, so one task sees it: a row per day.
    """
    rows = _typed(spark, path, "override_series").withColumn("_at", F.monotonically_increasing_id())
    late = ~F.coalesce(F.lag("trade_date").over(Window.partitionBy(F.lit(0)).orderBy("_at")) < F.col("trade_date"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_at")) == 1)
    finite = F.coalesce(F.abs("value") < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce("value", F.lit(0.0)))
    bad = F.col("trade_date").isNull() | ~finite | late
    if not rows.withColumn("_bad", bad).where("_bad").isEmpty():
        raise ContractError("override_series: days must be known and increase, values be finite")
    return rows.drop("_at")


def override_manifest(rows: DataFrame) -> DataFrame:
    """One row: span, count and source of an override, and why it can't be used, if so."""
    n = F.count(F.lit(1))
    first = lambda c: F.min_by(c, "trade_date")
    out = rows.agg(first("source_name").alias("source_name"), first("source_timestamp").alias("source_timestamp"), F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"), n.alias("row_count"), first("license_tag").alias("license_tag"))
    short = F.col("row_count") < WARMUP_ROWS
    return out.withColumns({"coverage_ok": ~short, "reason_if_rejected": F.when(short, F.concat(F.lit("Insufficient coverage: "), F.col("row_count"), F.lit(f" < {WARMUP_ROWS} rows")))})


def read_ticker_files(spark: SparkSession, folder: str) -> DataFrame:
    """Raw and adjusted closes from a folder with a CSV file per ticker, which its file's name tells."""
    schema = "trade_date date, asof_timestamp timestamp, raw_close double, adj_close double"
    raw = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(folder).withColumn("_file", F.col("_metadata.file_name"))
    values = [F.expr(f"try_cast({c} AS {t})").alias(c) for c, t in (x.split() for x in schema.split(", "))]
    return raw.select(F.regexp_replace(F.url_decode("_file"), r"\.csv$", "").alias("ticker"), *values)


def require_single(df: DataFrame, column: str) -> DataFrame:
    """``df``, if the column has exactly one value."""
    if df.select(column).distinct().limit(2).count() != 1:
        raise ContractError(f"{column} must have exactly one value")
    return df


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a holdings payload (JSON documents with a ``holdings`` array), in its order.

    A page of HTML, and a payload without rows, break the contract.
    """
    head = F.lower(F.ltrim(F.substring("value", 1, 4096)))
    if not spark.read.text(path, wholetext=True).where(head.startswith("<!doctype") | head.startswith("<html")).isEmpty():
        raise ContractError("holdings: a page of HTML")
    item = "ticker string, issuerName string, percentageOfTotalNetAssets double, cusip string, isin string, sedol string, exchange string, securityTypeName string"
    docs = spark.read.schema(f"effectiveDate date, holdings array<struct<{', '.join(x.replace(' ', ': ', 1) for x in item.split(', ')) }>>").option("multiLine", True).json(path)
    if docs.isEmpty() or not docs.where(F.coalesce(F.size("holdings"), F.lit(0)) <= 0).isEmpty():
        raise ContractError("holdings: a payload without rows")
    return docs.select("effectiveDate", F.posexplode("holdings").alias("pos", "h")).select("effectiveDate", "pos", "h.*")


def payload_kind(name, head):
    """Format of a payload by its name, else by its first characters."""
    lower, start = F.lower(name), F.lower(F.ltrim(head))
    return (
        F.when(lower.endswith(".json"), "json").when(lower.endswith(".csv"), "csv").when(lower.endswith(".xlsx"), "xlsx").when(lower.endswith(".xls"), "xls")
        .when(start.startswith("<!doctype") | start.startswith("<html"), "html").when(start.startswith("{") | start.startswith("["), "json").when(start.startswith("pk"), "xlsx").otherwise("csv")
    )


def read_snapshots(spark: SparkSession, path: str, schema: str, required: list[str], zoned: str | None = None) -> DataFrame:
    """Published snapshots (a JSON document each) with their path; all required fields must be set.

    The text column ``zoned`` must name its time zone and becomes a timestamp.
    """
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    if not df.where(" OR ".join(f"{c} IS NULL" for c in required)).isEmpty():
        raise ContractError(f"a snapshot lacks one of {required}")
    if zoned is None:
        return df
    if not df.where(~F.coalesce(F.col(zoned).rlike(r"\d(Z|[+-]\d\d(:?\d\d)?)$"), F.lit(False))).isEmpty():
        raise ContractError(f"{zoned} must name its time zone")
    return df.withColumn(zoned, F.to_timestamp(zoned))


def publish(df: DataFrame, path: str, week_end: str, run_id: str) -> str:
    """Write an immutable snapshot; a run that exists already is an error."""
    target = f"{path}/week_end={week_end}/run={run_id}"
    df.write.mode("errorifexists").json(target)
    df.write.mode("overwrite").json(f"{path}/latest")
    return target


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_day(df: DataFrame, path: str, day: str) -> None:
    """Replace the partitions of the days in ``df`` and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def store_scheme(df: DataFrame, scheme: str, root: str) -> str | None:
    """Write to the store that a decision names; ``block`` writes nothing."""
    if scheme == "block":
        return None
    target = f"{root}/{scheme}"
    df.dropDuplicates().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_end").parquet(target)
    return target
