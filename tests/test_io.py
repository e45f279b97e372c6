"""Contracts of the sources, immutable publishing, and streaming folds."""

import json

import pytest
from pyspark.errors import AnalysisException

from chronoplane.functions import recursions as rec
from chronoplane.operators.folds import run_fold
from chronoplane.sources import contracts
from chronoplane.streaming.folds import stream_fold


def _csv(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_contract_coerces_and_drops(spark, tmp_path):
    path = _csv(tmp_path, " Trade_Date ,ticker,asof_timestamp\n2024-01-02, abc ,2024-01-02 10:00:00\nnever,x,2024-01-02 10:00:00\n")
    (row,) = contracts.read_contract(spark, path, "constituents").collect()
    assert row.ticker == "ABC"


def test_contract_rejects_hindsight_and_missing_columns(spark, tmp_path):
    head = "trade_date,ticker,raw_close,source_label,asof_timestamp,adj_close\n"
    with pytest.raises(contracts.ContractError, match="forbidden"):
        contracts.read_contract(spark, _csv(tmp_path, head), "raw_prices")
    with pytest.raises(contracts.ContractError, match="missing"):
        contracts.read_contract(spark, _csv(tmp_path, "ticker\nx\n"), "weights")


MACRO = "trade_date,ticker,close,source_name,fetch_timestamp,price_basis\n"


def test_macro_closes_are_positive_of_one_basis_and_for_replay_only(spark, tmp_path):
    row = "2024-01-0{},qq,{},{},2024-02-0{} 00:00:00,{}\n"
    good = MACRO + row.format(2, 5, "", 1, PRICE) + row.format(2, 6, "v", 2, PRICE) + row.format(3, "x", "v", 1, PRICE) + row.format(4, 7, "v", 1, PRICE)
    rows = contracts.read_macro_closes(spark, _csv(tmp_path, good))
    assert rows.count() == 3
    assert [(str(r.trade_date), r.close) for r in contracts.closes_between(rows, "QQ", "2024-01-02", "2024-01-03").collect()] == [("2024-01-02", 6.0)]
    with pytest.raises(contracts.ContractError, match="micro"):
        contracts.read_macro_closes(spark, _csv(tmp_path, good), "micro_layer")
    for bad in ("", row.format(2, 0, "v", 1, PRICE), row.format(2, 5, "v", 1, "other"), row.format(2, 5, "v", 1, PRICE) + row.format(3, 5, "v", 1, "official_market_close")):
        with pytest.raises(contracts.ContractError, match="basis"):
            contracts.read_macro_closes(spark, _csv(tmp_path, MACRO + bad))


PRICE = "vendor_raw_close"


def test_override_days_increase_and_values_are_finite(spark, tmp_path):
    head, row = "trade_date,value,source_name,source_timestamp,license_tag\n", "2024-01-0{},{},s,2024-02-01 00:00:00,l\n"
    (made,) = contracts.override_manifest(contracts.read_override(spark, _csv(tmp_path, head + row.format(2, 1.5) + row.format(3, 2)))).collect()
    assert (made.row_count, made.coverage_ok, made.reason_if_rejected, str(made.min_date), made.license_tag) == (2, False, "Insufficient coverage: 2 < 525 rows", "2024-01-02", "l")
    for bad in (row.format(3, 1) + row.format(2, 1), row.format(2, 1) + row.format(2, 1), row.format(2, "x"), row.format(2, "NaN"), row.format(2, "Infinity"), row.format("", 1)):
        with pytest.raises(contracts.ContractError):
            contracts.read_override(spark, _csv(tmp_path, head + bad))


def test_ticker_files_are_named_by_their_ticker(spark, tmp_path):
    for t in ("AB", "C D"):
        (tmp_path / f"{t}.csv").write_text(f"trade_date,asof_timestamp,raw_close,adj_close\n2024-01-02,2024-01-03 00:00:00,{len(t)},1\n")
    assert sorted((r.ticker, r.raw_close) for r in contracts.read_ticker_files(spark, str(tmp_path)).collect()) == [("AB", 2.0), ("C D", 3.0)]


def test_holdings_reject_pages_and_payloads_without_rows(spark, tmp_path):
    for text in ("  <!DOCTYPE html><p>x", "{}", '{"effectiveDate": "2024-01-05", "holdings": []}'):
        (tmp_path / "h.json").write_text(text)
        with pytest.raises(contracts.ContractError, match="holdings"):
            contracts.read_holdings(spark, str(tmp_path / "h.json"))


def test_snapshots_need_their_fields_and_a_time_zone(spark, tmp_path):
    read = lambda: contracts.read_snapshots(spark, str(tmp_path / "s.json"), "week_end string, published_at string", ["week_end"], "published_at")
    (tmp_path / "s.json").write_text('{"week_end": "2024-01-05", "published_at": "2024-01-05T10:00:00+02:00"}')
    assert read().selectExpr("string(published_at)").first()[0] == "2024-01-05 08:00:00"
    for text in ('{"week_end": "2024-01-05", "published_at": "2024-01-05T10:00:00"}', '{"published_at": "2024-01-05T10:00:00Z"}'):
        (tmp_path / "s.json").write_text(text)
        with pytest.raises(contracts.ContractError):
            read()


def test_holdings_rows_keep_their_order(spark, tmp_path):
    path = tmp_path / "h.json"
    path.write_text(json.dumps({"effectiveDate": "2024-01-05", "holdings": [{"ticker": "B", "percentageOfTotalNetAssets": 60.0}, {"ticker": "A", "percentageOfTotalNetAssets": 40.0}]}))
    assert [(r.pos, r.ticker) for r in contracts.read_holdings(spark, str(path)).orderBy("pos").collect()] == [(0, "B"), (1, "A")]


def test_publishing_twice_fails(spark, tmp_path):
    df = spark.range(1)
    contracts.publish(df, str(tmp_path / "out"), "2024-01-05", "r1")
    with pytest.raises(AnalysisException):
        contracts.publish(df, str(tmp_path / "out"), "2024-01-05", "r1")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, float((3 * i + len(k)) % 7)) for k in ("a", "bb") for i in range(20)]
    source = str(tmp_path / "in")
    schema = "k string, t int, x double"
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = stream_fold(stream, "k", "t", lambda: rec.EwMean(4), ["x"], "mean double")
    q = out.writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = run_fold(spark.createDataFrame(rows, schema), "k", "t", lambda: rec.EwMean(4), ["x"], "mean double")
    assert sorted(spark.table("folded").collect()) == sorted(batch.collect())


def test_canonical_json_is_exact_and_sorted():
    from chronoplane.functions.canonical import canonical

    assert canonical('{"b": 1.50, "a": [1e3, -0.0, 0.10000000000000000000001]}') == '{"a":["1000","0","0.10000000000000000000001"],"b":"1.5"}'


def test_wrapper_is_unwrapped(spark):
    from pyspark.sql import functions as F

    from chronoplane.functions.canonical import unwrapped

    df = spark.createDataFrame([('{"body_base64": "eyJhIjoxfQ=="}',), ('{"a": 2}',)], "p string")
    assert [r[0] for r in df.select(unwrapped(F.col("p"))).collect()] == ['{"a":1}', '{"a": 2}']


def test_payload_kind_goes_by_name_then_content(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.csv", "<html>"), ("a", "  <!DOCTYPE html>"), ("a", "[1]"), ("a.XLSX", "x"), ("a", "x,y")], "n string, h string")
    assert [r[0] for r in df.select(contracts.payload_kind(F.col("n"), F.col("h"))).collect()] == ["csv", "html", "json", "xlsx", "csv"]
