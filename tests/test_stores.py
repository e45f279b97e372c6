"""Store files of many weeks by role, and routes that prune stores."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from chronoplane.operators import routing
from chronoplane.sources import contracts, stores

FILES = {
    "qqq_weights_2024-01-05.csv": "Date,weight,note\n2024-01-04,0.5,x\n2024-01-05T00:00:00,0.25,y\n",
    "qqq_weights_20240112.csv": "yyyymmdd,other,VALUE\n20240111,9,1.5\n20240112,9,oops\n20249999,9,1\n",
    "qqq_weights_2024-01-19.csv": "﻿Week_End,H_T\n2024-01-19,inf\n2024-01-19,2\n",
    "qqq_weights_final.csv": "a,b\n2024-02-01,7\nshort\n",
    "qqq_prices_2024-01-05.csv": "date,close\n2024-01-05,100\n",
    "qqq_weights_2024-01-26.csv": "",
    "readme.txt": "no store",
}


@pytest.fixture()
def folder(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    for name, text in FILES.items():
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(text)
    return root


def test_mixed_files_under_one_contract(spark, folder):
    df = stores.read_store(spark, folder, "qqq_weights")
    day = dt.date
    assert sorted((r.day, r.value, r.week) for r in df.where("week IS NOT NULL").collect()) == [(day(2024, 1, 4), 0.5, day(2024, 1, 5)), (day(2024, 1, 5), 0.25, day(2024, 1, 5)), (day(2024, 1, 11), 1.5, day(2024, 1, 12)), (day(2024, 1, 19), 2.0, day(2024, 1, 19))]
    assert [(r.value, r.file) for r in df.where("week IS NULL").collect()] == [(7.0, "qqq_weights_final.csv")]


def test_weeks_in_names_prune_files(spark, folder):
    day, every = dt.date, stores.read_store(spark, folder, "qqq_").collect()
    for first, last, files in ((day(2024, 1, 5), day(2024, 1, 5), 2), (day(2024, 1, 12), day(2024, 1, 20), 2), (day(2024, 1, 19), None, 2), (None, day(2024, 1, 5), 2)):
        some = stores.read_store(spark, folder, "qqq_", first, last)
        assert some.rdd.getNumPartitions() == files
        assert set(some.collect()) == {r for r in every if r.week and (first or r.week) <= r.week <= (last or r.week)}


def test_roles_by_name_then_by_place():
    assert stores.roles(["x", " Day "], ["day"], ["value"]) == (1, 0) and stores.roles(["a", "b"], ["day"], ["value"]) == (0, 1)
    assert stores.roles(["value", "date"], ["value", "date"], ["value", "date"]) == (0, 1)
    with pytest.raises(ValueError, match="no column"):
        stores.roles(["only"], ["day"], ["value"])


def test_routes_follow_result_and_gate(spark):
    rows = [("strict_recovery", True, None, True), ("strict_recovery", False, "weights", True), ("strict_recovery", None, None, True), ("degraded_backfill", True, None, True), ("block", True, None, True), ("odd", None, None, True), (None, None, None, True), (None, True, None, None)]
    weeks = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "week_end int, m string, g boolean, why string, legacy boolean")
    out = routing.routed(weeks, "m", "g", "why", "legacy")
    got = [tuple(r) for r in out.orderBy("week_end").select("store", "scheme", "strict_ok", "reason").collect()]
    assert got[0] == ("stores_strict", "strict_recovery", True, "strict_store_gate_passed")
    assert got[1] == ("controlled_block", "block", False, "strict_store_gate_failed:weights") and got[2][3] == "strict_store_gate_failed:unknown"
    assert got[3][:3] == ("stores_backfill", "degraded_backfill", False) and got[4] == got[5] == ("controlled_block", "block", False, "controlled_block_prevents_strict_contracts")
    assert got[6][:3] == ("legacy_cache_micro", None, False) and got[7] == ("none", None, False, "legacy_cache_micro_missing")
    assert [r.mode for r in routing.modes(out).orderBy("week_end").collect()] == ["strict", "blocked", "blocked", "degraded", "blocked", "blocked", "degraded", "blocked"]


def test_only_the_chosen_store_of_a_week_is_read(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    facts = spark.range(400).selectExpr("id", "CAST(id % 8 AS INT) AS week_end", "CASE id % 3 WHEN 0 THEN 'stores_strict' WHEN 1 THEN 'stores_backfill' ELSE 'legacy_cache_micro' END AS store")
    facts.write.partitionBy("store", "week_end").parquet(f"{root}/stores")
    weeks = spark.createDataFrame([(0, "strict_recovery", True), (1, "degraded_backfill", True), (2, None, None), (3, "block", True)], "week_end int, m string, g boolean").selectExpr("*", "CAST(NULL AS STRING) AS why", "true AS legacy")
    routing.routed(weeks, "m", "g", "why", "legacy").write.parquet(f"{root}/routes")
    out = routing.read_routed(spark, f"{root}/stores", spark.read.parquet(f"{root}/routes"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert {(r.week_end, r.store) for r in out.collect()} == {(0, "stores_strict"), (2, "legacy_cache_micro")}


def test_stores_logs_and_days_are_written(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    rows = spark.createDataFrame([("w1", 1), ("w1", 1), ("w2", 2)], "week_end string, v int")
    assert contracts.store_scheme(rows, "block", root) is None and contracts.store_scheme(rows, "strict", root) == f"{root}/strict"
    contracts.store_scheme(rows.where("v = 2").withColumn("v", F.lit(5)), "strict", root)
    assert sorted((r.week_end, r.v) for r in spark.read.parquet(f"{root}/strict").collect()) == [("w1", 1), ("w2", 5)]
    for _ in range(2):
        contracts.append_log(rows.limit(1), f"{root}/log")
    assert spark.read.json(f"{root}/log").count() == 2
    contracts.replace_day(rows.withColumnRenamed("week_end", "day"), f"{root}/days", "day")
    contracts.replace_day(spark.createDataFrame([("w1", 9)], "day string, v int"), f"{root}/days", "day")
    assert sorted((r.day, r.v) for r in spark.read.parquet(f"{root}/days").collect()) == [("w1", 9), ("w2", 2)]
