"""Queries on holdings: units, resolution, validation, proofs, renames, adjusted prices under identities."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.functions import canonical, scalars
from chronoplane.operators import holdings, pit
from chronoplane.plans.inputs import VINTAGES_SQL, vintages
from chronoplane.plans.registry import neat, query, table

_ASOF = "DATE '1997-01-01'"


def _master(spark, sf_dir):
    k = F.col("s_suppkey")
    text = lambda p: F.concat(F.lit(p), k % 90)
    return table(spark, sf_dir, "supplier").select(
        k.alias("place"), F.concat(F.lit("I"), k).alias("instrument_id"), text("SYM").alias("canonical_symbol"), F.concat(F.lit("X"), k % 3).alias("primary_listing_exchange"), F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").otherwise("").alias("share_class"),
        text("ISIN").alias("isin"), text("CU").alias("cusip"), F.when(k % 2 == 0, text("SE")).alias("sedol"), F.lit("").alias("figi"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 900).cast("int")).alias("active_from"), F.when(k % 5 == 0, F.lit("1996-06-01").cast("date")).alias("active_to"), (k % 6 != 0).alias("price_join_required"), (k % 7 != 0).alias("aggregation_allowed"),
    )


def _raw(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda n, text, span: F.when(k % n == 0, F.concat(F.lit(f" {text}"), k % span))
    own = (k % 13 + 1).cast("double")
    return table(spark, sf_dir, "customer").select(
        k.alias("row_id"), F.col("c_nationkey").alias("book"), F.concat(F.lit("sym"), k % 110, F.lit(" ")).alias("symbol"), F.when(k % 3 != 0, F.concat(F.lit("x"), k % 4)).alias("exchange"), F.when(k % 5 == 0, "a").alias("share_class"),
        pick(4, "isin", 120).alias("isin"), pick(6, "cu", 100).alias("cusip"), pick(7, "se", 100).alias("sedol"), F.lit(None).cast("string").alias("figi"), F.when(k % 11 == 0, F.concat(F.lit("I"), k % 120)).alias("instrument_id"),
        (F.when(F.col("c_nationkey") % 3 == 0, 100.0).otherwise(1.0) * own / F.sum(own).over(Window.partitionBy("c_nationkey"))).alias("weight"),
    )


def _tables(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    maps = s.select(k.alias("place"), F.concat(F.lit("sym"), k + 20).alias("raw_symbol"), F.concat(F.lit("X"), k % 4).alias("raw_exchange"), F.concat(F.lit("I"), k).alias("instrument_id"), F.when(k % 3 == 0, F.lit("1997-06-01").cast("date")).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    ledger = s.select(k.alias("place"), F.concat(F.lit("sym"), k + 30).alias("raw_symbol"), F.concat(F.lit("x"), k % 3).alias("raw_exchange"), F.concat(F.lit("I"), k).alias("instrument_id"), F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"),
                      F.when(k % 4 == 0, "no").otherwise("Yes").alias("active"), F.when(k % 5 != 0, "file").alias("source_evidence"))
    return maps, ledger


_HELD = f"""master AS (SELECT s_suppkey AS place, 'I' || s_suppkey AS instrument_id, 'SYM' || s_suppkey % 90 AS symbol, 'X' || s_suppkey % 3 AS exchange, CASE s_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS share_class, 'ISIN' || s_suppkey % 90 AS isin, 'CU' || s_suppkey % 90 AS cusip,
      CASE WHEN s_suppkey % 2 = 0 THEN 'SE' || s_suppkey % 90 END AS sedol, DATE '1995-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS active_from, CASE WHEN s_suppkey % 5 = 0 THEN DATE '1996-06-01' END AS active_to, s_suppkey % 6 <> 0 AS price_join_required, s_suppkey % 7 <> 0 AS aggregation_allowed FROM supplier),
    live AS (SELECT * FROM master WHERE active_from <= {_ASOF} AND (active_to IS NULL OR {_ASOF} <= active_to)),
    raw AS (SELECT c_custkey AS row_id, c_nationkey AS book, 'SYM' || c_custkey % 110 AS symbol, CASE WHEN c_custkey % 3 <> 0 THEN 'X' || c_custkey % 4 ELSE '' END AS exchange, CASE WHEN c_custkey % 5 = 0 THEN 'A' ELSE '' END AS share_class, CASE WHEN c_custkey % 4 = 0 THEN 'ISIN' || c_custkey % 120 END AS isin,
      CASE WHEN c_custkey % 6 = 0 THEN 'CU' || c_custkey % 100 END AS cusip, CASE WHEN c_custkey % 7 = 0 THEN 'SE' || c_custkey % 100 END AS sedol, CASE WHEN c_custkey % 11 = 0 THEN 'I' || c_custkey % 120 END AS own,
      CASE WHEN c_nationkey % 3 = 0 THEN 100e0 ELSE 1e0 END * (c_custkey % 13 + 1) / sum(c_custkey % 13 + 1) OVER (PARTITION BY c_nationkey) AS weight FROM customer),
    smap AS (SELECT s_suppkey AS place, 'SYM' || (s_suppkey + 20) AS symbol, 'X' || s_suppkey % 4 AS exchange, 'I' || s_suppkey AS instrument_id FROM supplier WHERE s_suppkey % 3 <> 0),
    ledger AS (SELECT s_suppkey AS place, 'SYM' || (s_suppkey + 30) AS symbol, 'X' || s_suppkey % 3 AS exchange, 'I' || s_suppkey AS instrument_id FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0),
    hit AS (SELECT r.*, coalesce((SELECT arg_min(instrument_id, place) FROM live m WHERE m.isin = r.isin), (SELECT arg_min(instrument_id, place) FROM live m WHERE m.cusip = r.cusip), (SELECT arg_min(instrument_id, place) FROM live m WHERE m.sedol = r.sedol)) AS a,
      (SELECT arg_min(instrument_id, place) FROM live m WHERE m.instrument_id = r.own) AS b,
      (SELECT arg_min(instrument_id, place) FROM live m WHERE m.symbol = r.symbol AND m.exchange = r.exchange AND (r.share_class = '' OR m.share_class = r.share_class)) AS c,
      (SELECT arg_min(instrument_id, place) FROM smap m WHERE m.symbol = r.symbol AND m.exchange = r.exchange AND r.exchange <> '') AS d0,
      (SELECT arg_min(instrument_id, place) FROM ledger m WHERE m.symbol = r.symbol AND m.exchange = r.exchange AND r.exchange <> '') AS e0 FROM raw r),
    found AS (SELECT *, CASE WHEN d0 IN (SELECT instrument_id FROM live) THEN d0 END AS d, CASE WHEN e0 IN (SELECT instrument_id FROM live) THEN e0 END AS e FROM hit),
    resolved AS (SELECT row_id, book, weight, coalesce(a, b, c, d, e, '') AS instrument_id, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'resolved_by_primary_id' WHEN c IS NOT NULL THEN 'resolved_by_exact_symbol_map' WHEN d IS NOT NULL THEN 'resolved_by_share_class_map'
      WHEN e IS NOT NULL THEN 'resolved_by_override_ledger' ELSE 'unresolved' END AS normalization_status, CASE WHEN a IS NOT NULL THEN 'canonical_master_primary_id' WHEN b IS NOT NULL THEN 'canonical_master_instrument_id' WHEN c IS NOT NULL THEN 'canonical_master_symbol_exchange_share_class'
      WHEN d IS NOT NULL THEN 'share_class_map' WHEN e IS NOT NULL THEN 'instrument_override_ledger' ELSE 'unresolved' END AS normalization_source FROM found),
    shared AS (SELECT *, CASE WHEN total BETWEEN 0.99 AND 1.01 THEN weight WHEN total BETWEEN 99 AND 101 THEN weight / 100e0 END AS share FROM (SELECT *, sum(weight) OVER (PARTITION BY book) AS total FROM resolved))"""


def _resolved(spark, sf_dir):
    maps, ledger = _tables(spark, sf_dir)
    out = holdings.resolve_holdings(_raw(spark, sf_dir), _master(spark, sf_dir), F.lit("1997-01-01").cast("date"), maps, ledger)
    return holdings.unit_of(out, ["book"], "weight")


@query("holdings_resolution", f"WITH {_HELD} SELECT row_id, book, instrument_id, normalization_status, normalization_source, round(share, 9) + 0.0 AS share FROM shared")
def holdings_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("row_id", "book", "instrument_id", "normalization_status", "normalization_source", neat("share", 9).alias("share"))


@query(
    "holdings_validation",
    f"""WITH {_HELD}, n AS (SELECT r.book, r.instrument_id, CASE WHEN r.row_id % 25 = 3 AND normalization_status = 'unresolved' THEN 0 ELSE share END AS share, normalization_status = 'unresolved' AS lost, coalesce(m.price_join_required, true) AS need, coalesce(m.aggregation_allowed, false) AS many, r.instrument_id IN (SELECT instrument_id FROM master WHERE place % 50 <> 7) AS priced
      FROM shared r LEFT JOIN master m USING (instrument_id)), k AS (SELECT *, need AND NOT lost AND instrument_id <> '' AS scope FROM n),
    t AS (SELECT *, scope AND sum(CAST(scope AS INTEGER)) OVER (PARTITION BY book, instrument_id) > 1 AS again FROM k),
    v AS (SELECT book, sum(share) AS weight_sum, coalesce(sum(share) FILTER (lost), 0) AS unresolved_weight_sum, CASE WHEN coalesce(sum(share) FILTER (need), 0) = 0 THEN 1 ELSE coalesce(sum(share) FILTER (need AND priced), 0) / sum(share) FILTER (need) END AS join_coverage_weight, bool_or(again) AS again, bool_or(scope AND NOT many) AS apart FROM t GROUP BY 1),
    x AS (SELECT *, CASE WHEN again AND apart THEN 'duplicate_instrument_id' WHEN NOT weight_sum BETWEEN 0.98 AND 1.02 THEN 'weight_sum_violation' WHEN unresolved_weight_sum > 0.01 THEN 'unresolved_weight_violation' WHEN join_coverage_weight < 0.95 THEN 'insufficient_join_coverage'
      WHEN weight_sum BETWEEN 0.99 AND 1.01 AND join_coverage_weight >= 0.99 THEN 'validation_passed_strict' ELSE 'validation_passed_degraded_only' END AS validation_reason FROM v)
    SELECT book, round(weight_sum, 9) + 0.0 AS weight_sum, round(unresolved_weight_sum, 9) + 0.0 AS unresolved_weight_sum, round(join_coverage_weight, 9) + 0.0 AS join_coverage_weight, validation_reason, validation_reason = 'validation_passed_strict' AS strict_validation_ok FROM x""",
)
def holdings_validation(spark, sf_dir):
    facts = _master(spark, sf_dir).select("instrument_id", "price_join_required", "aggregation_allowed", "place")
    rows = _resolved(spark, sf_dir).withColumn("normalized_weight", F.when((F.col("row_id") % 25 == 3) & (F.col("normalization_status") == "unresolved"), 0.0).otherwise(F.col("share"))).drop("share").join(facts.drop("place"), "instrument_id", "left")
    out = holdings.validate_holdings(rows, ["book"], facts.where("place % 50 <> 7"))
    return out.withColumns({c: neat(c, 9) for c in ("weight_sum", "unresolved_weight_sum", "join_coverage_weight")})


_CLASSES = list(holdings.EVIDENCE) + ["hearsay"]
_TEXTS = {"content_sha256": 7, "canonical_content_sha256": 0, "audit_log_sha256": 4, "object_version_id": 6, "third_party_snapshot_url": 8, "verifier_sha256": 9, "payload_extraction_method": 10}


@query(
    "publication_proof",
    f"""WITH p AS (SELECT page_id, page_id AS i, [{', '.join(f"'{c}'" for c in _CLASSES)}][1 + page_id // 2 % 5] AS kind, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 5 = 0 THEN 'other' ELSE sha256(html) END AS sealed, CASE WHEN page_id % 15 = 0 THEN sha256(html || '') ELSE '' END AS canon, sha256(html) AS own,
      regexp_matches(url, '^https?://([^/]*\\.)?example\\.(com|org)([/:?#]|$)') AS host, CASE WHEN page_id % 11 <> 0 THEN page_id % 72 END AS hours FROM pages)
    SELECT page_id, CASE WHEN i % 41 = 0 THEN 'simulated_field_detected' WHEN i % 37 = 0 THEN 'missing_sla_cutoff' WHEN sealed = '' THEN 'missing_machine_evidence' WHEN canon <> '' AND (i % 30 = 0 OR i % 45 = 0) THEN 'missing_machine_evidence' WHEN sealed <> own AND canon <> own THEN 'hash_mismatch'
      WHEN hours IS NULL THEN 'missing_machine_evidence' WHEN hours > 60 THEN 'evidence_after_sla_cutoff' WHEN kind = 'hearsay' THEN 'missing_machine_evidence' WHEN kind <> '{_CLASSES[3]}' AND NOT host THEN 'source_not_allowed' WHEN kind = '{_CLASSES[0]}' AND i % 3 = 0 THEN 'http_status_not_success'
      WHEN kind = '{_CLASSES[3]}' AND (i % 8 = 0 OR i % 9 = 0 OR i % 10 = 0) THEN 'missing_machine_evidence' WHEN kind = '{_CLASSES[3]}' AND i % 2 = 1 AND i % 13 < 6 THEN 'missing_machine_evidence' WHEN kind = '{_CLASSES[1]}' AND i % 4 = 0 THEN 'missing_machine_evidence'
      WHEN kind = '{_CLASSES[2]}' AND i % 6 = 0 THEN 'missing_machine_evidence' {' '.join(f"WHEN kind = '{a}' THEN '{b}'" for a, b in holdings.EVIDENCE.items())} END AS reason FROM p""",
)
def publication_proof(spark, sf_dir):
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    start = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    there = {c: F.when(i % n != 0, "x").otherwise("") for c, n in _TEXTS.items() if n}
    proof = there | {
        "content_sha256": F.when(i % 7 == 0, "").when(i % 5 == 0, "other").otherwise(F.sha2("html", 256)), "canonical_content_sha256": F.when(i % 15 == 0, F.sha2("html", 256)).otherwise(""),
        "canonicalization_method": F.when(i % 45 == 0, "sorted").otherwise(canonical.METHOD), "canonicalization_version": F.when(i % 30 != 0, "1"), "evidence_class": F.get(F.array(*[F.lit(c) for c in _CLASSES]), (F.floor(i / 2) % 5).cast("int")),
        "evidence_timestamp_utc": F.when(i % 11 != 0, start + F.make_dt_interval(hours=(i % 72).cast("int"))), "http_status": F.when(i % 3 == 0, 404).otherwise(200), "wrapper_detected": i % 2 == 1, "wrapper_removed": i % 13 >= 6,
    }
    fields = F.when(i % 41 == 0, F.array(F.lit("Simulated_at"))).otherwise(F.array(F.lit("evidence_class")))
    cutoff = F.when(i % 37 != 0, start + F.make_dt_interval(hours=F.lit(60)))
    reason = holdings.proof_reason(fields, cutoff, proof, F.sha2("html", 256), F.sha2("html", 256), scalars.host_allowed(F.col("url"), ["example.com", "example.org"]), canonical.METHOD)
    return p.select("page_id", reason.alias("reason"))


_RENAMES = """r AS (SELECT 'OLD' || s_suppkey AS old_symbol, 'NEW' || s_suppkey % 70 AS new_symbol, DATE '1997-06-01' + CAST(s_suppkey * 31 % 700 AS INTEGER) AS effective_date, DATE '1997-05-01' + CAST(s_suppkey * 17 % 900 AS INTEGER) AS known_at, CASE WHEN s_suppkey % 6 = 0 THEN 'merger' ELSE 'pure_rename' END AS identity_type FROM supplier)"""


def _renames(spark, sf_dir):
    k = F.col("s_suppkey")
    moved = lambda start, by, span: F.date_add(F.lit(start).cast("date"), (k * by % span).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("OLD"), k).alias("old_symbol"), F.concat(F.lit("NEW"), k % 70).alias("new_symbol"), moved("1997-06-01", 31, 700).alias("effective_date"), moved("1997-05-01", 17, 900).alias("known_at"), F.when(k % 6 == 0, "merger").otherwise("pure_rename").alias("identity_type"))


@query(
    "rename_bridge",
    f"""WITH {VINTAGES_SQL}, {_RENAMES}, q AS (SELECT DISTINCT 'NEW' || ticker % 80 AS symbol, date_trunc('month', day)::DATE AS day FROM vintages),
    h AS (SELECT q.symbol, q.day, count(r.new_symbol) AS n, arg_max({{'o': r.old_symbol, 't': r.identity_type}}, (r.effective_date, r.known_at)) FILTER (r.known_at <= DATE '1998-06-01') AS x FROM q LEFT JOIN r ON r.new_symbol = q.symbol AND r.effective_date > q.day GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN n = 0 THEN 'unchanged' WHEN x IS NULL THEN 'not_visible' WHEN x.t <> 'pure_rename' THEN 'not_bridgeable' ELSE 'renamed' END AS status FROM h) SELECT symbol, day, CASE status WHEN 'unchanged' THEN symbol WHEN 'renamed' THEN x.o END AS listed_as, status FROM s""",
)
def rename_bridge(spark, sf_dir):
    asked = vintages(spark, sf_dir).select(F.concat(F.lit("NEW"), F.col("ticker") % 80).alias("symbol"), F.trunc("day", "month").alias("day")).distinct()
    return holdings.resolve_listing(asked, _renames(spark, sf_dir), "symbol", "day", F.lit("1998-06-01").cast("date"))


_VISIBLE = f"{VINTAGES_SQL}, seen AS (SELECT ticker, day, arg_max(value, (known_at, value)) AS raw_close, arg_max(l_discount, (known_at, value)) AS d FROM vintages WHERE known_at <= DATE '1998-06-01' GROUP BY 1, 2), bars AS (SELECT *, 1 + d AS cum_factor FROM seen)"


def _bars(spark, sf_dir):
    seen = vintages(spark, sf_dir).where("known_at <= DATE'1998-06-01'")
    last = seen.groupBy("ticker", "day").agg(F.max_by("value", F.struct("known_at", "value")).alias("raw_close"), F.max_by("l_discount", F.struct("known_at", "value")).alias("d"))
    return last.withColumn("cum_factor", 1 + F.col("d"))


@query("adjusted_close_fixture", f"WITH {_VISIBLE} SELECT ticker, day, round(raw_close * cum_factor, 4) + 0.0 AS adj_close FROM bars")
def adjusted_close_fixture(spark, sf_dir):
    return pit.fixture_close(_bars(spark, sf_dir), "raw_close", "cum_factor").select("ticker", "day", neat("adj_close", 4).alias("adj_close"))


def _windows_sql(value: str) -> str:
    return f"""WITH {_VISIBLE}, w AS (SELECT ticker, day, count(*) OVER t AS n, cum_factor AS basis, list({{'r': raw_close, 'c': cum_factor}}) OVER t AS x FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY day ROWS 4 PRECEDING))
    SELECT ticker, day, CASE WHEN n < 5 THEN 'insufficient_history' ELSE 'ok' END AS status, CASE WHEN n = 5 THEN array_to_string(list_transform(x, lambda v: printf('%.6f', {value})), ',') END AS window_text FROM w"""


def _windows(df):
    text = F.when(F.col("status") == "ok", F.array_join(F.transform("window", lambda v: scalars.fixed(v, 6)), ","))
    return df.select("ticker", "day", "status", text.alias("window_text"))


@query("adjusted_window_fixture", _windows_sql("v.r * (basis / v.c)"))
def adjusted_window_fixture(spark, sf_dir):
    """The basis of the last bar divides by each bar's own factor."""
    return _windows(pit.basis_window(_bars(spark, sf_dir), "ticker", "day", "raw_close", "cum_factor", 5, True))


@query("adjusted_window_constant", _windows_sql("v.r * basis"))
def adjusted_window_constant(spark, sf_dir):
    """One basis, that of the last bar, for the whole window."""
    return _windows(pit.basis_window(_bars(spark, sf_dir), "ticker", "day", "raw_close", "cum_factor", 5, False))


_LEDGER = f"""{VINTAGES_SQL}, px AS (SELECT CASE WHEN ticker % 2 = 0 THEN 'NEW' ELSE 'OLD' END || (ticker - ticker % 2) AS symbol, day, arg_max(value, (known_at, value)) AS raw, max(known_at) AS known FROM vintages GROUP BY 1, 2),
    ok AS (SELECT * FROM px WHERE known <= DATE '1998-06-01'), ren AS (SELECT 'OLD' || s_suppkey AS old_symbol, 'NEW' || s_suppkey AS new_symbol, DATE '1996-01-01' + CAST(s_suppkey * 13 % 900 AS INTEGER) AS effective_date FROM supplier),
    acts AS (SELECT CASE WHEN ticker % 2 = 0 THEN 'NEW' ELSE 'OLD' END || (ticker - ticker % 2) AS symbol, day, CASE WHEN l_discount > 0.08 THEN 1 - l_discount ELSE 1 END AS factor FROM vintages WHERE known_at <= DATE '1998-06-01'),
    own AS (SELECT symbol AS ticker, symbol, day, raw FROM ok UNION ALL SELECT r.new_symbol, o.symbol, o.day, o.raw FROM ok o JOIN ren r ON r.old_symbol = o.symbol AND r.effective_date > o.day WHERE NOT EXISTS (SELECT 1 FROM ok d WHERE d.symbol = r.new_symbol AND d.day = o.day)),
    ask AS (SELECT DISTINCT symbol AS ticker, date_trunc('month', day)::DATE + 14 AS end_day FROM ok),
    b AS (SELECT a.ticker, a.end_day, o.symbol, o.day, o.raw, row_number() OVER (PARTITION BY a.ticker, a.end_day ORDER BY o.day DESC) AS back FROM ask a JOIN own o ON o.ticker = a.ticker AND o.day <= a.end_day),
    f AS (SELECT b.*, coalesce((SELECT exp(sum(ln(factor))) FROM acts x WHERE x.symbol = b.symbol AND x.day > b.day AND x.day <= b.end_day), 1) AS factor FROM b WHERE back <= 4)"""


@query(
    "adjusted_window_ledger",
    f"WITH {_LEDGER} SELECT ticker, end_day, CASE WHEN count(*) < 4 THEN 'insufficient_history' ELSE 'ok' END AS status, CASE WHEN count(*) = 4 THEN string_agg(symbol || ':' || printf('%.8f', raw * factor), ',' ORDER BY day) END AS window_text FROM f GROUP BY 1, 2",
)
def adjusted_window_ledger(spark, sf_dir):
    """Windows across renames: a day without a price of its own takes the old symbol's."""
    v, asof = vintages(spark, sf_dir), F.lit("1998-06-01").cast("date")
    symbol = F.concat(F.when(F.col("ticker") % 2 == 0, "NEW").otherwise("OLD"), F.col("ticker") - F.col("ticker") % 2)
    prices = pit.latest_then_checked(v.withColumn("symbol", symbol), ["symbol", "day"], "known_at", "value", asof)
    k = F.col("s_suppkey")
    renames = table(spark, sf_dir, "supplier").select(F.concat(F.lit("OLD"), k).alias("old_symbol"), F.concat(F.lit("NEW"), k).alias("new_symbol"), F.date_add(F.lit("1996-01-01").cast("date"), (k * 13 % 900).cast("int")).alias("effective_date"))
    actions = v.where(F.col("known_at") <= asof).select(symbol.alias("symbol"), "day", F.when(F.col("l_discount") > 0.08, 1 - F.col("l_discount")).otherwise(1.0).alias("factor"))
    asked = prices.select(F.col("symbol").alias("ticker"), F.date_add(F.trunc("day", "month"), 14).alias("end_day")).distinct()
    out = pit.ledger_window(asked, prices.select("symbol", "day", F.col("value").alias("raw")), actions, renames, 4)
    text = F.when(F.col("status") == "ok", F.array_join(F.transform("window", lambda x: F.concat(x["symbol"], F.lit(":"), scalars.fixed(x["price"], 8))), ","))
    return out.select("ticker", "end_day", "status", text.alias("window_text"))
