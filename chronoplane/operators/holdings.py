"""Holdings in one namespace: weight units, the full resolution cascade, validation, proofs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoplane.operators.resolve import active, clean_upper

#: The verdicts of a validation and of a proof are names that other systems read, fixed values.
PASSED_STRICT, PASSED_DEGRADED = "validation_passed_strict", "validation_passed_degraded_only"
EVIDENCE = {
    "direct_http_capture_at_or_before_sla": "verified_direct_http_capture_before_sla",
    "immutable_audit_log_at_or_before_sla": "verified_immutable_audit_log_before_sla",
    "trusted_object_version_at_or_before_sla": "verified_object_version_before_sla",
    "trusted_third_party_snapshot_at_or_before_sla": "verified_third_party_snapshot_before_sla",
}
#: Parts of field names that no proof may have, fixed values.
FORBIDDEN = ("simulated", "mocked", "synthetic_timestamp", "assumed_publication", "manual_publication", "operator_asserted")
PRIMARY = ("isin", "cusip", "sedol", "figi")


def unit_of(weights: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Add share: the weight where its group sums to about 1, a hundredth where to about 100, else unknown.

    A group with an unknown weight has no unit.
    """
    w = Window.partitionBy(*by)
    total = F.when(F.count(F.lit(1)).over(w) == F.count(weight).over(w), F.sum(weight).over(w))
    return weights.withColumn("unit", F.when(total.between(0.99, 1.01), 1.0).when(total.between(99.0, 101.0), 100.0)).withColumn("share", F.col(weight) / F.col("unit"))


def _first(table: DataFrame, keys: dict[str, Column], out: str) -> DataFrame:
    """The first row, by its place in the file, of each key; empty keys are left out."""
    keyed = table.select(*[c.alias(k) for k, c in keys.items()], "place", "instrument_id")
    there = reduce(lambda a, b: a & b, [F.col(k) != "" for k in keys])
    return keyed.where(there).groupBy(*keys).agg(F.min_by("instrument_id", "place").alias(out))


def resolve_holdings(raw: DataFrame, master: DataFrame, asof: Column, class_map: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Add instrument_id, normalization_status and normalization_source to each holding.

    Steps, the first that finds an active row of the master: the primary ids in
    order; the instrument id as written; symbol and exchange, with the share class
    where the holding names one; the share-class map; the override ledger, whose
    rows must be active and have evidence.  The first active row of a key counts.
    """
    live = master.where(active(asof))
    out = raw.withColumns({f"_{c}": clean_upper(F.col(c)) for c in (*PRIMARY, "symbol", "exchange", "share_class")}).withColumn("_own", F.trim(F.coalesce("instrument_id", F.lit(""))))
    out = out.drop("instrument_id")
    for c in PRIMARY:
        out = out.join(_first(live, {f"_{c}": clean_upper(F.col(c))}, f"by_{c}"), f"_{c}", "left")
    out = out.join(_first(live, {"_own": F.trim("instrument_id")}, "by_own"), "_own", "left")
    symbol, exchange, kind = clean_upper(F.col("canonical_symbol")), clean_upper(F.col("primary_listing_exchange")), clean_upper(F.col("share_class"))
    out = out.join(_first(live, {"_symbol": symbol, "_exchange": exchange, "_share_class": kind}, "by_class"), ["_symbol", "_exchange", "_share_class"], "left")
    out = out.join(_first(live, {"_symbol": symbol, "_exchange": exchange}, "by_symbol"), ["_symbol", "_exchange"], "left")
    by_listing = F.when(F.col("_share_class") != "", F.col("by_class")).otherwise(F.col("by_symbol"))
    known = _first(live, {"_id": F.trim("instrument_id")}, "_known")
    for name, table in (("map", class_map), ("ledger", overrides)):
        if table is None:
            out = out.withColumn(f"by_{name}", F.lit(None).cast("string"))
            continue
        valid = table.where(active(asof, "effective_from", "effective_to"))
        if name == "ledger":
            valid = valid.where(F.lower(F.col("active").cast("string")).isin("1", "true", "yes") & (F.trim(F.coalesce("source_evidence", F.lit(""))) != ""))
        first = _first(valid, {"_symbol": clean_upper(F.col("raw_symbol")), "_exchange": clean_upper(F.col("raw_exchange"))}, "_id")
        first = first.withColumn("_id", F.trim("_id")).join(known, "_id").select("_symbol", "_exchange", F.col("_known").alias(f"by_{name}"))
        out = out.join(first, ["_symbol", "_exchange"], "left")
    steps = [
        (F.coalesce(*[F.col(f"by_{c}") for c in PRIMARY]), "resolved_by_primary_id", "canonical_master_primary_id"),
        (F.col("by_own"), "resolved_by_primary_id", "canonical_master_instrument_id"),
        (by_listing, "resolved_by_exact_symbol_map", "canonical_master_symbol_exchange_share_class"),
        (F.col("by_map"), "resolved_by_share_class_map", "share_class_map"),
        (F.col("by_ledger"), "resolved_by_override_ledger", "instrument_override_ledger"),
    ]
    pick = lambda k: reduce(lambda acc, s: acc.when(s[0].isNotNull(), F.lit(s[k])), steps[1:], F.when(steps[0][0].isNotNull(), F.lit(steps[0][k]))).otherwise("unresolved")
    out = out.withColumns({"instrument_id": F.coalesce(*[s[0] for s in steps], F.lit("")), "normalization_status": pick(1), "normalization_source": pick(2)})
    return out.select(*[c for c in raw.columns if c != "instrument_id"], "instrument_id", "normalization_status", "normalization_source")


def validate_holdings(holdings: DataFrame, by: list[str], priced: DataFrame) -> DataFrame:
    """Per group the weight sum, join coverage, unresolved weight and the first reason that applies.

    Rows have instrument_id, normalized_weight, normalization_status,
    price_join_required and aggregation_allowed; ``priced`` lists the ids with prices.
    """
    required, weight = F.coalesce("price_join_required", F.lit(True)), F.col("normalized_weight")
    unresolved = F.col("normalization_status") == "unresolved"
    # Weights with no price to find don't count against the coverage.
    rows = holdings.join(priced.select("instrument_id").distinct().withColumn("_priced", F.lit(True)), "instrument_id", "left")
    scope = required & ~unresolved & (F.col("instrument_id") != "")
    ids = Window.partitionBy(*by, "instrument_id")
    rows = rows.withColumn("_again", scope & (F.sum(F.when(scope, 1).otherwise(0)).over(ids) > 1))
    part = lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0))
    out = rows.groupBy(*by).agg(
        F.sum(weight).alias("weight_sum"), part(unresolved).alias("unresolved_weight_sum"), F.when(part(required) == 0, 1.0).otherwise(part(required & F.coalesce("_priced", F.lit(False))) / part(required)).alias("join_coverage_weight"),
        F.bool_or("_again").alias("_again"), F.bool_or(scope & ~F.coalesce("aggregation_allowed", F.lit(False))).alias("_apart"), F.bool_or(weight.isNull()).alias("_unknown"),
    )
    total, cover = F.col("weight_sum"), F.col("join_coverage_weight")
    reason = (
        F.when(F.col("_unknown"), "normalization_failure").when(F.col("_again") & F.col("_apart"), "duplicate_instrument_id").when(~total.between(0.98, 1.02), "weight_sum_violation")
        .when(F.col("unresolved_weight_sum") > 0.01, "unresolved_weight_violation").when(cover < 0.95, "insufficient_join_coverage")
        .when(total.between(0.99, 1.01) & (cover >= 0.99), PASSED_STRICT).otherwise(PASSED_DEGRADED)
    )
    return out.withColumn("validation_reason", reason).withColumn("strict_validation_ok", F.col("validation_reason") == PASSED_STRICT).drop("_again", "_apart", "_unknown")


def proof_reason(fields: Column, cutoff: Column, proof: dict[str, Column], payload_hash: Column, canonical_hash: Column, host_ok: Column, method: str) -> Column:
    """Why a publication proof is strict, or the first reason against it.

    ``fields`` are the names of the proof's fields; ``proof`` has its columns by name.
    A canonical hash counts only if it was made by ``method``.
    """
    p = proof
    text = lambda c: F.coalesce(p[c], F.lit("")) != ""
    kind = F.coalesce(p["evidence_class"], F.lit(""))
    third = kind == "trusted_third_party_snapshot_at_or_before_sla"
    raw_ok = F.coalesce(payload_hash == p["content_sha256"], F.lit(False))
    canonical_ok = text("canonical_content_sha256") & F.coalesce(canonical_hash == p["canonical_content_sha256"], F.lit(False))
    missing = F.lit("missing_machine_evidence")
    sealed = ((kind == "immutable_audit_log_at_or_before_sla") & text("audit_log_sha256")) | ((kind == "trusted_object_version_at_or_before_sla") & text("object_version_id"))
    direct = kind == "direct_http_capture_at_or_before_sla"
    out = F.when(F.exists(fields, lambda f: F.lower(f).rlike("|".join(FORBIDDEN))), F.lit("simulated_field_detected"))
    out = out.when(cutoff.isNull(), F.lit("missing_sla_cutoff")).when(~text("content_sha256"), missing)
    out = out.when(text("canonical_content_sha256") & ~(F.coalesce(p["canonicalization_method"] == method, F.lit(False)) & text("canonicalization_version")), missing)
    out = out.when(payload_hash.isNotNull() & ~raw_ok & ~canonical_ok, F.lit("hash_mismatch"))
    out = out.when(p["evidence_timestamp_utc"].isNull(), missing).when(p["evidence_timestamp_utc"] > cutoff, F.lit("evidence_after_sla_cutoff"))
    out = out.when(~kind.isin(*EVIDENCE), missing).when(~third & ~F.coalesce(host_ok, F.lit(False)), F.lit("source_not_allowed"))
    out = out.when(direct & ~F.coalesce(p["http_status"] == 200, F.lit(False)), F.lit("http_status_not_success"))
    out = out.when(third & ~(text("third_party_snapshot_url") & text("verifier_sha256") & text("payload_extraction_method")), missing)
    out = out.when(third & F.coalesce(p["wrapper_detected"], F.lit(False)) & ~F.coalesce(p["wrapper_removed"], F.lit(False)), missing)
    out = out.when(~direct & ~third & ~sealed, missing)
    return reduce(lambda acc, kv: acc.when(kind == kv[0], F.lit(kv[1])), EVIDENCE.items(), out)


def resolve_listing(asked: DataFrame, renames: DataFrame, symbol: str, day: str, asof: Column) -> DataFrame:
    """Add listed_as and status: the symbol under which each (symbol, day) was listed then.

    Of the renames into a symbol that take effect after the day and are known at
    ``asof`` the last one counts, and it must be a pure rename; a rename that isn't
    known yet, where none is known, leaves the symbol unresolved.  Of several that
    take effect and became known together that of the greatest old symbol counts, longer ones being greater.
    """
    links = renames.select("old_symbol", F.col("new_symbol").alias("_new"), "effective_date", F.col("known_at").alias("_known"), "identity_type")
    hit = asked.join(links, (F.col(symbol) == F.col("_new")) & (F.col("effective_date") > F.col(day)), "left")
    seen = F.when(F.col("_known") <= asof, F.struct("effective_date", "_known", F.length("old_symbol").alias("_length"), "old_symbol"))
    out = hit.groupBy(*asked.columns).agg(F.max_by(F.struct("old_symbol", "identity_type"), seen).alias("_r"), F.count("_new").alias("_n"))
    status = F.when(F.col("_n") == 0, "unchanged").when(F.col("_r").isNull(), "not_visible").when(F.col("_r.identity_type") != "pure_rename", "not_bridgeable").otherwise("renamed")
    out = out.withColumn("status", status)
    return out.select(*asked.columns, F.when(F.col("status") == "unchanged", F.col(symbol)).when(F.col("status") == "renamed", F.col("_r.old_symbol")).alias("listed_as"), "status")
