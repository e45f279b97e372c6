"""The catalogue against DuckDB on the smallest tables; the guard for the optional part."""

import glob
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from chronoplane import plans

SF = "/root/testdata/sf0.001"
SAMPLE = ["asof_frame", "source_precedence", "source_overlaps", "ols_fit", "ols_splice_rows", "eigen_diagnostics", "replay_parts", "scenario_differences", "scenario_summary", "regime_summary", "running_regimes", "warmup_graph", "warmup_chain", "week_routes", "distribution", "cliffs_delta", "weights_last_row", "store_gate", "asof_backward", "adjustment_factor", "rob_z", "ew_z", "lead_envelope", "revision_detail", "transition_matrix", "correlation_concentration", "backtest", "dunn_holm", "ols_hac", "order_ledger", "cov2d_state", "alert_log", "ops_status", "signal_gate", "rename_bridge", "holdings_resolution", "holdings_validation", "publication_proof", "adjusted_window_ledger", "canonical_payload", "realized_metrics", "forward_metrics", "state_pairs", "state_separation", "predictive_rows", "bucket_sets", "bucket_lookup", "target_weights", "order_summary", "micro_daily", "state_factors", "drift_probe", "health_counts", "window_coverage", "semantic_labels", "strict_days", "exogenous_memory", "backtest", "comparison_table"]


def _canonical(df: pd.DataFrame) -> list:
    def text(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return ""
        return f"{x:.8g}" if isinstance(x, float) else str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert _canonical(plans.queries()[name](spark, SF).toPandas()) == _canonical(con.execute(plans.oracle_sql()[name]).df())


@pytest.mark.parametrize("gone", ["corpus_pipeline", "chronoplane.llm"])
def test_entry_works_without_the_optional_part(gone):
    code = f"import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; assert 'rob_z' in e.queries() and 'pipeline' not in e.queries() and 'rob_z' in e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
