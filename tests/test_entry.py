"""The driver's contract, and SQL against DuckDB on the smallest tables where they exist."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
    there = (Path(e.__file__).parent / "cellmend" / "llm" / "queries.py").exists()
    assert ("p3_found" in e.queries()) == there


def _plain(v):
    import decimal
    import math

    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal | float):
        return None if v != v else round(float(v), 7) if not math.isinf(float(v)) else v
    return v if not isinstance(v, int) else float(v)


CHEAP = [
    "cell_diff", "value_type_and_format", "token_estimate", "fd_groups_orders", "column_profile", "latest_ledger_row", "response_bank", "metrics_summary", "aubc", "quadrants_grouping_sets", "mcnemar_holm",
    "nearest_rank_percentile", "half_stride_windows", "hamilton_quota", "sigma_ell", "merged_ledger", "verifier_decision", "rejection_reasons", "full_baselines", "transfer_outcomes", "identity_audit", "identity_drift", "union_plan",
    "union_plan_totals", "execution_differences", "reuse_audit", "reuse_import", "selected_executions", "streamed_ledger", "cache_union_audit", "api_cost_total", "cost_index", "group_savings", "selection_audit_full", "selection_differences",
    "selection_difference_summary", "metric_delta_rows", "metric_deltas", "ledger_diff_groups", "complementarity_full", "paired_cluster_matrix", "group_metrics", "group_transitions", "answer_states", "calibration_labels", "candidate_ranks",
    "candidate_diagnostics", "missing_fields", "split_overlaps", "join_violations", "evidence_drift", "recomputed_verdicts", "top_tenth_uplift", "choice_holds", "schedule_holds", "partition_holds", "p1_found", "p5_found", "p5_messages",
]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", CHEAP)
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = e.queries()[name](spark, str(DATA))
    rel = con.sql(e.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in names]
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
