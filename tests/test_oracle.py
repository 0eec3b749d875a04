"""Spark query vs DuckDB oracle on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from panelengine.session import TABLES

SF_SMALL = "/root/testdata/sf0.001"

NAMES = [
    "entity_month_panel", "engineer_features", "lag_1", "ewm_span3", "temporal_split_entity",
    "range_violations", "iqr_outliers", "corr_pairs", "lag_match_rate", "regression_metrics",
    "business_metrics", "f_regression", "walk_forward_folds", "request_features", "corr_product_lever",
    "panel_without_open_month", "horizon_breakdown", "sink_metrics", "quality_verdict", "forecast_monthly", "inverse_search", "action_plan",
    "predict_levers_sequential", "lever_evolution", "lever_insights", "scan_nested_metrics",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _norm(df):
    import pandas as pd

    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else float(f"{v:.6g}"))
        else:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and pd.isna(v)) else str(v)[:10] if hasattr(v, "isoformat") else v)
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    o = con.sql(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert _norm(s) == _norm(o)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert {"entity_id", "month", "split", "revenue_month_1"} <= set(df.columns) and df.count() > 100
