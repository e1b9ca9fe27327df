"""Registered queries against their SQL on the smallest tables. BARLOOM_ORACLE=all runs every pair."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = (
    "DQ5_quality_report",
    "CAL3_last_trading_day",
    "IND18_all_indicators",
    "REG12_transition_matrix",
    "SIG9_latest_signals",
    "REC12_rationale",
    "TRD2_non_overlapping",
    "PERF17_tear_sheet",
    "STAT9_alpha_newey_west",
    "WF5_out_of_sample_metrics",
    "HLD8_holdings",
    "HLD12_instrument_search",
    "STR2_change",
    "FAC9_coefficient_table",
    "PF6_correlation",
    "PF15_correlated_pairs",
    "PF15_warnings",
    "PF_rejected_books",
    "SRC2_written_and_scanned",
    "SRC5_scanned_files",
    "STR5_refreshed_value",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("BARLOOM_ORACLE") == "all" else FEW


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pd.api.types.is_datetime64_any_dtype(pdf[c]):
            pdf[c] = pdf[c].astype(str).astype(object)
        elif not pd.api.types.is_numeric_dtype(pdf[c]):
            pdf[c] = pdf[c].map(lambda v: None if pd.isna(v) else str(v))
        else:
            pdf[c] = pdf[c].astype(float)
    order = sorted(pdf.columns, key=lambda c: (pdf[c].dtype != object, c))
    return pdf.sort_values(order).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = canonical(entry.queries()[name](spark, SMALL).toPandas())
    want = canonical(duck.execute(entry.oracle_sql()[name]).fetch_df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
