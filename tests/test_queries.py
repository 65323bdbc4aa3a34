"""A sample of the queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lagloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["merged_views", "significant_links", "binarize_threshold", "tension_variation", "binarize_at_least", "ranked_links", "method_summary", "min_effect", "pair_spine", "zscore_unit", "panel_events_hourly", "displacement", "signed_best_lag", "ancestor_filter", "bh_fdr_directed", "fuse_suppress", "segments", "eval_ranking", "adaptive_params", "partial_corr_3d",
         "partial_corr_5d", "clean_jumps", "response_p_values", "causal_q", "event_xcorr_permuted", "local_vol_variation", "network_pairs", "inverse_ridge", "jump_engine", "regime_features", "panel_streamed"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con, sf = duckdb.connect(), SF
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    order = sorted(ours.columns)
    a, b = (x[order].sort_values(order).reset_index(drop=True) for x in (ours, theirs))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-6)
