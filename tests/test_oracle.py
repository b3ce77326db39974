"""Registered queries against their SQL. A core set by default, all with ALL_QUERIES=1."""

import os

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [
    "unit_qc_table", "isi_violations", "binned_counts_spine", "raster_jitter_dilated", "rate_set_window", "runs_of_activity",
    "bursts_cleaned_compat", "burst_unit_means", "sttc", "sttc_lagged", "correlation_index", "autocorrelogram",
    "word_independence_z", "sync_periods", "stpr_leave_one_out", "virtual_ref_cmr", "mad_per_channel", "sliding_corr",
    "mutual_info", "welch", "multitaper", "coherence_segments", "morlet_cwt", "h_test", "modulation_index",
    "spike_triggered_average", "best_channel", "extract_waveforms", "outer_merge_three", "qc_drop_keep_null", "kcsd_estimate",
]


def test_registry_is_complete():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(CORE) <= set(o)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else CORE)
def test_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    assert compare(df, connect(SF), entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
