"""Registered queries against their SQL at the smallest scale. A spread of them by default; set
``STRANDLINE_ALL=1`` for every one (``python -m checks.run`` does the same at any scale)."""

import os

import pytest

import __spark_entry__ as entry_points
from checks import ORACLES, QUERIES
from checks.run import compare, connect

DEFAULT = [
    "hard_filter_rules", "merge_intervals", "subtract_intervals", "overlap_join_pairs", "overlap_join_counts", "cap_per_start",
    "depth_sweep", "non_ref_posterior", "band_pass_signal", "segment_islands", "gq_blocks", "core_site_annotations", "fisher_strand",
    "rank_sum_large", "drop_symbolic_allele", "combine_blocks", "joint_af_em", "kmer_counts", "callset_compare", "pileup",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES) if os.environ.get("STRANDLINE_ALL") else DEFAULT)
def test_matches_sql(spark, duck, sf_dir, name):
    status, _, _, _, note = compare(spark, duck, name, QUERIES[name], ORACLES[name], sf_dir)
    assert status == "ok", note


def test_entry_points(spark):
    df = entry_points.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
