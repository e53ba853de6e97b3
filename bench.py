"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "hard_filter_rules", "filter_fail_reason", "merge_intervals", "subtract_intervals", "depth_sweep", "overlap_join_pairs",
    "overlap_semi", "tile_counts", "cap_per_start", "ref_vs_any_gl", "band_pass_signal", "segment_islands", "gq_blocks",
    "core_site_annotations", "fisher_strand", "rank_sum_large", "pileup", "joint_af_em", "combine_blocks", "kmer_counts",
    "callset_compare",
]


def main() -> None:
    from checks import QUERIES
    from strandline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or [q for q in HEADLINE if q in QUERIES]
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in only:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
