"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

import json
import os
import time

from slopewise.plans import QUERIES
from slopewise.session import build_session

HEADLINE = [
    "subject_slopes", "eb_slope", "training_shrinkage", "earliest_assay_wide", "paired_index", "split_half_reliability",
    "stratified_folds", "regression_metrics", "auc_tie_averaged", "conformal_leave_one_out", "subgroup_audit",
    "bootstrap_increment", "nested_cv_ridge", "control_arms", "permutation_null", "site_against_random", "logistic_cv",
    "window_variants", "harmonised_pairs", "mr_estimates", "leave_one_out", "coloc_posteriors", "credible_sets",
    "ld_pairs", "ld_clump", "flatten_json", "reconcile_values",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["regression_metrics"](spark, folder).collect()  # start-up is not a query's time
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
