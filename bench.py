"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plotshift.plans import catalog  # noqa: E402
from plotshift.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_class_summary",
    "geom_core",
    "geom_shape",
    "geom_hull",
    "geom_hu",
    "geom_validity",
    "dates_gaps",
    "bands_indices",
    "bands_stats",
    "change_acceleration",
    "change_cumulative",
    "status_transitions",
    "profile_nulls",
    "profile_describe",
    "describe_lineitem",
    "box_stats",
    "cat_onehot_union",
    "cat_multilabel",
    "cat_target",
    "cat_target_customer",
    "fill_median",
    "scale_std",
    "select_anova",
    "anova_lineitem",
    "folds_stratified",
    "folds_lineitem",
    "nn_self",
    "nn_cross",
    "radius_vote",
    "knn_area",
    "kde_centroid",
    "blend_argmax",
    "metrics_scores",
    "train_rf",
    "train_gbt",
    "pipeline_ensemble",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
