"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ectolog.session import local_session  # noqa: E402
from ectolog.workload import QUERIES  # noqa: E402

HEADLINE = [
    "pipe_field_tb",
    "pipe_accuracy",
    "pipe_accuracy_daily",
    "pipe_habitat",
    "pipe_effectiveness",
    "pipe_activity",
    "pipe_performance",
    "pipe_tset_table",
    "pipe_survival",
    "stream_hourly",
    "p95_hourly",
    "five_number",
    "band_match",
    "join_obs_pred",
    "argmax_ties",
    "fit_ols",
    "anova_oneway",
    "model_compare",
    "survival_glm",
    "fit_random_intercept",
    "fit_smooth",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "ectolog-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's compiler and the Python workers with queries that aren't timed.
    for name in ("group_ci", "smooth_curve"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
