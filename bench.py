"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from usagelens.plans.queries import QUERIES  # noqa: E402
from usagelens.session import local_session  # noqa: E402

HEADLINE = (
    "spend_by_model_day",
    "billing_spend_by_model_day",
    "model_mix",
    "token_histograms",
    "long_context_tail",
    "error_rate",
    "requests_by_hour",
    "request_log_lines",
    "request_log_csv",
    "activity_csv",
    "prompt_sketches",
    "exact_duplicates",
    "near_duplicates",
    "templated_near_duplicates",
    "identifier_scan",
    "report_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = local_session("usagelens-bench", cores)
    QUERIES["requests_by_hour"](spark, sf_dir).count()  # start the workers
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
