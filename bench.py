"""All queries but the corpus operators at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardflow.plans import queries  # noqa: E402
from wardflow.session import local_session  # noqa: E402

# A model of 300 or 400 trees is 2,000 small jobs and takes minutes at any size: these are run with BENCH_ALL=1.
# One tree of each loss is timed by the *_root_split queries.
LONG = {"no_show_boosted_metrics", "duration_boosted_metrics", "demand_boosted_metrics"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "wardflow-bench")
    available = queries()
    names = sys.argv[1:] or [n for n in available if os.environ.get("BENCH_ALL") or n not in LONG]

    def run(name: str) -> float:
        start = time.perf_counter()
        available[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # The first pass pays for JVM start and code generation; the second is reported.
    first = {name: run(name) for name in names}
    times = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "all_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")), "pass": "second of two", "first_pass_total": round(sum(first.values()), 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
