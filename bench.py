"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run to completion with the ``noop`` sink (full computation, nothing
collected to the driver). Times include planning.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weftmark.plans.queries import QUERIES  # noqa: E402
from weftmark.session import local_session  # noqa: E402

HEADLINE = [
    "page_markdown",
    "rich_page_markdown",
    "html_tokens",
    "text_nodes",
    "noise_filter",
    "url_validation",
    "summarize_documents",
    "result_sink",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="weftmark-bench")
    names = sys.argv[1:] or HEADLINE
    # warm-up: JVM, codegen caches
    QUERIES["token_estimate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
