"""Benchmark: wall seconds of the headline queries.

Runs every headline query once on sf0.001 to warm the JVM, then times each
one at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``, forcing full execution with the ``noop`` sink.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitelens.plans import catalog  # noqa: E402
from sitelens.session import build_session  # noqa: E402

HEADLINE = [
    "bot_tokens_joined", "prerender_routing", "url_keys", "snapshot_asof", "snapshot_stats",
    "ttl_hits", "service_metrics", "html_metadata", "html_counts", "html_clean",
    "bundle_info", "routes", "metadata_findings", "components", "chunks", "audit_score",
    "document_chunks",
]


def run(spark, name: str, sf: str) -> float:
    t0 = time.time()
    catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in HEADLINE:
        run(spark, name, warm)
    times = {name: round(run(spark, name, sf), 3) for name in HEADLINE}
    total = round(sum(times.values()), 3)
    sf_name = os.path.basename(os.path.normpath(sf)).replace("sf", "")
    print(json.dumps({"metric": "total_wall_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf_name, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
