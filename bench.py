"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query runs once to warm up code and caches of the file system, then once for the time; its
result is computed whole but not sent to the driver. BENCH_QUERIES and BENCH_RUNS narrow it for a quick look."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioscope.plans import catalog  # noqa: E402
from folioscope.session import local_session  # noqa: E402

HEADLINES = ("score_total_grade", "findings_union", "str001", "str003", "str004", "meta007", "markdown_serialize", "chunk_plan", "extract_ids", "trace_findings", "shared_id_pairs_topk", "verify_reasons", "report_upsert_latest", "quota_daily", "lint_documents", "html_pages_blocks")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores=cpus, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    took = {}
    for name in names:
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
