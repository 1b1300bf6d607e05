"""Benchmark: run the headline queries on one scale factor, print ONE JSON line.

    BENCH_SF_DIR  (default /root/testdata/sf0.1)
    BENCH_CPUS    (default 8)      -> local[BENCH_CPUS]
    BENCH_QUERIES (optional, comma-separated subset)

Each query is forced end to end with the ``noop`` sink (full computation, no
collection to the driver). A warm-up pass of every timed query on the
smallest tables pays the one-off JIT/codegen/Python-worker cost before timing. The derived input tables (stories,
pages, bylines, sheets) are written once first; that time is reported as
``prepare_inputs_sec`` and is part of ``value``.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "extract_metadata", "byline_extract", "legacy_found", "extraction_summary", "section_counts",
    "byline_counts", "outlet_people", "gender_rollup", "first_names", "full_names", "byline_gender",
    "single_name_gender", "override_gender", "org_name_export", "token_string", "document_tokens",
    "gazetteer_mentions", "mentioned_people", "eval_rows", "eval_accuracy", "story_scan", "random_sample",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from quillstat.plans import catalog
    from quillstat.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app_name="quillstat-bench")
    names = only or HEADLINE

    # warm-up on the smallest scale factor next to the target: every timed query once, so
    # JIT, code generation and Python worker start-up are paid before timing
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for n in names:
            catalog.QUERIES[n](spark, warm).write.format("noop").mode("overwrite").save()

    # the derived story/page/byline tables are written once per session (reported apart)
    from quillstat.plans import derived
    t = time.perf_counter()
    for name in ("stories", "pages", "story_bylines", "order_bylines", "override_sheet", "eval_labels"):
        getattr(derived, name)(spark, sf_dir)
    prepare = round(time.perf_counter() - t, 3)

    times: dict[str, float] = {}
    for n in names:
        t = time.perf_counter()
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()) + prepare, 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "prepare_inputs_sec": prepare}))
    spark.stop()


if __name__ == "__main__":
    main()
