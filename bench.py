"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion with a ``noop`` write (every row computed,
nothing collected to the driver).  JVM warm-up (class loading, JIT, code
generation) would otherwise land on whichever query runs first, so the headline
set is first run once on the smallest tables (``$BENCH_WARMUP_DIR``, default
sf0.001; not timed), then every query is timed once over the full bench tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weftview.plans import registry  # noqa: E402
from weftview.session import local_session  # noqa: E402

HEADLINE = ["html_tokens", "main_content", "clean_text", "raw_markdown", "links",
            "nav_history", "nav_dedup", "response_lines", "view_prompts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="weftview-bench")
    qs = registry.queries()
    names = sys.argv[1:] or HEADLINE
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm_dir and os.path.isdir(warm_dir):
        for name in names:
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    total = round(sum(times.values()), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "pages": n_pages,
                      "pages_per_sec_clean_text": round(n_pages / times["clean_text"], 1)
                      if "clean_text" in times and times["clean_text"] else None}))


if __name__ == "__main__":
    main()
