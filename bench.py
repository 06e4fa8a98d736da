"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is fully executed with the no-op sink (no driver collect). The log
table build (parse -> pair -> typed write) is timed as ``load_audit_log``;
reports then run over the written, month-partitioned table.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kestrel.plans import catalog  # noqa: E402
from kestrel.plans.registry import build_queries  # noqa: E402
from kestrel.session import build_session  # noqa: E402

HEADLINE = [
    "parse_log", "pair_sessions", "total_time_keyword", "top_recipes_events", "list_general_recipes",
    "count_general_recipes", "hours_keyword_window", "top_recipes_events_window", "latest_recipe_rows",
    "user_time_keyword", "list_users", "open_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    qs = build_queries()
    times: dict[str, float] = {}

    def run(name, fn):
        t0 = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    t0 = time.perf_counter()
    catalog.audit_log(spark, sf_dir)
    times["load_audit_log"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        run(name, lambda n=name: qs[n](spark, sf_dir))
    # The parse again, now that its code is compiled: lines per second and core.
    run("parse_log_warm", lambda: qs["parse_log"](spark, sf_dir))
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "parse_lines_per_sec_per_core": round(lines / times["parse_log_warm"] / cpus),
        "sf": float(m.group(1)) if m else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
