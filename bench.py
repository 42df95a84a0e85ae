"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and local[N].
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from eventframe.plans import QUERIES  # noqa: E402
from eventframe.session import local_session  # noqa: E402

HEADLINE = [
    "pair_delay", "pair_chain", "delay_stats", "delay_stats_by_key", "rundelay", "syscall_stats", "detail_context",
    "pair_lost_ranges", "call_delay", "task_state_stats", "oncpu_by_cpu", "io_stages", "exit_stats", "leak_by_stack",
    "mem_profile", "range_coalesce", "top_keys", "num_dist", "count_slots", "counter_delta", "hot_seconds",
    "flame_folded", "flame_tree", "enr_symbol_floor", "enr_comm_asof", "join_overlap", "sql_join", "sql_time_bucket",
    "flt_numeric", "fn_ipv4",
]


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session("bench", cpus, partitions=8 if not cpus.isdigit() else max(int(cpus), 1))
    # Warm the JVM on one aggregation and one window, so that the first query is not charged for start-up.
    QUERIES["delay_stats"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        # The noop sink computes every row and column without collecting them.
        run = [timed(lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()) for _ in range(runs)]
        seconds[name] = round(sorted(run)[len(run) // 2], 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(sf).name.removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
