"""Wall time of the headline queries; prints one JSON line.

Every query is run in full into a sink that discards rows, so the whole result
is computed and none of it passes through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loam.bindings import Tables  # noqa: E402
from loam.catalogue import all_queries  # noqa: E402
from loam.session import build_session, scratch  # noqa: E402

HEADLINE = [
    "flagship_hourly_readings", "prj8_lake_rows", "sc9_query_units", "jn2_audit_names",
    "jn9_query_spend_by_sensor", "agg1_sliding_counts", "agg8_running_cost",
    "agg13_cycle_summary", "agg16_message_counters", "agg18_latest_hardware",
    "agg20_counter_rate", "agg22_rolling_day", "win2_balance_after", "win4_overdraft_freeze",
    "win5_latest_reading", "win7_last_messages", "win8_sustained_lag", "win13_audit_trail",
    "ord2_latest_of_sensor", "sql1_join_group_topk", "sql8_ranking", "sql12_subqueries",
    "str1_watermark", "str10_running_counters", "str11_billing_fold",
]


def discard(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def ingest_rate(spark, folder: str, drop_replays: bool) -> tuple[float, int]:
    """Seconds and records of one run of the ingest stream into a new lake, with or without looking stored records up."""
    from loam.catalogue.sources import new_lake
    from loam.streaming import ingest
    tables = Tables(spark, folder)
    target, state = new_lake(tables, "bench"), scratch(spark, "bench-state")
    began = time.perf_counter()
    ingest.ingest(tables.streamed("messages"), target, state, None, drop_replays=drop_replays).awaitTermination()
    took = time.perf_counter() - began
    stored = spark.table(target.readings).count() + spark.table(target.dead_letters).count()
    return took, stored


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("loam-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    discard(known["flagship_hourly_readings"](spark, folder))
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        discard(known[name](spark, folder))
        seconds[name] = round(time.perf_counter() - began, 3)
    took, records = ingest_rate(spark, folder, False)
    seconds["ingest_stream"] = round(took, 3)
    checked, _ = ingest_rate(spark, folder, True)
    seconds["ingest_stream_replay_check"] = round(checked, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "ingest_records": records,
        "ingest_records_per_sec": round(records / took, 1),
        "ingest_records_per_sec_replay_check": round(records / checked, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
