"""Headline queries, timed to completion: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "e1_log_line_to_verdict", "p01_parse_combined", "p11_parse_json_log", "p13_parse_system_log",
    "f01_suspicious_request", "f03_first_attack_match", "f04_frequency_verdict", "f14_build_security_event",
    "j01_allow_list_join", "j03_geo_range_join", "j05_ban_history_asof", "w04_rolling_distinct_uri",
    "w08_running_behaviour", "w09_ban_decision", "w11_ml_hour_window", "ag06_risk_score", "ag09_ban_statistics",
    "ag11_metric_summary", "ag12_endpoint_summary", "ag14_trace_statistics", "ag16_security_statistics",
    "ag25_tenant_statistics", "tk01_top_ips", "st01_alert_suppression", "st02_ban_intervals",
    "st03_dynamic_threshold", "st05_sliding_rate_limiter", "m01_basic_features", "m02_attack_features",
]


def main() -> None:
    from gatewatch.plans import QUERIES
    from gatewatch.session import build_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    names = [q for q in HEADLINE if not only or any(o in q for o in only)]
    # start the JVM compiler and the Python workers before the clock runs
    for q in ("st03_dynamic_threshold", "e1_log_line_to_verdict"):
        QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, n_rows = {}, spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for q in names:
        t0 = time.perf_counter()
        QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[q] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": Path(sf_dir).name.removeprefix("sf"), "rows": n_rows,
                      "rows_per_sec": {q: round(n_rows / t) for q, t in times.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
