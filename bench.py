"""Headline queries on one local session; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

HEADLINE = (
    "gen_windows",
    "iv_set_union",
    "iv_set_subtract",
    "iv_set_priority",
    "iv_set_coverage",
    "jn_overlap",
    "jn_candidates",
    "jn_dialogue_window",
    "jn_frame_snap",
    "mt_max_cardinality",
    "mt_max_weight_cardinality",
    "mt_soft_f1",
    "agg_threshold_sweep",
    "agg_event_metrics",
    "agg_runtime",
    "agg_review_queue_delta",
    "smp_focus_stratified",
    "se_vector",
    "ed_split",
    "st_metric_merge",
    "st_stagnation",
)


def main() -> None:
    from spanweave.plans import registry
    from spanweave.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    wanted = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        # the noop sink runs the whole plan without moving rows to the driver
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()
