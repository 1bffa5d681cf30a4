"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then twice on the clock; results go to a
sink that drops them. The naive twins of the first three show what the planner
saves: ``rows`` are the records that leave the scans of either plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.engine import Engine, compile_source
from evq.fixtures import catalog
from evq.queries import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WINDOW = 'window from "1995-01-01T00:00:00Z" to "1996-01-01T00:00:00Z"'
PARTS = """let p = observe Process | filter name in ["PowerShell.exe", "pwsh"] | select pid, name
let f = observe File | filter action == "create" | select pid, path
let n = observe NetworkConnection | filter not remote_ip in cidr("127.0.0.0/8") and direction == "outbound" | select pid, remote_ip
"""
PROGRAMS = {
    "sequence": PARTS + "let s = sequence p -> f -> n on host, pid within 30d\nemit finding s",
    "band_join": PARTS + "let s = join p, f on host, pid within 30d\nemit finding s",
    "filter_cidr": PARTS + "emit finding n",
}


def program(body: str) -> str:
    return f'investigation bench {{ targets ["H1"] {WINDOW}\n{body}\n}}'


def timed(make, runs: int = 3) -> float:
    """Seconds of the best run, planning included, but for the first, which warms up."""
    found = []
    for _ in range(runs):
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        found.append(time.time() - start)
    return round(min(found[1:]), 3)


def shipped(engine: Engine, body: str, mode: str) -> int:
    """Records that leave the scans."""
    compiled = compile_source(program(body))
    run = engine.run(compiled, mode="optimized")
    return sum((engine.scan(s, run.window) if mode == "optimized" else engine.catalog.table(s["entity"])).count() for s in run.plan["scans"])


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(catalog(spark, SF))
    seconds, rows = {}, {}
    for mode in ("optimized", "naive") * 2:  # the first queries of a session compile much code
        engine.run(program(PROGRAMS["sequence"]), mode=mode).findings().write.format("noop").mode("overwrite").save()
    for name, body in PROGRAMS.items():
        for mode in ("optimized", "naive"):

            def findings(mode=mode, body=body) -> DataFrame:
                return engine.run(program(body), mode=mode).findings().select("digest", F.size("chains"))

            seconds[f"{name}_{mode}"] = timed(findings)
            rows[f"{name}_{mode}"] = shipped(engine, body, mode)
    for name in ("observe_file", "filter_bool_tree", "join_inner", "sequence_3_wide", "sequence_events", "emit_derived", "preserve_ids"):
        seconds[name] = timed(lambda name=name: QUERIES[name].run(spark, SF))
    if "--all" in sys.argv or os.environ.get("BENCH_LLM", "1") == "1":
        try:
            from evq.llm.queries import QUERIES as MORE
        except ImportError:
            MORE = {}
        for name in MORE:
            seconds[name] = timed(lambda name=name: MORE[name](spark, SF), 2)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows": rows, "sf": SF}))


if __name__ == "__main__":
    main()
