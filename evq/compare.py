"""What the planner saves: the two modes of one program side by side."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evq.catalog import Catalog
from evq.governance import ed25519
from evq.plans.planner import MODES
from evq.replay import Run


def compare(spark: SparkSession, program: str, catalog: Catalog, at: str | None = None) -> dict:
    """For each mode records and bytes that leave the scans (as sealed JSON lines), seconds and digest; and the savings."""
    out: dict = {}
    secret = ed25519.new_secret()
    for mode in MODES:
        start = time.time()
        run = Run(spark, program, catalog, secret, mode=mode, at=at)
        sizes = [run.evidence(s).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("json") + 1), F.lit(0))).first() for s in run.body["plan"]["scans"]]
        out[mode] = {"records": sum(x[0] for x in sizes), "bytes": sum(x[1] for x in sizes), "digest": run.execution.digest(), "seconds": round(time.time() - start, 3)}
    small, large = out["optimized"], out["naive"]
    saved = lambda k: round(100 * (1 - small[k] / large[k]), 2) if large[k] else 0.0
    return out | {
        "same_digest": small["digest"] == large["digest"], "records_saved_percent": saved("records"), "bytes_saved_percent": saved("bytes"),
        "speed_up": round(large["seconds"] / max(small["seconds"], 1e-3), 2), "notes": Run(spark, program, catalog, secret, at=at).body["plan"]["notes"],
    }
