"""Correlations over streams: the joins and sequences of the language as stream-stream joins.

A bound on time is also a bound on state: with watermarks on both sides Spark
drops a record as soon as no partner can come any more. A sequence is a chain of
such joins. Results equal those of a batch over the same records, but for
records later than the watermark, and without the cap on chains, which needs all
chains of a first record at once; ``capped`` applies it to what is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evq.operators.correlate import CAP
from evq.operators.records import evidence_id


def records(df: DataFrame, entity: str, delay: str = "10 minutes") -> DataFrame:
    """Records of a stream with their ids and a watermark, each id once. ``df`` has host, time (timestamp) and fields."""
    rows = df.withColumn("event_time", F.col("time").cast("timestamp")).withColumn("time", F.col("time").cast("timestamp_ntz"))
    rows = rows.withColumn("evidence_id", evidence_id(entity)).withWatermark("event_time", delay)
    return rows.dropDuplicatesWithinWatermark(["evidence_id"])


def _side(df: DataFrame, alias: str, keys: list[str], i: int) -> DataFrame:
    df = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df)
    plain = [c for c in df.columns if c != "event_time"]
    return df.select(F.struct(*plain).alias(alias), *(F.col(k).alias(f"__k{i}_{m}") for m, k in enumerate(keys)), F.col("event_time").alias(f"__t{i}"))


def band_join(left: DataFrame, right: DataFrame, aliases: list[str], keys: list[str], within: int) -> DataFrame:
    """Pairs with equal keys at most ``within`` seconds apart."""
    a, b = _side(left, aliases[0], keys, 0), _side(right, aliases[1], keys, 1)
    same = reduce(lambda x, y: x & y, (F.col(f"__k0_{m}") == F.col(f"__k1_{m}") for m in range(len(keys))))
    bound = F.expr(f"__t1 >= __t0 - INTERVAL {within} SECONDS AND __t1 <= __t0 + INTERVAL {within} SECONDS")
    return a.join(b, same & bound).select(*aliases)


def sequence(steps: list[DataFrame], aliases: list[str], keys: list[str], within: int) -> DataFrame:
    """Chains in order of time, the last at most ``within`` seconds after the first."""
    out = _side(steps[0], aliases[0], keys, 0)
    for i in range(1, len(steps)):
        same = reduce(lambda x, y: x & y, (F.col(f"__k0_{m}") == F.col(f"__k{i}_{m}") for m in range(len(keys))))
        bound = F.expr(f"__t{i} >= __t{i - 1} AND __t{i} <= __t0 + INTERVAL {within} SECONDS AND __t{i} >= __t0")
        out = out.join(_side(steps[i], aliases[i], keys, i), same & bound)
    return out.select(*aliases)


def capped(chains: DataFrame, cap: int = CAP) -> DataFrame:
    """The first ``cap`` chains of each first record, of chains that a stream has written."""
    first, *rest = chains.columns
    order = [F.col(f"{a}.{c}") for a in rest for c in ("time", "evidence_id")]
    window = Window.partitionBy(F.col(f"{first}.evidence_id")).orderBy(*order)
    return chains.withColumn("__nth", F.row_number().over(window)).where(F.col("__nth") <= cap).drop("__nth")


def windowed_counts(df: DataFrame, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Records by host and window of time; ``df`` is from ``records``."""
    return df.groupBy(F.window("event_time", length, slide or length), "host").agg(F.count("*").alias("n"))
