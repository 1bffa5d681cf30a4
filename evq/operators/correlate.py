"""Joins and sequences of records.

Inputs are frames of records; a result has one struct column for each alias, in
order. Joins are equi joins on the keys with a bound on time, so Spark picks
broadcast or sort-merge and splits skewed keys; records without a key never
reach an exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chains that a sequence keeps for each first record.
CAP = 100


def _step(df: DataFrame, alias: str, keys: list[str], i: int) -> DataFrame:
    """The records as a struct, with keys k<i>_.., time t<i> and id i<i> beside it."""
    df = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df)
    return df.select(F.struct("*").alias(alias), *(F.col(k).alias(f"__k{i}_{n}") for n, k in enumerate(keys)), F.col("time").alias(f"__t{i}"), F.col("evidence_id").alias(f"__i{i}"))


def _same(keys: list[str], i: int, j: int) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"__k{i}_{n}") == F.col(f"__k{j}_{n}") for n in range(len(keys))))


def _later(c: str, seconds: int) -> Column:
    return F.col(c) + F.expr(f"INTERVAL {seconds} SECONDS")


def band_join(frames: list[DataFrame], aliases: list[str], keys: list[str], within: int | None = None) -> DataFrame:
    """Pairs with equal keys, at most ``within`` seconds apart either way."""
    left, right = (_step(df, a, keys, i) for i, (df, a) in enumerate(zip(frames, aliases)))
    on = _same(keys, 0, 1)
    if within is not None:
        on = on & (F.col("__t1") <= _later("__t0", within)) & (F.col("__t0") <= _later("__t1", within))
    return left.join(right, on).select(*aliases)


def _with_done(frames: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """Each step's records with the earliest time at which the steps after them can be through; null if never.

    From the last step back: the least such time among the next step's records
    of the same keys that aren't earlier, a running minimum over both steps. The
    frame is by RANGE, so that records of equal time count.
    """
    out = [frames[-1].withColumn("__done", F.col("time"))]
    for df in reversed(frames[:-1]):
        after = out[0].select(*keys, "time", F.col("__done").alias("__next"), F.lit(None).alias("__row"))
        own = df.select(*keys, "time", F.lit(None).cast("timestamp_ntz").alias("__next"), F.struct("*").alias("__row"))
        both = own.unionByName(after.withColumn("__row", F.lit(None).cast(own.schema["__row"].dataType)))
        window = Window.partitionBy(*keys).orderBy("time").rangeBetween(Window.currentRow, Window.unboundedFollowing)
        done = both.withColumn("__done", F.min("__next").over(window)).where(F.col("__row").isNotNull() & F.col("__done").isNotNull())
        out.insert(0, done.select("__row.*", "__done"))
    return out


def sequence(frames: list[DataFrame], aliases: list[str], keys: list[str], within: int, cap: int = CAP) -> DataFrame:
    """Chains of one record of each frame with equal keys, times that never go back, and the last at most ``within`` seconds after the first.

    Of each first record the first ``cap`` chains by (time, id) of the second
    step, then the third, ... stay. With three steps or more a chain only grows
    by records from which the rest can be done in time, and is cut to ``cap``
    after each step: as every such beginning leads to a chain, the first chains
    come from the first beginnings, and no first record ever holds more than
    ``cap`` times the matches of one step.
    """
    n = len(frames)
    frames = [reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df) for df in frames]
    if n > 2:
        frames = _with_done(frames, keys)
    out = _step(frames[0].drop("__done"), aliases[0], keys, 0)
    for i in range(1, n):
        step = _step(frames[i].drop("__done"), aliases[i], keys, i) if n == 2 else _bounded(frames[i], aliases[i], keys, i)
        limit = F.col(f"__d{i}") if n > 2 else F.col(f"__t{i}")
        out = out.join(step, _same(keys, 0, i) & (F.col(f"__t{i}") >= F.col(f"__t{i - 1}")) & (limit <= _later("__t0", within)))
        order = [c for j in range(1, i + 1) for c in (f"__t{j}", f"__i{j}")]
        # the keys go first, so that the rows need no exchange after the join
        window = Window.partitionBy(*(f"__k0_{m}" for m in range(len(keys))), "__i0").orderBy(*order)
        out = out.withColumn("__nth", F.row_number().over(window)).where(F.col("__nth") <= cap).drop("__nth")
    return out.select(*aliases)


def _bounded(df: DataFrame, alias: str, keys: list[str], i: int) -> DataFrame:
    plain = [c for c in df.columns if c != "__done"]
    return df.select(F.struct(*plain).alias(alias), *(F.col(k).alias(f"__k{i}_{m}") for m, k in enumerate(keys)), F.col("time").alias(f"__t{i}"), F.col("evidence_id").alias(f"__i{i}"), F.col("__done").alias(f"__d{i}"))


def key_intersection(frames: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """Each frame without the records whose keys some other frame lacks."""
    sets = [reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df).select(*keys) for df in frames]
    common = reduce(lambda a, b: a.intersect(b), sets)
    return [df.join(common, keys, "left_semi") for df in frames]
