"""Tables written between the steps of an operator.

They live below ``spark.checkpoint.dir``, the folder that driver and executors
share, so a lost executor loses none of them and no step is computed twice.
Only where that setting is missing and Spark runs in one process is a folder
below the machine's temporary directory used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Spark's switch that a finished query's shuffle files go.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_root: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder for written tables."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="evq-"))
    return "file://" + _local_root[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


class Scratch:
    """A folder of tables that one run of an operator writes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{root(spark)}/evq/{name}-{uuid.uuid4().hex}"
        _written.append((spark, self.path))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the stored table. Spark removes the shuffle files of what led to it, which are of no more use."""
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(f"{self.path}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        _delete(self.spark, f"{self.path}/{name}")


#: Rows up to which a stored table may be sent to every executor. For tables that
#: follow from a benchmark or the like; what grows with the corpus is joined by a
#: shuffle, or as Spark's own limit on broadcasts allows.
BROADCAST_ROWS = 200_000


def small_side(stored: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``stored`` (narrow rows) marked for broadcasting if it has at most ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(stored) if stored.limit(limit + 1).count() <= limit else stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
