"""A store of sealed records and findings as Parquet, below one folder.

Records are partitioned by execution and entity, so that a read touches only
those; writing an execution again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evq.replay import Run

_RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("evidence_id", "sha256", "json", "stream", "host")] + [T.StructField("time", T.TimestampNTZType()), T.StructField("execution_id", T.StringType()), T.StructField("entity", T.StringType())])


def put(run: Run, folder: str) -> None:
    """Insert or replace the run's records and findings."""
    execution = run.body["run"]
    for i, s in enumerate(run.body["plan"]["scans"]):
        frame = run.execution.streams[s["id"]].df.select("evidence_id", "host")
        rows = run.evidence(s).join(frame, "evidence_id").withColumns({"stream": F.lit(s["id"]), "execution_id": F.lit(execution), "entity": F.lit(s["entity"])})
        earlier = any(x["entity"] == s["entity"] for x in run.body["plan"]["scans"][:i])
        writer = rows.select(*_RECORD.names).write.partitionBy("execution_id", "entity").option("partitionOverwriteMode", "dynamic")
        writer.mode("append" if earlier else "overwrite").parquet(f"{folder}/evidence")
    if any(x["op"] == "emit" for x in run.body["plan"]["steps"]):
        found = run.execution.findings().withColumn("execution_id", F.lit(execution))
        found.write.partitionBy("execution_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/findings")


def evidence(spark: SparkSession, folder: str, execution_id: str | None = None, entity: str | None = None, host: str | None = None, limit: int | None = 1000) -> DataFrame:
    """Records in order of time, the first ``limit`` of them."""
    rows = spark.read.schema(_RECORD).parquet(f"{folder}/evidence")
    for column, value in (("execution_id", execution_id), ("entity", entity), ("host", host)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rows = rows.orderBy("time", "evidence_id")
    return rows if limit is None else rows.limit(limit)


def findings(spark: SparkSession, folder: str, execution_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/findings")
    return (rows if execution_id is None else rows.where(F.col("execution_id") == execution_id)).orderBy("first_seen", "digest")
