"""Synthetic telemetry with planted incidents, made on the executors from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.catalog import Catalog

END = "2026-05-04T07:00:00.000000Z"


def _pick(column, values: list[str]):
    return F.element_at(F.array(*map(F.lit, values)), (F.abs(column) % len(values) + 1).cast("int"))


def catalog(spark: SparkSession, hosts: int = 200, processes: int = 50_000, incidents: int = 25, seed: int = 7) -> Catalog:
    """Noise of processes, files and connections over seven days, and ``incidents`` chains of an archiver, its archive and an upload.

    Incident i stands on host node-(i mod hosts) with pid 100000 + i, within the last day, on pids that no noise has.
    """
    end = F.lit(END.rstrip("Z")).cast("timestamp_ntz")
    r = lambda k: F.xxhash64("id", F.lit(seed), F.lit(k))
    host = lambda k: F.concat(F.lit("node-"), F.abs(r(k)) % hosts)
    ago = lambda k, span: end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.abs(r(k)) % span).cast("decimal(18,6)"))
    after = lambda t, minutes: t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0).cast("decimal(18,6)"))
    noise, planted = spark.range(processes), spark.range(incidents)
    own = planted.select(F.concat(F.lit("node-"), F.col("id") % hosts).alias("host"), ago(1, 80_000).alias("time"), (F.lit(100_000) + F.col("id")).alias("pid"), "id")
    tree = {"ppid": F.lit(1).cast("bigint"), "cmdline": F.lit(None).cast("string"), "user": F.lit("u")}
    process = noise.select(host(2).alias("host"), ago(3, 7 * 86_400).alias("time"), (F.abs(r(4)) % 90_000).alias("pid"), _pick(r(5), ["firefox", "sshd", "backup.exe", "7z.exe"]).alias("name"))
    process = process.unionByName(own.select("host", "time", "pid", _pick(F.col("id"), ["7za.exe", "rar.exe"]).alias("name"))).withColumns(tree).withColumn("path", F.concat(F.lit("/bin/"), "name"))
    file = noise.select(host(6).alias("host"), ago(7, 7 * 86_400).alias("time"), (F.abs(r(8)) % 90_000).alias("pid"), _pick(r(9), ["create", "delete"]).alias("action"), F.concat(F.lit("/tmp/"), "id").alias("path"))
    file = file.unionByName(own.select("host", after(F.col("time"), 11).alias("time"), "pid", F.lit("create").alias("action"), F.concat(F.lit("/tmp/packed"), "id").alias("path")))
    file = file.withColumns({"name": F.col("path"), "extension": F.when(F.col("pid") >= 100_000, "7z").otherwise(_pick(F.xxhash64("path"), ["7z", "log", "txt"])), "size": F.lit(10).cast("bigint"), "attribution": F.lit("event"), "sha256": F.lit(None).cast("string")})
    net = noise.select(host(10).alias("host"), ago(11, 7 * 86_400).alias("time"), (F.abs(r(12)) % 90_000).alias("pid"), _pick(r(13), ["outbound", "inbound"]).alias("direction"), _pick(r(14), ["10.9.8.7", "10.0.0.2", "198.51.100.7"]).alias("remote_ip"))
    net = net.unionByName(own.select("host", after(F.col("time"), 19).alias("time"), "pid", F.lit("outbound").alias("direction"), F.lit("198.51.100.7").alias("remote_ip")))
    net = net.withColumns({"protocol": F.lit("tcp"), "state": F.lit("ESTABLISHED"), "local_ip": F.lit("10.0.0.1"), "local_port": F.lit(5).cast("bigint"), "remote_port": F.lit(443).cast("bigint")})
    users = spark.range(hosts).select(F.concat(F.lit("node-"), "id").alias("host"), end.alias("time"), F.lit("admin").alias("name"), F.lit("0").alias("uid"))
    events = noise.select(host(15).alias("host"), ago(16, 7 * 86_400).alias("time"), F.lit("security").alias("channel"), F.lit("synthetic").alias("provider"), F.col("id").alias("record_id"), (F.abs(r(17)) % 90_000).alias("pid"))
    return Catalog({"Process": process, "File": file, "NetworkConnection": net, "User": users, "Event": events}, name="synthetic", reference_time=END)


def save(found: Catalog, folder: str) -> None:
    """Each entity as Parquet below a folder."""
    for entity, df in found.tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{entity}")


def load(spark: SparkSession, folder: str, name: str = "synthetic") -> Catalog:
    tables: dict[str, DataFrame] = {e: spark.read.parquet(f"{folder}/{e}") for e in ("Process", "File", "NetworkConnection", "User", "Event")}
    return Catalog(tables, name=name, reference_time=END)
