"""Datasets of exported evidence: JSON lines, JSON arrays and CSV, described by ``dataset.json``.

    {"name": ..., "default_host": ..., "reference_time": ...,
     "sources": [{"entity": "Process", "path": "p.jsonl", "format": "jsonl", "time_format": "iso",
                  "time_source": "start", "fields": {"pid": "ProcessId", "local_ip": "local.ip"}}]}

JSON is read as variants, which keep 7, "7", true and 7.0 apart, as typed fields
take only some of them. A value that doesn't fit its field is null and counted;
a row without a valid time is left out and counted.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.catalog import ENTITIES, Catalog
from evq.functions import scalars
from evq.operators.records import VERSION

FORMATS = ("jsonl", "json", "csv")
_INT = r"\A-?[0-9]+\z"


def parsed_time(text: Column) -> Column:
    """A UTC timestamp of ISO text; null if it is none. No zone is UTC; digits beyond microseconds are cut off."""
    t = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    part = lambda i: F.regexp_extract(t, r"\A([0-9-]{10})[Tt ]([0-9:]{8})(?:\.([0-9]+))?(?:[Zz]|([+-])([0-9]{2}):?([0-9]{2}))?\z", i)
    base = F.concat(part(1), F.lit(" "), part(2), F.lit("."), F.rpad(F.substring(part(3), 1, 6), 6, "0")).try_cast("timestamp_ntz")
    hours, minutes = part(5).try_cast("int"), part(6).try_cast("int")
    shift = F.make_dt_interval(F.lit(0), F.when(part(4) == "-", -hours).otherwise(hours), F.when(part(4) == "-", -minutes).otherwise(minutes), F.lit(0).cast("decimal(18,6)"))
    moved = F.when(part(4) == "", base).when((hours < 24) & (minutes < 60), base - shift)
    in_range = moved.between(F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz"))
    return F.when(t.rlike(rf"\A{scalars.TIME_PATTERN}\z") & in_range, moved)


def _epoch(number: Column, kind: str) -> Column:
    seconds = number / F.lit(1000 if kind == "epoch_ms" else 1)
    micros = number * F.lit(1000 if kind == "epoch_ms" else 1_000_000)
    fits = seconds.between(-62135596800, 253402300799)
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(fits, base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000)).cast("decimal(18,6)")))


class _Raw:
    """A value as it came: its kind (STRING, BIGINT, BOOLEAN, ..., null if absent) and its text."""

    def __init__(self, kind: Column, text: Column):
        self.kind, self.text = kind, text

    @property
    def string(self) -> Column:
        return F.when(self.kind == "STRING", self.text)

    @property
    def absent(self) -> Column:
        return self.kind.isNull() | (self.kind == "VOID") | ((self.kind == "STRING") & (self.text == ""))

    @property
    def integer(self) -> Column:
        trimmed = F.regexp_replace(self.text, r"\A\s+|\s+\z", "")
        return F.when((self.kind == "BIGINT") | ((self.kind == "STRING") & trimmed.rlike(_INT)), trimmed.try_cast("bigint"))

    def typed(self, kind: str, time_format: str) -> Column:
        """The value for a field of a type; null if it is absent or doesn't fit."""
        if kind == "int":
            found = self.integer
        elif kind == "str":
            found = F.when(self.kind.isin("STRING", "BIGINT", "BOOLEAN"), self.text)
        elif kind == "time":
            found = parsed_time(self.string) if time_format == "iso" else _epoch(self.integer, time_format)
        elif kind == "ip":
            found = scalars.normal_ip(self.string)
        else:
            found = F.when(F.lower(self.text).isin("true", "false") & self.kind.isin("BOOLEAN", "STRING"), F.lower(self.text) == "true")
        return F.when(~self.absent, found)


def _in_variant(v: str, path: str) -> _Raw:
    """A key of that very name, dots included, or else a path through objects."""
    found = F.try_variant_get(F.col(v), f'$["{path}"]', "variant")
    if "." in path:
        found = F.coalesce(found, F.try_variant_get(F.col(v), "$." + path, "variant"))
    return _Raw(F.schema_of_variant(found), F.try_variant_get(found, "$", "string"))


def _in_columns(columns: list[str]) -> Callable[[str], _Raw]:
    return lambda path: _Raw(F.lit("STRING"), F.col(f"`{path}`")) if path in columns else _Raw(F.lit(None).cast("string"), F.lit(None).cast("string"))


def _rows(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, Callable[[str], _Raw]]:
    """The rows with their place, and how to look a value up."""
    if kind == "csv":
        df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
        return df.withColumn("_row", F.monotonically_increasing_id()), _in_columns(df.columns)
    if kind == "jsonl":
        # filters and parsing can end up in one expression, so blank lines must not break the parser either
        line = F.when(F.trim("value") != "", F.col("value"))
        df = spark.read.text(path).where(line.isNotNull()).select(F.parse_json(line).alias("__v"), F.monotonically_increasing_id().alias("_row"))
        return df, lambda p: _in_variant("__v", p)
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.variant_get("v", "$", "array<variant>")).otherwise(F.raise_error(F.lit(f"{path}: a json source must be an array of objects")))
    return whole.select(F.posexplode(items).alias("_row", "__v")).withColumn("_row", F.col("_row").cast("bigint")), lambda p: _in_variant("__v", p)


class Dataset:
    """A folder with a manifest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        self.manifest = json.loads(spark.read.text(f"{self.folder}/dataset.json", wholetext=True).first()[0])
        self.name = self.manifest["name"]
        unknown = [s.get("format", "jsonl") for s in self.manifest["sources"] if s.get("format", "jsonl") not in FORMATS]
        if unknown:
            raise ValueError(f"unknown source format '{unknown[0]}'; there are {', '.join(FORMATS)}")

    def normalised(self, entity: str) -> DataFrame:
        """The entity's records from all its sources in their order, with null times, ``_errors`` and the place in the source."""
        e, made = ENTITIES[entity], []
        for i, source in enumerate(self.manifest["sources"]):
            if source["entity"] != entity:
                continue
            names, time_format = source.get("fields", {}), source.get("time_format", "iso")
            df, look = _rows(self.spark, f"{self.folder}/{source['path']}", source.get("format", "jsonl"))
            raw = {f: look(names.get(f, f)) for f in (*e.schema, "observed_at")}
            host = F.when(raw["host"].string != "", raw["host"].string)
            columns = [F.coalesce(host, F.lit(self.manifest.get("default_host", "OFFLINE"))).alias("host"), raw["time"].typed("time", time_format).alias("time")]
            columns += [raw[f].typed(kind, time_format).alias(f) for f, kind in e.fields.items()]
            columns += [raw["observed_at"].typed("time", time_format).alias("__observed"), *((~raw[f].absent).alias(f"__has_{f}") for f in e.fields)]
            df = df.select(*columns, F.lit(i).alias("_source"), "_row")
            errors = reduce(lambda a, b: a + b, (F.when(F.col(f"__has_{f}") & F.col(f).isNull(), 1).otherwise(0) for f in e.fields))
            made.append(df.select(
                "host", "time", *e.fields, "_source", "_row", F.lit(source.get("time_source", "event")).alias("time_source"),
                F.coalesce("__observed", "time").alias("observed_at"), F.lit(f"Offline{entity}Collector").alias("collector"), F.lit(VERSION).alias("collector_version"),
                F.lit(f"offline:{self.name}/{source['path']}").alias("source"), F.when(F.col("time").isNull(), 1).otherwise(errors).alias("_errors"),
            ))
        if not made:
            raise LookupError(f"the dataset has no source for {entity}")
        return reduce(DataFrame.unionByName, made)

    def counters(self, entity: str) -> DataFrame:
        """scanned, normalize_errors."""
        return self.normalised(entity).agg(F.count("*").alias("scanned"), F.coalesce(F.sum("_errors"), F.lit(0)).alias("normalize_errors"))

    def catalog(self) -> Catalog:
        out = Catalog(name=self.name, reference_time=self.manifest.get("reference_time"))
        for entity in dict.fromkeys(s["entity"] for s in self.manifest["sources"]):
            out.register(entity, self.normalised(entity))
        return out


def syslog(spark: SparkSession, path: str, year: int, host: str = "OFFLINE") -> DataFrame:
    """Event records of syslog files: lines that begin with an ISO time, or with month, day and time of ``year``."""
    line = F.col("value")
    iso = r"\A(\S+T\S+) (\S+) ([^:\[ ]+)(?:\[([0-9]+)\])?: (.*)\z"
    old = r"\A([A-Z][a-z]{2} +[0-9]{1,2} [0-9:]{8}) (\S+) ([^:\[ ]+)(?:\[([0-9]+)\])?: (.*)\z"
    pick = lambda i: F.when(line.rlike(iso), F.regexp_extract(line, iso, i)).otherwise(F.regexp_extract(line, old, i))
    legacy = F.to_timestamp_ntz(F.concat(F.lit(f"{year} "), F.regexp_replace(F.regexp_extract(line, old, 1), " +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    rows = spark.read.text(path).where(line.rlike(iso) | line.rlike(old))
    return rows.select(
        F.coalesce(F.nullif(pick(2), F.lit("")), F.lit(host)).alias("host"), F.when(line.rlike(iso), parsed_time(F.regexp_extract(line, iso, 1))).otherwise(legacy).alias("time"),
        F.lit("syslog").alias("channel"), pick(3).alias("provider"), F.lit(None).cast("bigint").alias("event_id"), F.monotonically_increasing_id().alias("record_id"),
        F.lit(None).cast("string").alias("level"), pick(4).try_cast("bigint").alias("pid"), pick(5).alias("message"),
    )


def direction(local_port: str = "local_port", state: str = "state", listening: str = "listening") -> Column:
    """Direction of a socket: bound or listening ones are so called, a connection to a port on which its host listens is inbound."""
    s = F.upper(F.col(state))
    return F.when(s == "LISTEN", "listen").when(F.col("remote_port").isNull() | (F.col("remote_port") == 0), "bound").when(F.col(listening), "inbound").otherwise("outbound")


def file_hashes(spark: SparkSession, files: DataFrame, root: str, max_bytes: int = 64 << 20) -> DataFrame:
    """``files`` (File records, filtered already) with the SHA-256 of those that stand below ``root`` and have at most ``max_bytes``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    found = found.select(F.regexp_replace("path", "^file:/+", "/").alias("__path"), F.sha2("content", 256).alias("__hash"))
    rows = files.join(found, F.col("path") == F.col("__path"), "left")
    return rows.withColumn("sha256", F.coalesce("__hash", "sha256")).drop("__path", "__hash")
