"""Records of one entity as DataFrames: identity, deduplication, sealing.

A frame of records has evidence_id, host, time, time_source and the fields. The
id is an expression over the natural key, so plans that never use it never
compute it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.catalog import ENTITIES, LABELS, ORDER
from evq.functions.scalars import json_scalar

VERSION = "0.1.0"


def evidence_id(entity: str) -> Column:
    """``ev_`` and 32 hex digits of the SHA-256 of the natural key as canonical JSON."""
    e = ENTITIES[entity]
    key = F.concat_ws(",", *(json_scalar(F.col(f), e.schema[f]) for f in e.natural_key))
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat(F.lit(f'{{"entity":"{entity}","key":['), key, F.lit("]}")).cast("binary"), 256), 1, 32))


def first_of_key(df: DataFrame, entity: str, keys: Iterable[str] = ()) -> DataFrame:
    """One record for each natural key: the first by source and row where the table has these, else the least by all columns.

    ``keys`` are those of a correlation to come. If they are part of the natural
    key, records are dealt by them right away, and the correlation needs no
    second exchange; records that lack one can't match and go before the exchange.
    """
    e, keys = ENTITIES[entity], list(keys)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    if keys and set(keys) <= set(e.natural_key):
        df = df.repartition(*keys)
    order = [c for c in ORDER if c in df.columns]
    rest = [c for c in df.columns if c not in order]
    window = Window.partitionBy(*e.natural_key).orderBy(*order, *rest)
    return df.withColumn("__nth", F.row_number().over(window)).where(F.col("__nth") == 1).drop("__nth")


def labelled(df: DataFrame, entity: str, name: str) -> DataFrame:
    """Adds evidence_id and defaults for the envelope columns that the table lacks."""
    default = {
        "time_source": F.lit("event"), "observed_at": F.col("time"), "collector": F.lit(f"Offline{entity}Collector"),
        "collector_version": F.lit(VERSION), "source": F.lit(f"offline:{name}"),
    }
    have = {c: (F.coalesce(F.col(c), default[c]) if c in df.columns else default[c]).alias(c) for c in LABELS}
    return df.select(evidence_id(entity).alias("evidence_id"), *(c for c in df.columns if c not in LABELS), *have.values())


def fields_json(names: Iterable[str], schema: dict[str, str], column=F.col) -> Column:
    """The fields as one canonical JSON object."""
    parts = [F.concat(F.lit(f'"{f}":'), json_scalar(column(f), schema[f])) for f in sorted(names)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")


def _record_json(entity: str, names: list[str], execution_id: str, contract_hash: str) -> tuple[Column, Column]:
    """Canonical JSON of a record before its hash, cut where ``sha256`` belongs."""
    text, schema = (lambda c: json_scalar(F.col(c), "str")), ENTITIES[entity].schema
    head = [
        ("collector", text("collector")), ("collector_version", text("collector_version")), ("contract_hash", json_scalar(F.lit(contract_hash), "str")),
        ("entity", json_scalar(F.lit(entity), "str")), ("evidence_id", text("evidence_id")), ("execution_id", json_scalar(F.lit(execution_id), "str")),
        ("fields", fields_json(names, schema)), ("host", text("host")), ("observed_at", json_scalar(F.col("observed_at"), "time")),
    ]
    tail = [("source", text("source")), ("time", json_scalar(F.col("time"), "time")), ("time_source", text("time_source"))]
    show = lambda pairs: F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in pairs))
    return show(head), show(tail)


def sealed(df: DataFrame, entity: str, names: list[str], execution_id: str = "", contract_hash: str = "") -> DataFrame:
    """evidence_id, sha256 and json: each record as canonical JSON with the hash of all its other members."""
    head, tail = _record_json(entity, names, execution_id, contract_hash)
    rows = df.select("evidence_id", "time", head.alias("head"), tail.alias("tail"))
    digest = F.sha2(F.concat(F.lit("{"), "head", F.lit(","), "tail", F.lit("}")).cast("binary"), 256)
    rows = rows.withColumn("sha256", digest)
    whole = F.concat(F.lit("{"), "head", F.lit(',"sha256":"'), "sha256", F.lit('",'), "tail", F.lit("}"))
    return rows.select("evidence_id", "time", "sha256", whole.alias("json"))
