"""Outputs: findings with digests, preserved ids, provenance.

A finding is a document whose digest is the SHA-256 of its canonical JSON. The
JSON is put together from columns, so a run with many findings stays on the
executors.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.functions.scalars import json_scalar, shown_time
from evq.operators.records import fields_json

FORMAT = "evq.finding/0.1"


def _view(entity: str, names: list[str], schema: dict[str, str], column) -> Column:
    """A record as findings show it, as canonical JSON."""
    return F.concat(
        F.lit(f'{{"entity":"{entity}","fields":'), fields_json(names, schema, column), F.lit(',"host":'), json_scalar(column("host"), "str"),
        F.lit(',"time":'), json_scalar(column("time"), "time"), F.lit(',"time_source":'), json_scalar(column("time_source"), "str"), F.lit("}"),
    )


def findings(df: DataFrame, node: dict, aliases: list[str], schemas: dict[str, dict[str, str]], entities: dict[str, str]) -> DataFrame:
    """One finding for each first record: its chains, the records in them, first and last time, digest and id.

    ``df`` has a struct column for each alias. A record that stands in a chain
    under two aliases is shown as under the later one.
    """

    def part(alias: str):
        return lambda c: F.col(f"{alias}.{c}")

    payload = {a: [f for f in schemas[a] if f not in ("host", "time")] for a in aliases}
    records = F.array(*(
        F.struct(part(a)("evidence_id").alias("id"), F.lit(i).alias("i"), _view(entities[a], payload[a], schemas[a], part(a)).alias("view"), part(a)("time").alias("time"))
        for i, a in enumerate(aliases)
    ))
    rows = df.select(part(aliases[0])("evidence_id").alias("anchor"), part(aliases[0])("host").alias("host"), F.array(*(part(a)("evidence_id") for a in aliases)).alias("chain"), records.alias("records"))
    rows = rows.groupBy("anchor").agg(F.first("host").alias("host"), F.sort_array(F.collect_list("chain")).alias("chains"), F.array_distinct(F.flatten(F.collect_list("records"))).alias("records"))
    # sorted by (id, alias), the last of each id is its view
    order = F.sort_array("records")
    shown = F.filter(order, lambda r, i: (i == F.size("records") - 1) | (F.get(order, i + 1)["id"] != r["id"]))
    rows = rows.select("anchor", "host", "chains", shown.alias("records"))
    rows = rows.select("*", F.array_min(F.transform("records", lambda r: r["time"])).alias("first_seen"), F.array_max(F.transform("records", lambda r: r["time"])).alias("last_seen"))
    quoted = lambda x: F.lit(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    evidence = F.array_join(F.transform("records", lambda r: F.concat(F.lit('"'), r["id"], F.lit('":'), r["view"])), ",")
    chains = F.array_join(F.transform("chains", lambda c: F.concat(F.lit('["'), F.array_join(c, '","'), F.lit('"]'))), ",")
    body = F.concat(
        F.lit('{"anchor":"'), "anchor", F.lit('","binding":'), quoted(node["binding"]), F.lit(',"chains":['), chains, F.lit('],"components":'), quoted(node["components"]),
        F.lit(',"evidence":{'), evidence, F.lit(f'}},"first_seen":"'), shown_time(F.col("first_seen")), F.lit(f'","format":"{FORMAT}","host":'), json_scalar(F.col("host"), "str"),
        F.lit(',"last_seen":"'), shown_time(F.col("last_seen")), F.lit('","severity":'), quoted(node["severity"]), F.lit(',"shape":'), quoted(node["shape"]), F.lit(',"title":'), quoted(node["title"]), F.lit("}"),
    )
    rows = rows.withColumn("document", body).withColumn("digest", F.sha2(F.col("document").cast("binary"), 256))
    return rows.select(
        F.concat(F.lit("fd_"), F.substring("digest", 1, 24)).alias("finding_id"), "digest", F.lit(node["id"]).alias("node"), F.lit(node["binding"]).alias("binding"),
        F.lit(node["title"]).alias("title"), F.lit(node["severity"]).alias("severity"), F.lit(node["shape"]).alias("shape"), "anchor", "host", "chains",
        F.transform("records", lambda r: r["id"]).alias("evidence_ids"), "first_seen", "last_seen", "document",
    )


def preserved(df: DataFrame, aliases: list[str]) -> DataFrame:
    """evidence_id of every record in the chains, once."""
    return df.select(F.explode(F.array(*(F.col(f"{a}.evidence_id") for a in aliases))).alias("evidence_id")).distinct()


def list_digest(values: DataFrame) -> str:
    """SHA-256 of the sorted list in the only column as canonical JSON. The values pass through the driver one by one, none is kept."""
    column, out, first = values.columns[0], hashlib.sha256(), True
    out.update(b"[")
    for row in values.orderBy(column).toLocalIterator():
        out.update((b"" if first else b",") + json.dumps(row[0], ensure_ascii=False).encode())
        first = False
    out.update(b"]")
    return out.hexdigest()


def provenance(found: DataFrame, records: DataFrame, components: list[dict]) -> DataFrame:
    """finding_id, links (for each chain: alias, entity, evidence_id) and evidence (json of the records, null where one is missing), by finding.

    ``records`` has evidence_id, json of all sealed records.
    """
    kinds = F.array(*(F.struct(F.lit(c["alias"]).alias("alias"), F.lit(c["entity"]).alias("entity")) for c in components))
    links = F.transform("chains", lambda c: F.zip_with(kinds, c, lambda k, i: F.struct(k["alias"].alias("alias"), k["entity"].alias("entity"), i.alias("evidence_id"))))
    wanted = found.select("finding_id", F.explode("evidence_ids").alias("evidence_id"))
    raw = wanted.join(records.select("evidence_id", "json").dropDuplicates(["evidence_id"]), "evidence_id", "left")
    raw = raw.groupBy("finding_id").agg(F.sort_array(F.collect_list(F.struct("evidence_id", "json"))).alias("evidence"))
    return found.select("finding_id", "document", links.alias("links")).join(raw, "finding_id")
