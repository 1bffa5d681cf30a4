"""Runs with everything they leave behind, and runs over frozen records."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.catalog import ENTITIES, Catalog
from evq.engine import Compiled, Engine, Execution, compile_source, digest
from evq.governance import contract as ct
from evq.operators import findings as fd
from evq.operators.correlate import key_intersection
from evq.operators.records import sealed
from evq.sources.manifest import Dataset

_ENVELOPE = "evidence_id string, host string, time string, time_source string, observed_at string, collector string, collector_version string, source string"


class Run:
    """A signed execution over a catalog; frames stay lazy until they are written or read."""

    def __init__(self, spark: SparkSession, program: str | Compiled, catalog: Catalog, secret: bytes, host: str = "OFFLINE-01", mode: str = "optimized", at: str | None = None):
        self.spark, self.catalog = spark, catalog
        self.compiled = compile_source(program) if isinstance(program, str) else program
        self.contract = ct.issue(self.compiled, {host: "offline"}, secret, mode=mode, at=at or catalog.reference_time)
        self.body = self.contract["claims"]
        self.execution: Execution = Engine(catalog).execute(self.body["plan"], self.body["window"])

    def reduced(self, scan: dict) -> DataFrame:
        """The scan's records that can be part of its correlation: those whose keys all of its inputs have."""
        frames, feeds = self.execution.streams, scan["feeds"]
        if feeds is None:
            return frames[scan["id"]].df
        inputs = next(x["inputs"] for x in self.body["plan"]["steps"] if x["id"] == feeds["step"])
        return key_intersection([frames[i].df for i in inputs], feeds["keys"])[inputs.index(scan["id"])]

    def evidence(self, stream: dict) -> DataFrame:
        """The stream's sealed records: evidence_id, time, sha256, json."""
        frame = self.execution.streams[stream["id"]]
        names = [f for f in frame.schemas[""] if f not in ("host", "time")]
        return sealed(self.reduced(stream), stream["entity"], names, self.body["run"], digest(self.body))

    def write(self, folder: str) -> dict:
        """contract.json, evidence/<stream>.jsonl, findings.json, provenance/<finding>.json and result.json below a local folder.

        Records and findings pass through the driver one by one, in order, as
        one file each is asked for; ``write_tables`` writes in parallel.
        """
        top = Path(folder)
        (top / "evidence").mkdir(parents=True, exist_ok=True)
        (top / "provenance").mkdir(exist_ok=True)
        _dump(top / "contract.json", self.contract)
        plan, counts, kept = self.body["plan"], {}, []
        for s in plan["scans"]:
            rows = self.evidence(s).persist()
            with (top / "evidence" / f"{s['id']}.jsonl").open("w", encoding="utf-8") as out:
                counts[s["id"]] = sum(1 for r in rows.orderBy("time", "evidence_id").toLocalIterator() if out.write(r["json"] + "\n"))
            kept.append(rows)
        n, records = 0, reduce(DataFrame.unionByName, kept)
        with (top / "findings.json").open("w", encoding="utf-8") as out:
            out.write("[")
            for x in plan["steps"]:
                if x["op"] == "emit":
                    found = self.execution.findings(x["binding"]).persist()
                    for r in found.orderBy("first_seen", "digest").toLocalIterator():
                        out.write(("," if n else "") + "\n" + json.dumps(_document(r), ensure_ascii=False))
                        n += 1
                    for r in fd.provenance(found, records, x["components"]).toLocalIterator():
                        _dump(top / "provenance" / f"{r['finding_id']}.json", self._provenance(r))
                    found.unpersist()
            out.write("\n]\n")
        result = {"digest": self.execution.digest(), "findings": n, "records": counts, "mode": plan["mode"]}
        result["preserved"] = {}
        for x in plan["steps"]:
            if x["op"] == "preserve":
                ids = self.execution.preserved(x["binding"])
                result["preserved"][x["binding"]] = {"count": ids.count(), "digest": fd.list_digest(ids), "with_content": x["with_content"]}
        for rows in kept:
            rows.unpersist()
        _dump(top / "result.json", result)
        return result

    def write_tables(self, folder: str) -> None:
        """evidence (by entity and stream) and findings as Parquet, anywhere Spark can write."""
        for s in self.body["plan"]["scans"]:
            self.evidence(s).write.mode("overwrite").parquet(f"{folder}/evidence/entity={s['entity']}/stream={s['id']}")
        if any(x["op"] == "emit" for x in self.body["plan"]["steps"]):
            self.execution.findings().write.mode("overwrite").parquet(f"{folder}/findings")

    def _provenance(self, r) -> dict:
        raw = [json.loads(e["json"]) if e["json"] else {"evidence_id": e["evidence_id"], "missing": True} for e in r["evidence"]]
        for e in raw:
            if "collector" in e:
                e["collector"] = {"name": e["collector"], "version": e["collector_version"]}
        keep = ("id", "run", "question", "sums", "from", "until", "privileges")
        return {
            "finding": json.loads(r["document"]) | {"finding_id": r["finding_id"]}, "derived": [{"links": [x.asDict() for x in chain]} for chain in r["links"]], "evidence": raw,
            "hosts": sorted({e["host"] for e in raw if "host" in e}), "contract": {k: self.body[k] for k in keep} | {"proof": self.contract["proof"]},
        }


def _document(r) -> dict:
    return json.loads(r["document"]) | {"digest": r["digest"], "finding_id": r["finding_id"], "node": r["node"]}


def _dump(path: Path, value) -> None:
    path.write_text(json.dumps(value, indent=1, ensure_ascii=False) + "\n", encoding="utf-8")


def run_offline(spark: SparkSession, source: str, dataset: str, secret: bytes, out: str | None = None, host: str = "OFFLINE-01", mode: str = "optimized", at: str | None = None) -> Run:
    run = Run(spark, source, Dataset(spark, dataset).catalog(), secret, host, mode, at)
    if out:
        run.write(out)
    return run


def frozen(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """The records of an evidence file, typed; with json as it stands and whether its hash is right."""
    fields = ENTITIES[entity].fields
    kinds = {"int": "bigint", "bool": "boolean"}
    schema = f"{_ENVELOPE}, sha256 string, fields struct<{', '.join(f'`{f}`: {kinds.get(k, 'string')}' for f, k in fields.items())}>"
    rows = spark.read.text(path).where(F.col("value") != "").select(F.from_json("value", schema).alias("r"), F.col("value").alias("json"))
    # a record is canonical JSON, so its hash is that of its text without the member sha256
    claimed = F.regexp_extract("json", r',"sha256":"([0-9a-f]{64})"', 1)
    rest = F.replace(F.col("json"), F.concat(F.lit(',"sha256":"'), claimed, F.lit('"')), F.lit(""))
    intact = (claimed != "") & (F.sha2(rest.cast("binary"), 256) == claimed)
    time = F.replace(F.col("r.time"), F.lit("Z"), F.lit("")).try_cast("timestamp_ntz").alias("time")
    return rows.select("r.evidence_id", "r.host", time, "r.time_source", *(F.col(f"r.fields.`{f}`").alias(f) for f in fields), intact.alias("__intact"))


#: Damaged records that a replay names; it counts them all.
NAMED = 100


def replay(spark: SparkSession, folder: str, public: bytes | None = None) -> dict:
    """Whether a run folder is what it was and gives the same findings again.

    failed: checks that its contract fails as of its first second. damaged: how
    many of the records don't have their hash, and some of them by id. digest:
    as it was written, and of the plan over the records.
    """
    top = Path(folder)
    contract, written = (json.loads((top / f"{name}.json").read_text(encoding="utf-8")) for name in ("contract", "result"))
    claims = contract["claims"]
    tables = {s["id"]: frozen(spark, str(top / "evidence" / f"{s['id']}.jsonl"), s["entity"]) for s in claims["plan"]["scans"]}
    hashes = reduce(DataFrame.unionByName, (t.select("evidence_id", F.coalesce("__intact", F.lit(False)).alias("intact")) for t in tables.values()))
    seen, damaged = hashes.agg(F.count("*"), F.count_if(~F.col("intact"))).first()
    names = hashes.where(~F.col("intact")).orderBy("evidence_id").limit(NAMED) if damaged else None
    again = Engine(Catalog()).execute(claims["plan"], claims["window"], {k: t.drop("__intact") for k, t in tables.items()}).digest()
    failed = ct.failures(contract, public or ct.own_key(contract), at=claims["from"])
    return {
        "match": not failed and not damaged and again == written["digest"], "failed": failed, "digest": {"written": written["digest"], "again": again},
        "records": seen, "damaged": damaged, "damaged_ids": [r["evidence_id"] for r in names.collect()] if damaged else [],
    }


def secret_from_text(text: str) -> bytes:
    """A secret key as hex, as ``keygen`` writes it."""
    key = bytes.fromhex(text.strip())
    if len(key) != 32:
        raise ValueError("a key has 64 hex digits")
    return key

