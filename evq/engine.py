"""Runs plans over a catalog."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.catalog import ENTITIES, Catalog
from evq.functions import scalars
from evq.functions.predicates import to_column
from evq.lang import nodes as n
from evq.lang.diagnostics import CompileError, Diagnostic
from evq.lang.parser import parse
from evq.operators import correlate, records
from evq.operators import findings as fd
from evq.plans.analyze import Analysis, analyze
from evq.plans.planner import MODES, PlanError, plan

FORMAT = "evq.plan/0.1"
#: Records of a stream beyond which only the earliest are kept; None keeps all.
LIMITS = {"max_records_per_stream": 500_000, "max_bytes": 256 << 20, "timeout_seconds": 300}


@dataclass
class Compiled:
    """A checked program with its plans; ``plan_errors`` tells why a mode has none."""

    source: str
    program: n.Investigation
    analysis: Analysis
    plans: dict[str, dict]
    plan_errors: dict[str, str]

    @property
    def warnings(self) -> list[Diagnostic]:
        return self.analysis.warnings

    @property
    def graph(self) -> dict:
        p, a = self.program, self.analysis
        body = {
            "format": FORMAT, "source_sha256": hashlib.sha256(self.source.encode()).hexdigest(), "nodes": a.nodes, "bindings": a.heads, "outputs": a.outputs,
            "investigation": {"name": p.name, "title": p.title or p.name, "targets": p.targets and [t.text for t in p.targets], "window": a.window},
        }
        return body | {"graph_sha256": digest(body)}

    def plan(self, mode: str = "optimized") -> dict:
        if mode not in self.plans:
            raise CompileError([Diagnostic("error", "E0300", f"no plan for mode '{mode}': {self.plan_errors.get(mode, 'unknown mode')}")])
        return self.plans[mode]


def digest(value) -> str:
    return hashlib.sha256(scalars.canonical_json(value).encode()).hexdigest()


def compile_program(program: n.Investigation, source: str = "") -> Compiled:
    analysis, plans, errors = analyze(program), {}, {}
    for mode in MODES:
        try:
            plans[mode] = plan(analysis, mode)
        except PlanError as e:
            errors[mode] = str(e)
    if not plans or "optimized" in errors:
        raise CompileError([Diagnostic("error", "E0300", f"no plan: {errors['optimized']}")])
    return Compiled(source, program, analysis, plans, errors)


def compile_source(source: str) -> Compiled:
    return compile_program(parse(source), source)


def resolved_window(window: dict | None, at: str | None) -> dict | None:
    """From and to as timestamps; a window of the last so many seconds ends at ``at``."""
    if window is None or window["kind"] == "absolute":
        return window and {"from": window["from"], "to": window["to"]}
    end = scalars.parse_time(at) if at else datetime.utcnow()
    return {"from": scalars.show_time(end - timedelta(seconds=window["seconds"])), "to": scalars.show_time(end)}


@dataclass
class Frame:
    """Records (no aliases: flat columns) or chains (a struct for each alias), with the fields that are in reach."""

    df: DataFrame
    entities: dict[str, str]
    schemas: dict[str, dict[str, str]]
    flat: bool

    def column(self, name: str):
        return F.col(name)

    def chains(self, alias: str) -> DataFrame:
        return self.df.select(F.struct("*").alias(alias)) if self.flat else self.df


@dataclass
class Execution:
    """A plan over tables: lazy frames by stream and node. Nothing is computed before a result is asked for."""

    plan: dict
    window: dict | None
    streams: dict[str, Frame] = field(default_factory=dict)
    nodes: dict[str, Frame] = field(default_factory=dict)
    counters: dict[str, DataFrame] = field(default_factory=dict)
    cap: int = correlate.CAP

    def value(self, node: str) -> Frame:
        return self.streams.get(node) or self.nodes[node]

    def _node(self, op: str, binding: str | None) -> dict:
        found = [x for x in self.plan["steps"] if x["op"] == op and binding in (None, x["binding"])]
        if not found:
            raise LookupError(f"the program has no `{op}` of {binding or 'anything'}")
        return found[0]

    def frame(self, binding: str) -> DataFrame:
        """What a binding holds: flat records, or a struct for each alias."""
        for x in reversed(self.plan["steps"]):
            if x.get("binding") == binding and x["op"] not in ("emit", "preserve"):
                return self.nodes[x["id"]].df
        for s in self.plan["scans"]:
            if s["id"] == f"s_{binding}":
                return self.streams[s["id"]].df
        outputs = [x for x in self.plan["steps"] if x.get("binding") == binding]
        if outputs:
            return self.value(outputs[0]["inputs"][0]).df
        raise LookupError(f"'{binding}' reaches no output")

    def findings(self, binding: str | None = None) -> DataFrame:
        """All findings, or those of one binding."""
        made = None
        for x in self.plan["steps"]:
            if x["op"] == "emit" and binding in (None, x["binding"]):
                frame = self.value(x["inputs"][0])
                aliases = [c["alias"] for c in x["components"]]
                rename = dict(zip(aliases, frame.schemas if not frame.flat else aliases))
                schemas = {a: frame.schemas[rename[a] if not frame.flat else ""] for a in aliases}
                found = fd.findings(frame.chains(aliases[0]), x, aliases, schemas, {c["alias"]: c["entity"] for c in x["components"]})
                made = found if made is None else made.unionByName(found)
        if made is None:
            raise LookupError("the program emits nothing")
        return made

    def preserved(self, binding: str | None = None) -> DataFrame:
        node = self._node("preserve", binding)
        frame = self.value(node["inputs"][0])
        aliases = ["r"] if frame.flat else list(frame.schemas)
        return fd.preserved(frame.chains("r"), aliases)

    def chains_at_cap(self, binding: str) -> DataFrame:
        """First records of a sequence whose chains reached the cap, so that there may be more."""
        df = self.frame(binding)
        first = df.columns[0]
        return df.groupBy(F.col(f"{first}.evidence_id").alias("anchor")).agg(F.count("*").alias("chains")).where(F.col("chains") >= self.cap)

    def digest(self) -> str:
        """SHA-256 of the sorted finding digests; of an empty list if nothing is emitted."""
        if not any(x["op"] == "emit" for x in self.plan["steps"]):
            return digest([])
        return fd.list_digest(self.findings().select("digest"))


class Engine:
    def __init__(self, catalog: Catalog, cap: int = correlate.CAP, limits: dict | None = None):
        self.catalog, self.cap = catalog, cap
        self.limits = {"max_records_per_stream": None} | (limits or {})

    def run(self, program: str | n.Investigation | Compiled, at: str | None = None, mode: str = "optimized") -> Execution:
        compiled = compile_source(program) if isinstance(program, str) else program if isinstance(program, Compiled) else compile_program(program)
        window = resolved_window(compiled.analysis.window, at or self.catalog.reference_time)
        return self.execute(compiled.plan(mode), window)

    def execute(self, chosen: dict, window: dict | None, frozen: dict[str, DataFrame] | None = None) -> Execution:
        """``frozen`` gives the streams as they were, by id; else they are scanned."""
        out = Execution(chosen, window, cap=self.cap)
        for s in chosen["scans"]:
            out.streams[s["id"]] = self.stream(s, chosen, window, out) if frozen is None else self._shaped(frozen[s["id"]], s)
        for x in chosen["steps"]:
            inputs = [out.value(i) for i in x["inputs"]]
            out.nodes[x["id"]] = self.node(x, inputs, window)
        return out

    def _bounds(self, window: dict | None, within: int | None) -> tuple[datetime, datetime] | None:
        if window is None:
            return None
        start, end = scalars.parse_time(window["from"]), scalars.parse_time(window["to"])
        return (max(start, end - timedelta(seconds=within)) if within else start), end

    def _in_time(self, df: DataFrame, bounds: tuple[datetime, datetime] | None) -> DataFrame:
        if bounds is None:
            return df
        low, high = (F.lit(x).cast("timestamp_ntz") for x in bounds)
        return df.where(F.col("time").between(low, high))

    def scan(self, s: dict, window: dict | None) -> DataFrame:
        """The table's records in the plan's bounds of time that meet its predicate."""
        df = self.catalog.table(s["entity"])
        if s["bound"]:
            df = self._in_time(df, self._bounds(window, s["bound"]["seconds"]))
        return df.where(to_column(s["where"], F.col)) if s["where"] else df

    def stream(self, s: dict, chosen: dict, window: dict | None, out: Execution) -> Frame:
        readers = [x for x in chosen["steps"] if s["id"] in x["inputs"]]
        keys = readers[0]["keys"] if len(readers) == 1 and readers[0]["op"] in ("join", "sequence") and chosen["mode"] == "optimized" else ()
        df = records.first_of_key(self.scan(s, window), s["entity"], keys)
        df = records.labelled(df, s["entity"], self.catalog.name)
        if chosen["mode"] == "naive":
            df = self._in_time(df, self._bounds(window, None))
        most = self.limits["max_records_per_stream"]
        if most is not None:
            df = df.orderBy("time", "evidence_id").limit(most)
        return self._shaped(df, s)

    def _shaped(self, df: DataFrame, s: dict) -> Frame:
        names = s["columns"] if s["columns"] is not None else list(ENTITIES[s["entity"]].fields)
        schema = {f: k for f, k in ENTITIES[s["entity"]].schema.items() if f in (*names, "host", "time")}
        labels = [c for c in ("observed_at", "collector", "collector_version", "source") if c in df.columns]
        return Frame(df.select("evidence_id", "host", "time", "time_source", *labels, *(f for f in schema if f not in ("host", "time"))), {"": s["entity"]}, {"": schema}, True)

    def node(self, x: dict, inputs: list[Frame], window: dict | None) -> Frame:
        first, op = inputs[0], x["op"]
        if op in ("emit", "preserve"):
            return first
        if op == "filter":
            return Frame(first.df.where(to_column(x["predicate"], F.col)), first.entities, first.schemas, first.flat)
        if op == "within":
            return Frame(self._in_time(first.df, self._bounds(window, x["seconds"])), first.entities, first.schemas, first.flat)
        if op == "select":
            return self.select(x, first)
        frames, aliases = [self._plain(f) for f in inputs], x["aliases"]
        if op == "join":
            df = correlate.band_join(frames, aliases, x["keys"], x["within_seconds"])
        else:
            df = correlate.sequence(frames, aliases, x["keys"], x["within_seconds"], self.cap)
        return Frame(df, dict(zip(aliases, x["entities"])), {a: f.schemas[""] for a, f in zip(aliases, inputs)}, False)

    def _plain(self, f: Frame) -> DataFrame:
        return f.df.select("evidence_id", "time_source", *f.schemas[""])

    def select(self, x: dict, f: Frame) -> Frame:
        if f.flat:
            schema = {k: v for k, v in f.schemas[""].items() if k in (*x["fields"], "host", "time")}
            gone = [k for k in f.schemas[""] if k not in schema]
            return Frame(f.df.drop(*gone), f.entities, {"": schema}, True)
        schemas = {a: {k: v for k, v in s.items() if f"{a}.{k}" in x["fields"] or k in ("host", "time")} for a, s in f.schemas.items()}
        columns = [F.struct(*(F.col(f"{a}.{c}") for c in ("evidence_id", "time_source", *schemas[a]))).alias(a) for a in schemas]
        return Frame(f.df.select(*columns), f.entities, schemas, False)

    def counters(self, program: str, at: str | None = None) -> DataFrame:
        """stream, collected, after_time, after_predicate, after_dedupe of each scan, in one pass over each table."""
        compiled = compile_source(program)
        chosen, window = compiled.plan(), resolved_window(compiled.analysis.window, at or self.catalog.reference_time)
        made = None
        for s in chosen["scans"]:
            bounds = s["bound"] and self._bounds(window, s["bound"]["seconds"])
            in_time = F.col("time").between(*(F.lit(b).cast("timestamp_ntz") for b in bounds)) if bounds else F.lit(True)
            meets = F.coalesce(to_column(s["where"], F.col), F.lit(False)) if s["where"] else F.lit(True)
            rows = self.catalog.table(s["entity"]).select(*ENTITIES[s["entity"]].natural_key, in_time.alias("__time"), (in_time & meets).alias("__meets"))
            total = rows.agg(F.count("*").alias("collected"), F.count_if("__time").alias("after_time"), F.count_if("__meets").alias("after_predicate"))
            unique = rows.where("__meets").select(*ENTITIES[s["entity"]].natural_key).distinct().agg(F.count("*").alias("after_dedupe"))
            row = total.join(F.broadcast(unique)).select(F.lit(s["id"]).alias("stream"), "*")  # one row each
            made = row if made is None else made.unionByName(row)
        return made
