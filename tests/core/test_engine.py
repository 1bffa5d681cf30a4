"""Predicates, correlations against brute force, both modes, findings, ingest, contracts, replay, streams, the command line."""

import copy
import datetime as dt
import hashlib
import ipaddress
import itertools
import json
import operator
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evq import cli
from evq.catalog import Catalog, schema
from evq.engine import Engine, compile_source
from evq.functions import scalars
from evq.functions.predicates import to_column
from evq.governance import contract, ed25519
from evq.operators import correlate, records
from evq.replay import Run, replay, run_offline
from evq.sources.manifest import Dataset, direction, parsed_time, syslog
from evq.streaming import live
from tests.core import lab

# predicates


def cmp(op, field, value, kind):
    return {"op": "cmp", "cmp": op, "field": field, "value": value, "type": kind}


KINDS = {"word": "str", "size": "int", "gone": "int", "on": "bool", "addr": "ip", "seen": "time"}
ROWS = [
    ("Zebra_%\\crossing\n", 7, None, False, "172.16.40.9", dt.datetime(2025, 5, 6, 7)),
    ("", -1, 3, None, None, None),
    (None, None, None, True, "fe80::1:2", dt.datetime(2025, 5, 6, 8, 0, 0, 5)),
    ("zebra", 0, 0, True, "172.31.255.255", dt.datetime(1999, 12, 31)),
]
VALUES = {
    "word": ["zebra", "ZEBRA_%", "crossing\n", "", "z"], "size": [7, 0, -1, "7"], "gone": [3, 1], "on": [True, False, 1],
    "addr": ["172.16.40.9", "fe80::1:2"], "seen": ["2025-05-06T07:00:00.000000Z"],
}
PATTERNS = ["*", "?*", "z?bra", "Z*G?", "*_%*", "*\\*", "zebra", "??????*"]
BLOCKS = ["172.16.0.0/12", "172.16.40.8/31", "172.16.40.8/32", "0.0.0.0/0", "fe80::/10", "fe80::1:3/127", "::/0", "128.0.0.0/1"]


def meant(p, row):
    """Whether a record meets a predicate: null meets no comparison, and values of two kinds only differ."""
    if p["op"] == "not":
        return not meant(p["arg"], row)
    if p["op"] in ("and", "or"):
        return (all if p["op"] == "and" else any)(meant(x, row) for x in p["args"])
    have, value, how, kind = row[p["field"]], p["value"], p["cmp"], p["type"]
    if value is None:
        return (have is None) == (how == "==")
    if have is None:
        return False
    fold = lambda x: "".join(c.lower() if c.isascii() else c for c in x) if isinstance(x, str) and how in ("like", "contains", "startswith", "endswith") else x
    have = scalars.show_time(have) if kind == "time" else fold(have)
    if how == "in":
        return any(type(have) is type(v) and have == fold(v) for v in value)
    if how == "cidr":
        block = ipaddress.ip_network(value, strict=False)
        return kind == "ip" and ipaddress.ip_address(have) in block
    if how == "like":
        return re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in fold(value)), have, re.S) is not None
    if type(have) is not type(value):
        return how == "!="
    value = fold(value)
    ways = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
    return ways[how](have, value) if how in ways else {"contains": value in have, "startswith": have.startswith(value), "endswith": have.endswith(value)}[how]


def predicates(rng):
    """Every comparison with every value, and trees of them."""
    out = [cmp(how, f, v, KINDS[f]) for f, values in VALUES.items() for v in values for how in ("==", "!=")]
    out += [cmp(how, f, v, KINDS[f]) for f in ("word", "size", "seen") for v in VALUES[f] for how in ("<", "<=", ">", ">=")]
    out += [cmp(how, "word", v, "str") for v in VALUES["word"] for how in ("contains", "startswith", "endswith")]
    out += [cmp("like", "word", v, "str") for v in PATTERNS] + [cmp("cidr", "addr", v, "ip") for v in BLOCKS]
    out += [cmp("in", f, VALUES[f], KINDS[f]) for f in ("word", "gone", "addr", "seen")] + [cmp(how, f, None, KINDS[f]) for f in KINDS for how in ("==", "!=")]
    for _ in range(150):
        some = rng.sample(out, rng.randrange(1, 4))
        out.append({"op": rng.choice(["and", "or"]), "args": some} if len(some) > 1 else {"op": "not", "arg": some[0]})
    return out


def test_predicates_mean_what_they_say(spark):
    made = predicates(random.Random(6))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, word string, size long, gone long, on boolean, addr string, seen timestamp_ntz")
    for at in range(0, len(made), 60):
        some = made[at : at + 60]
        for r in df.select("i", *(F.coalesce(to_column(p, F.col), F.lit(False)).alias(f"c{k}") for k, p in enumerate(some))).collect():
            row = dict(zip(KINDS, ROWS[r["i"]]))
            assert [(p, r[f"c{k}"]) for k, p in enumerate(some)] == [(p, meant(p, row)) for p in some]


def test_negations_reach_the_files(spark, tmp_path):
    spark.createDataFrame([("a", 1), (None, 2)], "name string, pid long").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where(to_column({"op": "not", "arg": cmp("==", "name", "a", "str")}, F.col))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(name),Not(EqualTo(name,a)))]" in plan and df.count() == 1


def test_canonical_values():
    assert scalars.canonical_time(" 2026-09-28t10:00:00.1234569+0530") == "2026-09-28T04:30:00.123456Z"
    assert scalars.canonical_ip("[::FFFF:10.1.2.3]") == "10.1.2.3" and scalars.canonical_ip("2001:0DB8::0") == "2001:db8::"
    for bad in ("2026-09-28", "yesterday", "2026-9-28T10:00:00Z", "2026-02-30T10:00:00Z", "2026-09-28T10:00:00+24:00", "2026-09-28T10:00:00Zx"):
        with pytest.raises(ValueError):
            scalars.parse_time(bad)
    assert scalars.ascii_fold("İÉA") == "İÉa"


def test_times_in_columns(spark):
    texts = [" 2026-09-28t10:00:00.1234569+0530 ", "2026-09-28 10:00:00", "2026-09-28T10:00:00-01:00", "2026-09-28", "2026-02-30T10:00:00Z", "2026-09-28T10:00:00+24:00", "0001-01-01T00:00:00+01:00", "2026-09-28T10:00:00Z\nx", "", None]
    got = [r[0] and scalars.show_time(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(parsed_time(F.col("t"))).collect()]

    def want(t):
        try:
            return t and scalars.canonical_time(t)
        except (ValueError, OverflowError):
            return None

    assert got == [want(t) or None for t in texts]


# correlations


def entity_rows(rows, entity):
    names = schema(entity).names
    return [tuple(r.get(f) for f in names) for r in rows]


T0 = dt.datetime(2026, 1, 1)


def brute_sequence(steps, within, cap):
    """Depth first from every first record, in order of (time, id)."""
    out = []
    for first in steps[0]:
        found = []

        def grow(chain, i):
            if len(found) >= cap:
                return
            if i == len(steps):
                found.append(chain)
                return
            for r in sorted(steps[i], key=lambda r: (r["time"], r["id"])):
                same = first["pid"] is not None and r["pid"] == first["pid"] and r["host"] == first["host"]
                if same and chain[-1]["time"] <= r["time"] <= first["time"] + dt.timedelta(seconds=within):
                    grow([*chain, r], i + 1)

        if first["pid"] is not None:
            grow([first], 1)
        out += [tuple(r["id"] for r in c) for c in found]
    return sorted(out)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), steps=st.integers(2, 4), cap=st.sampled_from([1, 2, 5, 100]))
def test_sequences(spark, seed, steps, cap):
    rng = random.Random(seed)
    frames, plain = [], []
    for i in range(steps):
        rows = [{"id": f"{i}-{k}", "host": rng.choice("AB"), "pid": rng.choice([1, 2, None]), "time": T0 + dt.timedelta(seconds=rng.randrange(12))} for k in range(rng.randrange(0, 9))]
        plain.append(rows)
        frames.append(spark.createDataFrame([(r["id"], r["host"], r["time"], r["pid"]) for r in rows], "evidence_id string, host string, time timestamp_ntz, pid long"))
    names = [f"s{i}" for i in range(steps)]
    got = correlate.sequence(frames, names, ["host", "pid"], 6, cap).select(*(F.col(f"{a}.evidence_id") for a in names))
    assert sorted(tuple(r) for r in got.collect()) == brute_sequence(plain, 6, cap)


def test_band_join(spark):
    rows = [(f"{p}{t}", "H", T0 + dt.timedelta(seconds=t), p) for p in (1, 2, None) for t in range(0, 20, 3)]
    df = spark.createDataFrame(rows, "evidence_id string, host string, time timestamp_ntz, pid long")
    got = correlate.band_join([df, df], ["a", "b"], ["pid"], 6).select("a.evidence_id", F.col("b.evidence_id").alias("b"))
    want = [(a[0], b[0]) for a, b in itertools.product(rows, rows) if a[3] is not None and a[3] == b[3] and abs((a[2] - b[2]).total_seconds()) <= 6]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_one_exchange_for_each_input_of_a_join(spark):
    """Deduplication and join share an exchange, where the keys are part of the natural key."""
    rows = spark.range(1000).select(F.concat(F.lit("H"), F.col("id") % 7).alias("host"), F.lit(T0).cast("timestamp_ntz").alias("time"), F.col("id").alias("pid"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        program = 'investigation q { let a = observe Process\nlet b = observe NetworkConnection\nlet j = join a, b on host, pid\npreserve j }'
        run = Engine(Catalog({"Process": rows, "NetworkConnection": rows})).run(program)
        plan = run.frame("j")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_of_a_natural_key_wins(spark):
    rows = [("H", T0, "u", "1", "late", None, 1, 0), ("H", T0, "u", "1", "first", None, 0, 5), ("H", T0, "u", "1", "second", None, 0, 6)]
    df = spark.createDataFrame(rows, "host string, time timestamp_ntz, name string, uid string, domain string, home string, _source int, _row long")
    assert [r["domain"] for r in records.first_of_key(df, "User").collect()] == ["first"]


def test_evidence_ids(spark):
    key = ["H\"\n\u001f\\é", 7, "2026-01-01T00:00:00.000000Z"]
    row = spark.createDataFrame([(key[0], T0, 7)], "host string, time timestamp_ntz, pid long")
    want = hashlib.sha256(scalars.canonical_json({"entity": "Process", "key": key}).encode()).hexdigest()[:32]
    assert row.select(records.evidence_id("Process")).first()[0] == f"ev_{want}"


# runs


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    return str(lab.write(tmp_path_factory.mktemp("lab")))


SECRET = bytes(range(32))


def test_ingest(spark, dataset):
    found = Dataset(spark, dataset)
    rows = {(r["host"], r["pid"], r["name"]): r for r in found.catalog().table("Process").collect()}
    assert len(rows) == 10  # the bad time is out, the copy has the same key
    odd = rows["OFFLINE-01", None, "5"]
    assert odd["path"] == "true" and odd["user"] is None and odd["time"] == dt.datetime(2026, 3, 10, 23) and odd["collector"] == "OfflineProcessCollector"
    assert rows["depot", 88, "rar.exe"]["source"] == "offline:lab/process.jsonl" and rows["depot", 88, "rar.exe"]["ppid"] == 1
    assert found.counters("Process").first().asDict() == {"scanned": 12, "normalize_errors": 3}
    net = {(r["host"], r["pid"]): r for r in found.catalog().table("NetworkConnection").collect()}
    assert net["depot", 88]["remote_ip"] == "2001:db8:7::1" and net["depot", 88]["local_ip"] == "10.0.0.1" and net["depot", 1]["remote_ip"] is None and net["depot", 1]["remote_port"] is None
    files = found.catalog().table("File").where("pid IS NULL").first()
    assert files["size"] is None and files["time_source"] == "birth" and files["observed_at"] == files["time"]
    event = found.catalog().table("Event").first()
    assert event["time"] == dt.datetime(2026, 3, 11, 10) and event["event_id"] is None and event["record_id"] == 7


def test_ingest_refuses(spark, tmp_path):
    (tmp_path / "dataset.json").write_text(json.dumps({"name": "x", "sources": [{"entity": "User", "path": "u", "format": "xml"}]}))
    with pytest.raises(ValueError, match="unknown source format"):
        Dataset(spark, str(tmp_path))
    (tmp_path / "dataset.json").write_text(json.dumps({"name": "x", "sources": [{"entity": "User", "path": "u.json", "format": "json"}]}))
    (tmp_path / "u.json").write_text("{}")
    with pytest.raises(Exception, match="array of objects"):
        Dataset(spark, str(tmp_path)).catalog().table("User").collect()
    (tmp_path / "u.json").write_text("[{]")
    with pytest.raises(Exception, match="(?i)malformed|json"):
        Dataset(spark, str(tmp_path)).catalog().table("User").collect()


def test_incidents_and_no_controls(spark, dataset):
    for mode in ("optimized", "naive"):
        run = Engine(Dataset(spark, dataset).catalog()).run(lab.PROGRAM, mode=mode)
        found = run.frame("leak").select("packers.host", "packers.pid").collect()
        assert {tuple(r) for r in found} == lab.INCIDENTS


PROGRAMS = [
    lab.PROGRAM,
    "investigation recent { window last 2d\nlet p = observe Process | filter pid < 700 | within 10h\nemit finding p }",
    "investigation joined { let f = observe File\nlet p = observe Process\nlet j = join f, p on pid, host within 4m | filter p.name like \"*z*\" and f.size <= 10 and (f.action == \"create\" or p.pid > 3)\npreserve j\nemit finding j }",
    "investigation twice { window last 2d\nlet f = observe File\nlet n = observe NetworkConnection\nlet s = sequence f -> n on host, pid within 15m\nemit finding s\nlet t = s | filter n.pid in [88, 31] | select f.path\nemit finding t }",
    "investigation itself { window last 2d\nlet n = observe NetworkConnection | filter remote_ip not in [\"192.0.2.200\"]\nlet m = n | filter protocol == \"tcp\" | within 30h\nlet s = sequence m -> n on host, pid within 9m\nemit finding s severity high }",
    "investigation loose { let f = observe File | filter not size > 3 or pid == null\nemit finding f }",
]


@pytest.mark.parametrize("program", PROGRAMS)
def test_both_modes_agree(spark, dataset, program):
    engine = Engine(Dataset(spark, dataset).catalog())
    digests = []
    for mode in ("optimized", "naive"):
        found = engine.run(program, mode=mode).findings()
        digests.append(sorted((r["anchor"], tuple(map(tuple, r["chains"]))) for r in found.collect()))
    assert digests[0] == digests[1] and digests[0]


def test_finding_documents(spark, dataset):
    run = Engine(Dataset(spark, dataset).catalog()).run(lab.PROGRAM)
    rows = run.findings("leak").collect()
    for r in rows:
        body = json.loads(r["document"])
        assert scalars.canonical_json(body) == r["document"]
        assert r["digest"] == hashlib.sha256(r["document"].encode()).hexdigest() and r["finding_id"] == "fd_" + r["digest"][:24]
        assert sorted(body["evidence"]) == sorted(set(sum(body["chains"], []))) and body["chains"][0][0] == body["anchor"]
        assert body["first_seen"] == min(e["time"] for e in body["evidence"].values())
        assert [c["alias"] for c in body["components"]] == ["packers", "archives", "uploads"]
    want = hashlib.sha256(scalars.canonical_json(sorted(r["digest"] for r in rows)).encode()).hexdigest()
    assert run.digest() == want
    assert {r[0] for r in run.preserved("leak").collect()} == {i for r in rows for i in r["evidence_ids"]}


def test_cap_is_noted(spark):
    times = [(f"H", T0 + dt.timedelta(seconds=i), 1) for i in range(5)]
    df = spark.createDataFrame(times, "host string, time timestamp_ntz, pid long")
    program = "investigation q { let a = observe Process\nlet b = observe File\nlet s = sequence a -> b on host, pid within 1h\nemit finding s }"
    run = Engine(Catalog({"Process": df, "File": df.withColumn("path", F.lit("p"))}), cap=3).run(program)
    assert run.chains_at_cap("s").count() == 3 and run.frame("s").count() == 3 + 3 + 3 + 2 + 1


def test_counters(spark, dataset):
    rows = {r["stream"]: r.asDict() for r in Engine(Dataset(spark, dataset).catalog()).counters(lab.PROGRAM).collect()}
    assert rows["s_packers"] == {"stream": "s_packers", "collected": 11, "after_time": 10, "after_predicate": 8, "after_dedupe": 7}


def test_run_and_replay(spark, dataset, tmp_path):
    folder = tmp_path / "run"
    run = run_offline(spark, lab.PROGRAM, dataset, SECRET, str(folder))
    result = json.loads((folder / "result.json").read_text())
    assert result["findings"] == 3 and result["preserved"]["leak"]["count"] == 9
    found = json.loads((folder / "findings.json").read_text())
    proof = json.loads((folder / "provenance" / f"{found[0]['finding_id']}.json").read_text())
    assert [x["alias"] for x in proof["derived"][0]["links"]] == ["packers", "archives", "uploads"]
    assert {e["collector"]["name"] for e in proof["evidence"]} == {"OfflineProcessCollector", "OfflineFileCollector", "OfflineNetworkConnectionCollector"}
    assert proof["contract"]["sums"] == run.body["sums"] and proof["contract"]["proof"] == run.contract["proof"]
    for line in (folder / "evidence" / "s_packers.jsonl").read_text().splitlines():
        record = json.loads(line)
        claimed = record.pop("sha256")
        assert hashlib.sha256(scalars.canonical_json(record).encode()).hexdigest() == claimed
    good = replay(spark, str(folder))
    assert good["match"] and not good["failed"] and not good["damaged"] and good["records"] == sum(result["records"].values())
    path = folder / "evidence" / "s_uploads.jsonl"
    lines = path.read_text().splitlines()
    path.write_text("\n".join([lines[0].replace('"remote_port":443', '"remote_port":80'), *lines[1:]]) + "\n")
    bad = replay(spark, str(folder))
    assert not bad["match"] and bad["damaged"] == 1 and bad["damaged_ids"] == [json.loads(lines[0])["evidence_id"]]
    run.write_tables(f"{tmp_path}/tables")
    assert spark.read.parquet(f"{tmp_path}/tables/evidence").where("entity = 'Process'").count() == result["records"]["s_packers"]


# contracts


def made():
    return contract.issue(compile_source(lab.PROGRAM), {"depot": "windows", "north-2": None}, SECRET), ed25519.public_key(SECRET)


def later(text, seconds):
    return scalars.show_time(scalars.parse_time(text) + dt.timedelta(seconds=seconds))


def test_signatures():
    # RFC 8032, 7.1, test 2
    secret = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    public = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    assert ed25519.public_key(secret) == public
    value = ed25519.sign(secret, b"\x72")
    assert value.hex().startswith("92a009a9f0d4cab8720e820b5f642540") and ed25519.verify(public, b"\x72", value)
    assert not ed25519.verify(public, b"\x73", value) and not ed25519.verify(public, b"\x72", value[:-1] + b"\x01")


def test_contracts():
    signed, public = made()
    claims = signed["claims"]
    assert contract.failures(signed, public) == contract.failures(signed, public, host="north-2") == []
    assert contract.failures(signed, public, host="south") == ["host"]
    assert contract.failures(signed, public, at=later(claims["until"], 1)) == ["until"] and not contract.failures(signed, public, at=claims["until"])
    assert contract.failures(signed, ed25519.public_key(ed25519.new_secret())) == ["key", "proof"]
    for change in (lambda c: c["plan"]["scans"][0].update(where=None), lambda c: c["plan"]["steps"].pop()):
        wider = copy.deepcopy(signed)
        change(wider["claims"])
        assert contract.failures(wider, public) == ["proof", "plan"]
    for proof in ({}, {"ed25519": "no base64"}, signed["proof"] | {"ed25519": signed["proof"]["ed25519"][:-8] + "AAAAAAA="}):
        assert "proof" in contract.failures({"claims": claims, "proof": proof}, public)


def test_hosts_check_more():
    signed, public = made()
    claims, seen = signed["claims"], set()

    def failures(changed=None, **known):
        return contract.failures(signed if changed is None else contract.signed(claims | changed, SECRET), public, strict=True, **known)

    assert failures(host="depot", platform="windows", seen=seen, entities={"Process", "File", "NetworkConnection", "User"}) == []
    assert failures(seen=seen) == ["nonce"] and seen == {claims["nonce"]}
    assert failures(host="depot", platform="linux") == ["platform"] and failures(host="north-2", platform="linux") == []
    assert failures(entities={"File", "Process"}) == ["entities"]
    assert failures(at=later(claims["from"], -301)) == ["from"] and failures(at=later(claims["from"], -299)) == []
    assert failures({"privileges": claims["privileges"][1:]}) == ["privileges"] and failures({"made_with": "0 other"}) == ["made_with"]


# other sources, streams


def test_syslog_and_direction(spark, tmp_path):
    (tmp_path / "s.log").write_text("Jan  5 10:00:01 web sshd[77]: login ok\n2026-01-05T10:00:02+01:00 db cron: tick: tock\nnoise\n")
    rows = syslog(spark, str(tmp_path / "s.log"), 2026).orderBy("time").collect()
    assert [(r["host"], r["provider"], r["pid"], r["message"]) for r in rows] == [("db", "cron", None, "tick: tock"), ("web", "sshd", 77, "login ok")]
    assert rows[0]["time"] == dt.datetime(2026, 1, 5, 9, 0, 2)
    df = spark.createDataFrame([("LISTEN", 0, True), ("ESTABLISHED", 9, True), ("ESTABLISHED", 9, False), ("X", 0, False)], "state string, remote_port int, listening boolean")
    assert [r[0] for r in df.select(direction()).collect()] == ["listen", "inbound", "outbound", "bound"]


def test_streams_give_what_batches_give(spark, tmp_path):
    rng = random.Random(6)
    kind = "host string, time timestamp_ntz, pid long, name string"
    rows = [("H", T0 + dt.timedelta(seconds=rng.randrange(300)), rng.randrange(3), rng.choice("ab")) for _ in range(60)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in")

    def frames(df, stream):
        named = lambda x: df.where(F.col("name") == x)
        if stream:
            return [live.records(named(x), "Process") for x in "ab"]
        return [records.first_of_key(named(x), "Process").withColumn("evidence_id", records.evidence_id("Process")) for x in "ab"]

    batch = correlate.sequence(frames(spark.read.parquet(f"{tmp_path}/in"), False), ["a", "b"], ["host", "pid"], 40)
    source = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    out = live.sequence(frames(source, True), ["a", "b"], ["host", "pid"], 40).select(F.col("a.evidence_id").alias("a"), F.col("b.evidence_id").alias("b"))
    query = out.writeStream.format("memory").queryName("chains").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(r) for r in spark.table("chains").collect())
    assert got == sorted((r[0], r[1]) for r in batch.select("a.evidence_id", F.col("b.evidence_id").alias("b")).collect()) and got


# command line


def test_command_line(spark, dataset, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    program = tmp_path / "p.evq"
    program.write_text(lab.PROGRAM)
    assert cli.main(["check", str(program)]) == 0 and "Derived<Sequence" in capsys.readouterr().out
    assert cli.main(["compile", str(program), "--out", str(tmp_path / "c")]) == 0 and (tmp_path / "c" / "plans.json").exists()
    (tmp_path / "policy.json").write_text(json.dumps({"name": "p", "default": {"allow": ["collect:process"]}}))
    assert cli.main(["compile", str(program), "--emit", "types", "--policy", str(tmp_path / "policy.json")]) == 3
    assert cli.main(["keygen", "--out", str(tmp_path / "key")]) == 0
    assert cli.main(["run", str(program), "--dataset", dataset, "--out", str(tmp_path / "r"), "--key", str(tmp_path / "key")]) == 0
    assert cli.main(["replay", str(tmp_path / "r")]) == 0
    assert cli.main(["verify-contract", str(tmp_path / "r" / "contract.json")]) == 0
    assert cli.main(["verify-contract", str(tmp_path / "r" / "contract.json"), "--host", "X"]) == 5
    (tmp_path / "r" / "result.json").write_text(json.dumps({"digest": "other"}))
    assert cli.main(["replay", str(tmp_path / "r")]) == 4
    program.write_text("investigation x { }")
    capsys.readouterr()
    assert cli.main(["check", str(program)]) == 1 and "E0211" in capsys.readouterr().err
    assert cli.main(["replay", str(tmp_path / "none")]) == 1
