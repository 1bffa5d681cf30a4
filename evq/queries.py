"""A query for each capability, as a program over the fixture views, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq import builder as b
from evq.catalog import ENTITIES
from evq.engine import Engine
from evq.fixtures import catalog, scan
from evq.operators import correlate

ALL = 'window from "1990-01-01T00:00:00Z" to "2030-01-01T00:00:00Z"'


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


def _program(body: str, window: str = ALL) -> str:
    return f'investigation q {{ targets ["H1"] {window}\n{body}\n}}'


def _frame(body: str, name: str, columns: dict[str, str], window: str = ALL, cap: int = correlate.CAP, mode: str = "optimized") -> Callable[[SparkSession, str], DataFrame]:
    """The frame of a binding, as ``columns`` (name: field)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(catalog(spark, sf_dir), cap).run(_program(body, window), mode=mode).frame(name)
        return df.select(*(F.col(f).alias(c) for c, f in columns.items()))

    return run


def _records(entity: str, stages: str, where: str, window: str = ALL, fields: list[str] | None = None, mode: str = "optimized") -> Query:
    fields = fields or ["evidence_id", *ENTITIES[entity].schema]
    run = _frame(f"let a = observe {entity} {stages}\nemit finding a", "a", {f: f for f in fields}, window, mode=mode)
    return Query(run, f"SELECT {', '.join(f'"{f}"' for f in fields)} FROM {scan(entity, where)}")


def _chains(body: str, name: str, columns: dict[str, str], sql: str, window: str = ALL, cap: int = correlate.CAP) -> Query:
    return Query(_frame(body, name, columns, window, cap), sql)


_NET = "direction = 'outbound' AND NOT starts_with(remote_ip, '127.')"
CONSOLES = 'let p = observe Process | filter name in ["PowerShell.exe", "pwsh"]'
WRITES = 'let f = observe File | filter action == "create"'
OUTWARD = 'let n = observe NetworkConnection | filter not remote_ip in cidr("127.0.0.0/8") and direction == "outbound"'
_P = scan("Process", "name IN ('PowerShell.exe', 'pwsh')")
_F = scan("File", "action = 'create'")
_N = scan("NetworkConnection", _NET)
_PF = {"p": "p.evidence_id", "f": "f.evidence_id", "pid": "p.pid", "p_time": "p.time", "f_time": "f.time"}
_PFN = {"p": "p.evidence_id", "f": "f.evidence_id", "n": "n.evidence_id", "host": "p.host", "pid": "p.pid"}


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{f} AS {c}" for c, f in columns.items())


def _event(name: str, channel: str) -> str:
    return f'let {name} = observe Event | filter channel == "{channel}"'


def _events(channel: str) -> str:
    return scan("Event", f"channel = '{channel}'")


def _three(days: int, cap: int = correlate.CAP, where: str = "true") -> str:
    return f"""SELECT {_listed(_PFN)} FROM {_P} p JOIN {_F} f ON p.host = f.host AND p.pid = f.pid AND f.time >= p.time
  JOIN {_N} n ON n.host = p.host AND n.pid = p.pid AND n.time >= f.time AND n.time <= p.time + INTERVAL {days} DAY WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY p.evidence_id ORDER BY f.time, f.evidence_id, n.time, n.evidence_id) <= {cap}"""


def _sequence3(stages: str = "", days: int = 30, cap: int = correlate.CAP, where: str = "true") -> Query:
    body = f"{CONSOLES}\n{WRITES}\n{OUTWARD}\nlet s = sequence p -> f -> n on host, pid within {days}d {stages}\nemit finding s"
    return _chains(body, "s", _PFN, _three(days, cap, where), cap=cap)


def _findings(body: str, sql: str, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Engine(catalog(spark, sf_dir)).run(_program(body)).findings(name)
        return found.select("anchor", "host", F.size("chains").cast("bigint").alias("n_chains"), F.size("evidence_ids").cast("bigint").alias("n_records"), "first_seen", "last_seen", "severity", "title")

    return Query(run, sql)


def _preserve(body: str, name: str, sql: str) -> Query:
    return Query(lambda spark, sf_dir: Engine(catalog(spark, sf_dir)).run(_program(body)).preserved(name), sql)


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = f"{CONSOLES}\n{WRITES} | within 1200d\nlet j = join p, f on host, pid\nemit finding j"
    return Engine(catalog(spark, sf_dir)).counters(_program(body, "window last 1500d"))


def _reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Engine(catalog(spark, sf_dir)).run(_program(f"{CONSOLES}\n{WRITES}\n{OUTWARD}\nlet s = sequence p -> f -> n on host, pid within 30d\nemit finding s"))
    frames = [run.streams[f"s_{x}"].df for x in "pfn"]
    kept = correlate.key_intersection(frames, ["host", "pid"])
    rows = [df.select(F.lit(x).alias("stream"), "evidence_id") for x, df in zip("pfn", kept)]
    return rows[0].union(rows[1]).union(rows[2])


def _capped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(catalog(spark, sf_dir), limits={"max_records_per_stream": 500})
    return engine.run(_program("let a = observe Event\nemit finding a")).frame("a").select("evidence_id", "time")


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = b.investigation(
        "built", window=b.between("1995-06-01T00:00:00Z", "1998-06-01T00:00:00Z"),
        p=b.observe("Process").filter(b.field("name").like("p*") & ~(b.field("ppid") < 500)), u=b.observe("User").select("name", "uid"),
        j=b.join(["p", "u"], on=["host"], within="1000d").filter(b.field("u.uid").endswith("7") & (b.field("p.cmdline") != None)),  # noqa: E711
        outputs=[b.emit("j")],
    )
    df = Engine(catalog(spark, sf_dir)).run(program).frame("j")
    return df.select(F.col("p.evidence_id").alias("p"), F.col("u.evidence_id").alias("u"), F.col("u.name").alias("name"))


_IP = "CAST(split_part(remote_ip, '.', {}) AS BIGINT)"
_SECOND = f"({_IP.format(2)} * 65536 + {_IP.format(3)} * 256 + {_IP.format(4)})"

QUERIES: dict[str, Query] = {
    **{f"observe_{e.lower()}": _records(e, "", "true") for e in ENTITIES},
    "filter_eq": _records("Process", '| filter name == "pwsh"', "name = 'pwsh'"),
    "filter_ne": _records("Process", '| filter cmdline != "5-LOW"', "cmdline <> '5-LOW'"),
    "filter_not_over_null": _records("Process", '| filter not cmdline == "5-LOW"', "cmdline IS NULL OR cmdline <> '5-LOW'"),
    "filter_is_null": _records("File", "| filter pid == null", "pid IS NULL"),
    "filter_is_not_null": _records("File", "| filter not pid == null and not extension == \"tmp\"", "pid IS NOT NULL AND extension <> 'tmp'"),
    "filter_order_int": _records("Process", "| filter ppid >= 100 and ppid < 700", "ppid >= 100 AND ppid < 700"),
    "filter_order_time": _records("Event", '| filter time > "2024-01-10T12:30:00+05:30" and time <= "2024-01-12T00:00:00.5"', "time > TIMESTAMP '2024-01-10 07:00:00' AND time <= TIMESTAMP '2024-01-12 00:00:00.5'"),
    "filter_order_str": _records("Process", '| filter cmdline > "3-MEDIUM"', "cmdline > '3-MEDIUM'"),
    "filter_in": _records("Event", '| filter channel in ["signup", "error",]', "channel IN ('signup', 'error')"),
    "filter_not_in": _records("Event", '| filter message not in ["copied", "{\\"k\\": 1}"]', "message IS NULL OR message NOT IN ('copied', '{\"k\": 1}')"),
    "filter_contains": _records("Process", '| filter name contains "SHELL"', "contains(lower(name), 'shell')"),
    "filter_startswith": _records("Process", '| filter path startswith "/OPT/1"', "starts_with(lower(path), '/opt/1')"),
    "filter_endswith": _records("Process", '| filter name endswith ".EXE"', "ends_with(lower(name), '.exe')"),
    "filter_like_glob": _records("File", '| filter path like "/TMP/p?0*"', "regexp_matches(lower(path), '^/tmp/p.0.*$')"),
    "filter_cidr_octets": _records("NetworkConnection", '| filter remote_ip in cidr("10.0.0.0/8")', "starts_with(remote_ip, '10.')"),
    "filter_cidr_v4": _records("NetworkConnection", '| filter remote_ip in cidr("203.16.0.0/13")', f"starts_with(remote_ip, '203.') AND {_SECOND} BETWEEN 16 * 65536 AND 24 * 65536 - 1"),
    "filter_not_cidr": _records("NetworkConnection", '| filter remote_ip not in cidr("203.16.0.0/13")', f"NOT (starts_with(remote_ip, '203.') AND {_SECOND} BETWEEN 16 * 65536 AND 24 * 65536 - 1)"),
    "filter_cidr_v6": _records("NetworkConnection", '| filter remote_ip in cidr("fd00::/8") or remote_port == 443 and local_port > 40004', "remote_port = 443 AND local_port > 40004"),
    "filter_bool_tree": _records("Process", '| filter name == "pwsh" or not (ppid > 300 or cmdline == null) and path endswith "low"', "name = 'pwsh' OR (ppid <= 300 AND cmdline IS NOT NULL AND ends_with(lower(path), 'low'))"),
    "filter_type_strict_ip": _records("NetworkConnection", '| filter remote_ip != "::ffff:10.1.2.1" and local_ip == "::FFFF:10.0.0.10"', "remote_ip <> '10.1.2.1' AND local_ip = '10.0.0.10'"),
    "select_implicit": _records("Process", "| select pid, name", "true", fields=["host", "time", "pid", "name"]),
    "window_range": _records("File", "", "time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'", 'window from "1996-01-01T00:00:00Z" to "1996-06-30T00:00:00Z"'),
    "window_last": _records("Process", "", "time BETWEEN TIMESTAMP '1998-07-02' AND TIMESTAMP '1998-08-01'", "window last 30d"),
    "within_stage": _records("Process", "| within 48h | filter ppid > 5", "time BETWEEN TIMESTAMP '1998-07-30' AND TIMESTAMP '1998-08-01' AND ppid > 5", "window last 30d"),
    "within_and_window": _records("Process", "| within 400d", "time BETWEEN TIMESTAMP '1998-07-02' AND TIMESTAMP '1998-08-01'", "window last 30d"),
    "dedupe_before_window_naive": Query(
        _frame("let a = observe User\nemit finding a", "a", {"evidence_id": "evidence_id", "time": "time", "domain": "domain"}, 'window from "1997-06-01T00:00:00Z" to "1998-06-01T00:00:00Z"', mode="naive"),
        f"SELECT evidence_id, time, domain FROM {scan('User')} WHERE time <= TIMESTAMP '1998-06-01'",
    ),
    "dedupe_after_window": _records("User", "", "time >= TIMESTAMP '1998-06-01' AND time <= TIMESTAMP '1999-06-01'", 'window from "1998-06-01T00:00:00Z" to "1999-06-01T00:00:00Z"'),
    "join_inner": _chains(f"{CONSOLES}\n{WRITES}\nlet j = join p, f on host, pid\nemit finding j", "j", _PF, f"SELECT {_listed(_PF)} FROM {_P} p JOIN {_F} f ON p.host = f.host AND p.pid = f.pid"),
    "join_within": _chains(f"{CONSOLES}\n{WRITES}\nlet j = join p, f on host, pid within 20d\nemit finding j", "j", _PF, f"SELECT {_listed(_PF)} FROM {_P} p JOIN {_F} f ON p.host = f.host AND p.pid = f.pid AND f.time BETWEEN p.time - INTERVAL 20 DAY AND p.time + INTERVAL 20 DAY"),
    "join_no_host": _chains(f"{_event('a', 'signup')}\n{_event('c', 'error')}\nlet v = c | select pid, message\nlet j = join a, v on pid within 1h\nemit finding j", "j", {"a": "a.evidence_id", "v": "v.evidence_id"}, f"SELECT a.evidence_id AS a, v.evidence_id AS v FROM {_events('signup')} a JOIN {_events('error')} v ON a.pid = v.pid AND v.time BETWEEN a.time - INTERVAL 1 HOUR AND a.time + INTERVAL 1 HOUR"),
    "join_null_keys": _chains("let f = observe File | filter size > 45\nlet g = observe File | filter size < 3\nlet j = join f, g on pid\nemit finding j", "j", {"f": "f.evidence_id", "g": "g.evidence_id"}, f"SELECT f.evidence_id AS f, g.evidence_id AS g FROM {scan('File', 'size > 45')} f JOIN {scan('File', 'size < 3')} g ON f.pid = g.pid"),
    "sequence_2": _chains(f"{CONSOLES}\n{WRITES}\nlet s = sequence p -> f on host, pid within 30d\nemit finding s", "s", _PF, f"SELECT {_listed(_PF)} FROM {_P} p JOIN {_F} f ON p.host = f.host AND p.pid = f.pid AND f.time >= p.time AND f.time <= p.time + INTERVAL 30 DAY"),
    "sequence_3": _sequence3(),
    "sequence_3_wide": _sequence3(days=90),
    "sequence_capped": _sequence3(days=2000, cap=2),
    "sequence_ties": _chains("let f = observe File | filter extension == \"pdf\"\nlet n = observe NetworkConnection\nlet s = sequence f -> n on host, pid within 1s\nemit finding s", "s", {"f": "f.evidence_id", "n": "n.evidence_id"}, f"SELECT f.evidence_id AS f, n.evidence_id AS n FROM {scan('File', 'extension = ' + chr(39) + 'pdf' + chr(39))} f JOIN {scan('NetworkConnection')} n ON f.host = n.host AND f.pid = n.pid AND n.time >= f.time AND n.time <= f.time + INTERVAL 1 SECOND"),
    "sequence_self": _chains("let a = observe Event | filter channel == \"signup\"\nlet b = a | filter level == \"high\"\nlet s = sequence a -> b on host, pid within 6h\nemit finding s", "s", {"a": "a.evidence_id", "b": "b.evidence_id"}, f"SELECT a.evidence_id AS a, b.evidence_id AS b FROM {_events('signup')} a JOIN (SELECT * FROM {_events('signup')} WHERE level = 'high') b ON a.host = b.host AND a.pid = b.pid AND b.time >= a.time AND b.time <= a.time + INTERVAL 6 HOUR"),
    "sequence_events": _chains(f"{_event('a', 'signup')}\n{_event('b', 'purchase')}\n{_event('c', 'error')}\nlet s = sequence a -> b -> c on host, pid within 7d\nemit finding s", "s", {"a": "a.evidence_id", "b": "b.evidence_id", "c": "c.evidence_id"}, f"""SELECT a.evidence_id AS a, b.evidence_id AS b, c.evidence_id AS c FROM {_events('signup')} a JOIN {_events('purchase')} b ON a.host = b.host AND a.pid = b.pid AND b.time >= a.time
  JOIN {_events('error')} c ON c.host = a.host AND c.pid = a.pid AND c.time >= b.time AND c.time <= a.time + INTERVAL 7 DAY QUALIFY row_number() OVER (PARTITION BY a.evidence_id ORDER BY b.time, b.evidence_id, c.time, c.evidence_id) <= 100"""),
    "sequence_4": _chains(f"{_event('a', 'signup')}\n{_event('b', 'click')}\n{_event('c', 'purchase')}\n{_event('d', 'error')}\nlet s = sequence a -> b -> c -> d on host, pid within 5d\nemit finding s", "s", {"a": "a.evidence_id", "b": "b.evidence_id", "c": "c.evidence_id", "d": "d.evidence_id"}, f"""SELECT a.evidence_id AS a, b.evidence_id AS b, c.evidence_id AS c, d.evidence_id AS d FROM {_events('signup')} a JOIN {_events('click')} b ON a.host = b.host AND a.pid = b.pid AND b.time >= a.time
  JOIN {_events('purchase')} c ON c.host = a.host AND c.pid = a.pid AND c.time >= b.time JOIN {_events('error')} d ON d.host = a.host AND d.pid = a.pid AND d.time >= c.time AND d.time <= a.time + INTERVAL 5 DAY
  QUALIFY row_number() OVER (PARTITION BY a.evidence_id ORDER BY b.time, b.evidence_id, c.time, c.evidence_id, d.time, d.evidence_id) <= 100"""),
    "derived_filter": _sequence3('| filter f.size > 20 and (n.remote_port == 443 or p.ppid < 400)', 90, where="f.size > 20 AND (n.remote_port = 443 OR p.ppid < 400)"),
    "derived_filter_below_cap": _sequence3('| filter f.size > 20 and n.remote_port == 443', 2000, 2, "f.size > 20 AND n.remote_port = 443"),
    "derived_select": _chains(f"{CONSOLES}\n{WRITES}\nlet j = join p, f on host, pid within 9d | select p.name, f.path\nlet k = j | filter f.path like \"*7\"\nemit finding k", "k", {"p": "p.evidence_id", "name": "p.name", "path": "f.path", "host": "f.host", "f_time": "f.time"}, f"SELECT p.evidence_id AS p, p.name AS name, f.path AS path, f.host AS host, f.time AS f_time FROM {_P} p JOIN {_F} f ON p.host = f.host AND p.pid = f.pid AND f.time BETWEEN p.time - INTERVAL 9 DAY AND p.time + INTERVAL 9 DAY WHERE ends_with(f.path, '7')"),
    "alias_reuse": _records("Process", '| filter ppid < 900\nlet b = a | filter name == "pwsh"\nlet c = a | select pid\npreserve c\nemit finding b', "ppid < 900"),
    "shared_stream": _chains(f"{CONSOLES}\n{WRITES}\nlet j = join p, f on host, pid within 5d\nlet s = sequence p -> f on host, pid within 5d\nemit finding j\nemit finding s", "j", _PF, f"SELECT {_listed(_PF)} FROM {_P} p JOIN {_F} f ON p.host = f.host AND p.pid = f.pid AND f.time BETWEEN p.time - INTERVAL 5 DAY AND p.time + INTERVAL 5 DAY"),
    "semi_join_reduced": Query(_reduced, " UNION ALL ".join(f"SELECT '{x}' AS stream, evidence_id FROM {t} WHERE (host, pid) IN (SELECT host, pid FROM {_P} INTERSECT SELECT host, pid FROM {_F} INTERSECT SELECT host, pid FROM {_N})" for x, t in zip("pfn", (_P, _F, _N)))),
    "preserve_ids": _preserve(f"{CONSOLES}\n{WRITES}\nlet j = join p, f on host, pid within 15d\npreserve j", "j", f"WITH j AS (SELECT p.evidence_id AS a, f.evidence_id AS b FROM {_P} p JOIN {_F} f ON p.host = f.host AND p.pid = f.pid AND f.time BETWEEN p.time - INTERVAL 15 DAY AND p.time + INTERVAL 15 DAY) SELECT a AS evidence_id FROM j UNION SELECT b FROM j"),
    "emit_evidence": _findings('let a = observe User | filter domain == "copy"\nemit finding a as "copied" severity low', f"SELECT evidence_id AS anchor, host, CAST(1 AS BIGINT) AS n_chains, CAST(1 AS BIGINT) AS n_records, time AS first_seen, time AS last_seen, 'low' AS severity, 'copied' AS title FROM {scan('User', 'domain = ' + chr(39) + 'copy' + chr(39))}", "a"),
    "emit_derived": _findings(f'{CONSOLES}\n{WRITES}\n{OUTWARD}\nlet s = sequence p -> f -> n on host, pid within 90d\nemit finding s severity high', f"""WITH c AS (SELECT p.evidence_id AS anchor, p.host AS host, [p.evidence_id, f.evidence_id, n.evidence_id] AS ids, p.time AS a, n.time AS z FROM {_P} p JOIN {_F} f ON p.host = f.host AND p.pid = f.pid AND f.time >= p.time
  JOIN {_N} n ON n.host = p.host AND n.pid = p.pid AND n.time >= f.time AND n.time <= p.time + INTERVAL 90 DAY QUALIFY row_number() OVER (PARTITION BY p.evidence_id ORDER BY f.time, f.evidence_id, n.time, n.evidence_id) <= 100)
SELECT anchor, host, count(*) AS n_chains, CAST(len(list_distinct(flatten(list(ids)))) AS BIGINT) AS n_records, min(a) AS first_seen, max(z) AS last_seen, 'high' AS severity, 's' AS title FROM c GROUP BY anchor, host""", "s"),
    "chains_at_cap": Query(
        lambda spark, sf_dir: Engine(catalog(spark, sf_dir), cap=2).run(_program(f"{CONSOLES}\n{WRITES}\nlet s = sequence p -> f on host, pid within 900d\nemit finding s")).chains_at_cap("s"),
        f"WITH c AS (SELECT p.evidence_id AS anchor, count(*) AS n FROM {_P} p JOIN {_F} f ON p.host = f.host AND p.pid = f.pid AND f.time >= p.time AND f.time <= p.time + INTERVAL 900 DAY GROUP BY 1) SELECT anchor, CAST(2 AS BIGINT) AS chains FROM c WHERE n >= 2",
    ),
    "stream_counters": Query(_counters, " UNION ALL ".join(
        f"SELECT '{s}' AS stream, (SELECT count(*) FROM {base}) AS collected, (SELECT count(*) FROM {base} WHERE {t}) AS after_time, (SELECT count(*) FROM {base} WHERE {t} AND {w}) AS after_predicate, (SELECT count(*) FROM {scan(e, t + ' AND ' + w)}) AS after_dedupe"
        for s, e, t, w, base in (
            ("s_p", "Process", "time BETWEEN TIMESTAMP '1998-08-01' - INTERVAL 1500 DAY AND TIMESTAMP '1998-08-01'", "name IN ('PowerShell.exe', 'pwsh')", "(SELECT o_orderdate AS time, CASE o_orderstatus WHEN 'F' THEN 'PowerShell.exe' WHEN 'P' THEN 'pwsh' ELSE 'chrome.exe' END AS name FROM orders)"),
            ("s_f", "File", "time BETWEEN TIMESTAMP '1998-08-01' - INTERVAL 1200 DAY AND TIMESTAMP '1998-08-01'", "action = 'create'", "(SELECT l_shipdate AS time, CASE l_returnflag WHEN 'N' THEN 'modify' ELSE 'create' END AS action FROM lineitem)"),
        )
    )),
    "record_cap": Query(_capped_stream, f"SELECT evidence_id, time FROM {scan('Event')} ORDER BY time, evidence_id LIMIT 500"),
    "built_program": Query(_built, f"SELECT p.evidence_id AS p, u.evidence_id AS u, u.name AS name FROM {scan('Process', 'starts_with(lower(name), ' + chr(39) + 'p' + chr(39) + ') AND NOT ppid < 500 AND cmdline IS NOT NULL AND time BETWEEN TIMESTAMP ' + chr(39) + '1995-06-01' + chr(39) + ' AND TIMESTAMP ' + chr(39) + '1998-06-01' + chr(39))} p JOIN {scan('User', 'ends_with(uid, ' + chr(39) + '7' + chr(39) + ') AND time BETWEEN TIMESTAMP ' + chr(39) + '1995-06-01' + chr(39) + ' AND TIMESTAMP ' + chr(39) + '1998-06-01' + chr(39))} u ON p.host = u.host AND u.time BETWEEN p.time - INTERVAL 1000 DAY AND p.time + INTERVAL 1000 DAY"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell starts, drops a file, connects out: the findings."""
    program = _program(f'{CONSOLES}\n{WRITES}\n{OUTWARD}\nlet s = sequence p -> f -> n on host, pid within 90d\nemit finding s as "shell, file, connection" severity high')
    found = Engine(catalog(spark, sf_dir)).run(program).findings("s")
    return found.select("finding_id", "digest", "anchor", "host", F.size("chains").alias("n_chains"), "first_seen", "last_seen", "severity", "title")
