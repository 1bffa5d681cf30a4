"""The test tables seen as the five entities, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from evq.catalog import ENTITIES, Catalog

#: Entity: the base table and the view on it; TIMESTAMP_X is each dialect's name for a time without zone.
VIEWS = {
    "Process": ("orders", """SELECT concat('H', CAST(o_orderkey % 7 AS VARCHAR(20))) AS host, o_orderdate AS time, o_orderkey AS pid, o_custkey AS ppid,
  CASE o_orderstatus WHEN 'F' THEN 'PowerShell.exe' WHEN 'P' THEN 'pwsh' ELSE 'chrome.exe' END AS name,
  concat('/opt/', o_orderpriority) AS path, NULLIF(o_orderpriority, '1-URGENT') AS cmdline, concat('u', CAST(o_custkey AS VARCHAR(20))) AS user FROM {t}"""),
    "File": ("lineitem", """SELECT concat('H', CAST(l_orderkey % 7 AS VARCHAR(20))) AS host, l_shipdate AS time,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS pid, concat('/tmp/p', CAST(l_partkey AS VARCHAR(20))) AS path,
  concat('p', CAST(l_partkey AS VARCHAR(20))) AS name, CASE l_returnflag WHEN 'A' THEN 'ps1' WHEN 'R' THEN 'pdf' ELSE 'tmp' END AS extension,
  CAST(l_quantity AS BIGINT) AS size, CASE l_returnflag WHEN 'N' THEN 'modify' ELSE 'create' END AS action,
  CASE WHEN l_linenumber = 7 THEN 'none' ELSE 'event' END AS attribution, CAST(NULL AS VARCHAR(64)) AS sha256 FROM {t}"""),
    "NetworkConnection": ("lineitem", """SELECT concat('H', CAST(l_orderkey % 7 AS VARCHAR(20))) AS host, l_shipdate AS time, l_orderkey AS pid, 'tcp' AS protocol,
  CASE l_linestatus WHEN 'O' THEN 'outbound' ELSE 'inbound' END AS direction, 'ESTABLISHED' AS state, '10.0.0.10' AS local_ip,
  CAST(40000 + l_linenumber AS BIGINT) AS local_port,
  concat(CASE l_linenumber % 3 WHEN 0 THEN '127' WHEN 1 THEN '10' ELSE '203' END, '.', CAST(l_partkey % 256 AS VARCHAR(20)), '.', CAST(l_suppkey % 256 AS VARCHAR(20)), '.1') AS remote_ip,
  CAST(CASE l_linenumber % 2 WHEN 0 THEN 443 ELSE 8443 END AS BIGINT) AS remote_port FROM {t}"""),
    "User": ("customer", """SELECT concat('H', CAST(c_custkey % 7 AS VARCHAR(20))) AS host, TIMESTAMP_X '1998-01-01 00:00:00' AS time, c_name AS name,
  CAST(c_custkey AS VARCHAR(20)) AS uid, c_mktsegment AS domain, CAST(NULL AS VARCHAR(64)) AS home FROM {t}
  UNION ALL SELECT concat('H', CAST(c_custkey % 7 AS VARCHAR(20))), TIMESTAMP_X '1999-01-01 00:00:00', c_name, CAST(c_custkey AS VARCHAR(20)), 'copy', CAST(NULL AS VARCHAR(64)) FROM {t} WHERE c_custkey % 3 = 0"""),
    "Event": ("events", """SELECT concat('H', CAST(user_id % 7 AS VARCHAR(20))) AS host, ts AS time, event_type AS channel, 'app' AS provider, CAST(NULL AS BIGINT) AS event_id,
  event_id AS record_id, CASE WHEN value >= 100 THEN 'high' ELSE 'low' END AS level, user_id AS pid, NULLIF(props, '{{"k": 0}}') AS message FROM {t}
  UNION ALL SELECT concat('H', CAST(user_id % 7 AS VARCHAR(20))), ts, event_type, 'app', CAST(NULL AS BIGINT), event_id, 'copy', user_id, 'copied' FROM {t} WHERE event_type = 'click'"""),
}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    out = Catalog(name="fixtures", reference_time="1998-08-01T00:00:00Z")
    for entity, (table, sql) in VIEWS.items():
        base = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        out.register(entity, spark.sql(sql.replace("TIMESTAMP_X", "TIMESTAMP_NTZ"), t=base))
    return out


def _json(field: str, kind: str) -> str:
    if kind == "int":
        return f"coalesce(CAST({field} AS VARCHAR), 'null')"
    text = f"strftime({field}, '%Y-%m-%dT%H:%M:%S.%fZ')" if kind == "time" else field
    return f"coalesce('\"' || {text} || '\"', 'null')"


def scan(entity: str, where: str = "true") -> str:
    """DuckDB's SQL for the entity's records that meet a condition, one for each natural key, with evidence_id."""
    e = ENTITIES[entity]
    key = " || ',' || ".join(_json(f'"{f}"', e.schema[f]) for f in e.natural_key)
    order = ", ".join(f'"{f}" NULLS FIRST' for f in e.schema)
    table, sql = VIEWS[entity]
    view = sql.replace("TIMESTAMP_X", "TIMESTAMP").format(t=table).replace("AS user FROM", 'AS "user" FROM')
    names = ", ".join(f'"{f}"' for f in e.natural_key)
    return f"""(SELECT *, 'ev_' || substr(sha256('{{"entity":"{entity}","key":[' || {key} || ']}}'), 1, 32) AS evidence_id FROM ({view})
  WHERE {where} QUALIFY row_number() OVER (PARTITION BY {names} ORDER BY {order}) = 1)"""
