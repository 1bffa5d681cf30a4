"""Secret scans over the history of files, with a ledger of scanned blobs.

Every version of a file is addressed by its content. The ledger has a row for
each blob scanned with each rule version; a run scans only pairs that the ledger
lacks, one copy of each blob, and findings are joined back to all paths. Only
DataFrame functions are used.

Defined cases: a null text is the empty blob; equal rows share a blob and give a
row each; an empty table gives no rows; other columns are ignored. Patterns are
possessive where the plain form would backtrack or recurse, so that very long
texts take linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm import spans as sp
from evq.llm.scratch import Scratch, table

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""

Rule = tuple[int, str, Callable[[Column], Column] | None]
#: Kind: version, pattern, judge of a match. Raising a version makes the ledger scan every blob with that rule again.
BASE: dict[str, Rule] = {
    "assign": (1, _ASSIGN, lambda v: F.length(F.regexp_extract(v, _VALUE, 1)) >= 8),
    "access": (1, r"AKIA[A-Z0-9]{12,}+", None),
    "hex": (1, r"(?<![0-9a-f])[0-9a-f]{32,}+", None),
}
#: What the scan adds to the base kinds.
MORE: dict[str, Rule] = {
    "pem": (1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", None),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", None),
    "github": (1, r"gh[pousr]_[A-Za-z0-9]{36,}+", None),
    "slack": (1, r"xox[abprs]-[A-Za-z0-9-]{10,}+", None),
    "url_login": (1, r"[a-z]{2,10}://[A-Za-z0-9._%+-]{1,64}:[^\s:@/]{3,64}@", None),
}
RULES = BASE | MORE


def _key(kind: str, rules: dict[str, Rule]) -> str:
    return f"{kind}@{rules[kind][0]}"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: dict[str, Rule] = RULES) -> DataFrame:
    """The rows to add to the ledger: blob_id, scanned (rule@version), found (kind, start, stop).

    ``versions`` has path and text, one row for each version of each path;
    ``ledger`` has rows of earlier runs. A blob whose rules were all seen gives no row.
    """
    keys = [_key(k, rules) for k in rules]
    blobs = versions.select(blob_id(F.col("text")).alias("blob_id"), F.col("path"))
    todo = blobs.groupBy("blob_id").agg(F.min("path").alias("path"))
    if ledger is None:
        todo = todo.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.select("blob_id", F.explode("scanned").alias("key")).groupBy("blob_id").agg(F.collect_set("key").alias("seen"))
        todo = todo.join(seen, "blob_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        todo = todo.where(F.size(F.array_except(F.array(*map(F.lit, keys)), F.col("seen"))) > 0)
    # a path may have several versions, hence both columns; equal rows meet again in the last grouping
    todo = todo.select(F.col("blob_id").alias("todo_blob"), F.col("path").alias("todo_path"), "seen")
    texts = versions.select("path", "text", blob_id(F.col("text")).alias("blob_id"))
    texts = texts.join(todo.hint("shuffle_hash"), (F.col("path").eqNullSafe(F.col("todo_path"))) & (F.col("blob_id") == F.col("todo_blob")))
    texts = texts.select("blob_id", "seen", sp.clean(F.col("text")).alias("t"))
    nothing = F.array().cast(sp.SPAN)
    found = {k: F.when(F.array_contains("seen", _key(k, rules)), nothing).otherwise(sp.find(F.col("t"), pattern, keep)) for k, (_, pattern, keep) in rules.items()}
    rows = texts.select("blob_id", F.array_except(F.array(*map(F.lit, keys)), F.col("seen")).alias("scanned"), *(x.alias(f"s_{k}") for k, x in found.items()))
    return rows.select("blob_id", "scanned", sp.ordered({k: F.col(f"s_{k}") for k in rules}).alias("found"))


def findings(versions: DataFrame, ledger: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """path, blob_id and found, for every version; the findings are those of the current rule versions."""
    keys = [_key(k, rules) for k in rules]
    ranks = {k: i for i, k in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    hits = ledger.where(F.arrays_overlap("scanned", F.array(*map(F.lit, keys)))).where(F.size("found") > 0)
    hits = hits.select("blob_id", F.array_intersect("scanned", F.array(*map(F.lit, keys))).alias("scanned"), F.explode("found").alias("f"))
    hits = hits.where(F.array_contains("scanned", F.element_at(F.create_map(*[F.lit(x) for k in rules for x in (k, _key(k, rules))]), F.col("f.kind"))))
    hits = hits.groupBy(F.col("blob_id").alias("hit_blob")).agg(F.sort_array(F.collect_set(F.struct("f.start", F.element_at(rank, F.col("f.kind")).alias("rank"), "f.stop", "f.kind"))).alias("found"))
    paths = versions.select("path", blob_id(F.col("text")).alias("blob_id"))
    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")
    return paths.join(hits, F.col("blob_id") == F.col("hit_blob"), "left").select("path", "blob_id", F.coalesce("found", none).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    ledger = Scratch(spark, "secrets").save(scan(docs), "ledger")
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"].isin(list(BASE)))
    return findings(docs, ledger).select(
        F.col("path").alias("doc_id"),
        *(sp.count(found, k).alias(f"n_{k}") for k in BASE),
        F.sha2(sp.written(base).cast("binary"), 256).alias("base_sha256"),
        sp.written(found).alias("spans"),
        "blob_id",
    )


def _oracle() -> str:
    """The same spans by splitting at marks in DuckDB's SQL."""
    plain = {
        "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?""",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
        "pem": "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
        "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
        "github": "gh[pousr]_[A-Za-z0-9]{36,}",
        "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
        "url_login": r"[a-z]{2,10}://[A-Za-z0-9._%+-]{1,64}:[^\s:@/]{3,64}@",
    }
    value = "[A-Za-z0-9+/_.=-]+"
    keep = {"assign": f"length(regexp_extract(v, '^{plain['assign'].replace(chr(39), chr(39) * 2)}({value})$', 1)) >= 8", "access": "length(v) >= 16", "hex": "length(v) >= 32"}
    parts = []
    for rank, kind in enumerate(RULES):
        pattern = (plain[kind] + value * (kind == "assign")).replace("'", "''")
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s, s + length(v) AS e, v FROM (
  SELECT doc_id, ps[i] AS v, coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) AS s FROM (
    SELECT doc_id, ps, unnest(range(2, len(ps), 2)) AS i FROM (
      SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS ps FROM d)))
  WHERE {keep.get(kind, 'true')}""")
    join = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank)"
    base = "('assign', 'access', 'hex')"
    return f"""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, {join} FILTER (kind IN {base}) AS b, {join} AS a FROM m GROUP BY doc_id)
SELECT documents.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans,
  sha256(coalesce(text, '')) AS blob_id FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id"""


ORACLE = _oracle()
