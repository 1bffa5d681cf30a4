"""Personal data, and the terms that give it away.

Base kinds (email, ip, card, phone) are found by patterns. Then co-occurrence
over the whole corpus tells which terms disclose a protected entity (a base
value): with p(e) the share of all words that stand within ``REACH`` code points
of e on its line, and p(e|t) that share among the occurrences of t, the
information that t gives about e is PMI(t, e) = ln(p(e|t) / p(e)), at most the
information content IC(e) = -ln p(e). A term with PMI / IC of ``DISCLOSURE`` or
more, seen ``SUPPORT`` times or more with e, is a finding wherever it stands near
e, and ``sanitise`` removes it; base values are generalised to their kind. Only
DataFrame functions are used.

No base pattern matches a line end, so texts are searched line by line, and
only lines with a likely match leave the scan.

Defined cases: a null text is empty; repeated rows count each and give a row
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm import spans as sp
from evq.llm.scratch import Scratch, table

REACH = 80
SUPPORT = 3
DISCLOSURE = 0.95
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def total(d: Column) -> Column:
        def term(i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + term(i))

    return F.length(_digits(v)).between(12, 19) & (sp.bound(_digits(v), total) % 10 == 0)


def _octets(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


#: Kind: pattern (possessive, and tied to where a run begins, so that long runs take linear time) and judge of a match.
BASE: dict[str, tuple[str, Callable[[Column], Column] | None]] = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _octets),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+", _luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(9, 15)),
}
#: A line without this has no base value.
LIKELY = r"@[A-Za-z0-9-]++\.|[0-9]\.[0-9]++\.[0-9]++\.[0-9]|(?:[0-9][\x20-]?){11}[0-9]|\+[0-9]"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, blob, lines (SPAN): the likely lines of every document."""
    t = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"), sp.clean(F.col("text")).alias("t"))
    likely = F.filter(sp.find(F.col("t"), r"[^\n]++"), lambda x: x["value"].rlike(LIKELY))
    return t.select("doc_id", "blob", F.when(F.col("t").rlike(LIKELY), likely).otherwise(F.array()).cast(sp.SPAN).alias("lines"))


def _entities(lines: DataFrame) -> DataFrame:
    """doc_id, blob, base (start, rank, stop, kind, entity) and words (SPAN, outside of base values) for each line with a base value; places in the document."""
    rows = lines.select("doc_id", "blob", F.explode("lines").alias("x"))
    rows = rows.select("doc_id", "blob", F.col("x.start").alias("at"), F.col("x.value").alias("line"))
    rows = rows.select("*", *(sp.find(F.col("line"), p, keep).alias(f"s_{k}") for k, (p, keep) in BASE.items()))

    def named(kind: str, rank: int) -> Callable[[Column], Column]:
        value = (lambda s: F.lower(s["value"])) if kind in ("email", "ip") else (lambda s: _digits(s["value"]))
        return lambda s: F.struct(
            (s["start"] + F.col("at")).alias("start"), F.lit(rank).alias("rank"), (s["stop"] + F.col("at")).alias("stop"),
            F.lit(kind).alias("kind"), F.concat(F.lit(kind + ":"), value(s)).alias("entity"),
        )

    base = F.concat(*(F.transform(f"s_{k}", named(k, i)) for i, k in enumerate(BASE)))
    rows = rows.select("doc_id", "blob", "at", "line", base.alias("base")).where(F.size("base") > 0)
    words = F.transform(
        sp.find(F.col("line"), WORD),
        lambda w: F.struct((w["start"] + F.col("at")).alias("start"), (w["stop"] + F.col("at")).alias("stop"), F.lower(w["value"]).alias("value")),
    )
    rows = rows.select("doc_id", "blob", "base", words.alias("words"))
    return rows.withColumn("words", F.filter("words", lambda w: ~F.exists("base", lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"]))))


def _contexts(lines: DataFrame) -> DataFrame:
    """doc_id, blob, entity, term, start, stop: each word near each entity, once for an entity that stands twice nearby."""
    near = F.transform(
        "base",
        lambda b: F.transform(
            F.filter("words", lambda w: (w["stop"] > b["start"] - REACH) & (w["start"] < b["stop"] + REACH)),
            lambda w: F.struct(b["entity"].alias("entity"), w["value"].alias("term"), w["start"].alias("start"), w["stop"].alias("stop")),
        ),
    )
    return lines.select("doc_id", "blob", F.explode(F.array_distinct(F.flatten(near))).alias("x")).select("doc_id", "blob", "x.*")



def _revealing(docs: DataFrame, contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """entity, term, disclosure: the pairs at or over the threshold."""
    joint = contexts.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    about = contexts.groupBy("entity").agg(F.count("*").alias("n_entity"))
    joint = scratch.save(joint.where(F.col("n_both") >= SUPPORT).join(about, "entity"), "joint")
    everything = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), SPLIT)).alias("term")).where(F.col("term") != "")
    corpus = scratch.save(everything.groupBy("term").agg(F.count("*").alias("n_term")), "corpus")
    n = max(1, corpus.agg(F.sum("n_term")).first()[0] or 0)
    pairs = joint.join(corpus, "term")
    # a term can stand near an entity on more than one line; no share is over 1
    given = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    content = -F.log(F.col("n_entity") / F.lit(float(n)))
    share = F.when(content > 0, 1 + F.log(given) / content).otherwise(0.0)
    return pairs.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, blob and found (start, rank, stop, kind) for every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "pii")
    lines = scratch.save(_lines(docs), "lines")
    entities = scratch.save(_entities(lines), "entities")
    contexts = _contexts(entities)
    revealing = scratch.save(_revealing(docs, contexts, scratch), "revealing")
    terms = contexts.join(revealing, ["entity", "term"], "left_semi")
    base = entities.select("doc_id", "blob", F.explode("base").alias("b")).select("doc_id", "blob", "b.start", "b.rank", "b.stop", "b.kind")
    added = terms.select("doc_id", "blob", "start", F.lit(len(BASE)).alias("rank"), "stop", F.lit("term").alias("kind"))
    found = base.unionByName(added).groupBy(F.col("doc_id").alias("f_doc"), F.col("blob").alias("f_blob"))
    found = found.agg(F.sort_array(F.collect_set(F.struct("start", "rank", "stop", "kind"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")
    rows = lines.select("doc_id", "blob").join(found, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("blob") == F.col("f_blob")), "left")
    return rows.select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text with base values generalised to ``[kind]`` and revealing terms removed; overlapping spans go as one, under the first one's kind."""
    found = detect(docs).where(F.size("found") > 0).dropDuplicates(["doc_id", "blob"])
    found = found.select(F.col("doc_id").alias("f_doc"), F.col("blob").alias("f_blob"), "found")
    rows = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("blob") == F.col("f_blob")), "left")

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        put = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.when(s["start"] >= a["at"], F.struct(s["stop"].alias("at"), F.concat(a["out"], F.array(gap, put)).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    length = F.length("text")
    whole = F.aggregate("found", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), (a["at"] + 1).cast("int"), length)))
    return rows.select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(whole).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"].isin(list(BASE)))
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        *(sp.count(found, k).alias(f"n_{k}") for k in BASE),
        F.sha2(sp.written(base).cast("binary"), 256).alias("base_sha256"),
        sp.written(found).alias("spans"),
    )


def _oracle() -> str:
    """The same in DuckDB's SQL, from the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({digits}, length({digits}) - i, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} ELSE ({digit} * 2) // 10 + ({digit} * 2) % 10 END)) % 10 = 0"
    keep = {
        "ip": "list_max(list_transform(string_split(v, '.'), lambda p: CAST(p AS HUGEINT))) <= 255",
        "card": f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }

    def found(pattern: str, where: str) -> str:
        """rid, v, s, e and the number of the line for the matches of a pattern."""
        return f"""SELECT rid, v, s, s + length(v) AS e, len(string_split(substr(t, 1, CAST(s AS BIGINT)), chr(10))) AS line FROM (
  SELECT rid, t, ps[i] AS v, coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) AS s FROM (
    SELECT rid, t, ps, unnest(range(2, len(ps), 2)) AS i FROM (
      SELECT rid, t, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS ps FROM {where})))"""

    kinds = " UNION ALL ".join(
        f"SELECT *, '{k}' AS kind, {i} AS rank, '{k}:' || {'lower(v)' if k in ('email', 'ip') else digits} AS entity FROM ({found(plain[k], 'd')}) WHERE {keep.get(k, 'true')}" for i, k in enumerate(BASE)
    )
    word, split = WORD, SPLIT
    join = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank, e)"
    share = "CASE WHEN -ln(n_entity / n) > 0 THEN 1 + ln(least(1.0, n_both / n_term)) / -ln(n_entity / n) ELSE 0.0 END"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents),
m AS MATERIALIZED ({kinds}),
w AS MATERIALIZED (SELECT rid, lower(v) AS term, s, e, line FROM ({found(word, '(SELECT * FROM d WHERE rid IN (SELECT rid FROM m))')}) x
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rid = x.rid AND m.s < x.e AND x.s < m.e)),
c AS MATERIALIZED (SELECT DISTINCT m.rid, entity, term, w.s, w.e FROM m JOIN w ON m.rid = w.rid AND m.line = w.line AND w.e > m.s - {REACH} AND w.s < m.e + {REACH}),
j AS (SELECT entity, term, count(*) AS n_both FROM c GROUP BY ALL HAVING count(*) >= {SUPPORT}),
a AS (SELECT entity, count(*) AS n_entity FROM c GROUP BY entity),
u AS MATERIALIZED (SELECT unnest(string_split_regex(lower(t), '{split}')) AS term FROM d),
k AS (SELECT term, count(*) AS n_term FROM u WHERE term <> '' GROUP BY term),
z AS (SELECT count(*) AS n FROM u WHERE term <> ''),
r AS (SELECT entity, term FROM j JOIN a USING (entity) JOIN k USING (term), z WHERE {share} >= {DISCLOSURE}),
f AS (SELECT rid, kind, rank, s, e FROM m UNION SELECT DISTINCT rid, 'term', {len(BASE)}, s, e FROM c JOIN r USING (entity, term)),
g AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, {join} FILTER (kind <> 'term') AS b, {join} AS x FROM f GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans FROM d LEFT JOIN g ON d.rid = g.rid"""


ORACLE = _oracle()
