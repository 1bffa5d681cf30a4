"""Quality rules per document, and verdicts on hosts learnt from them.

Only DataFrame functions are used. A document is judged by base rules; a host
(the ``source`` column) is judged by the shares of its documents that fail each
rule, shrunk towards the corpus' share by a beta prior, which is fitted to the
hosts by moments: what their shares vary more than chance would have them, each
host counting by its documents. A host is rejected whose shrunk share lies
DEVIATIONS of the prior above the corpus' share, but never below LEAST and
always from MOST on. Documents of a rejected host must pass the strict rules as
well, so that a clean document survives a bad neighbourhood.

Defined cases: a null text has no words and fails the base rules; a null host
is a host of its own; repeated rows are judged (and counted) each; an empty
table gives no rows; columns other than the three named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm.scratch import Scratch, table

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window for repetition.
WINDOW = 8
#: The rules that hosts are judged by.
HOST_RULES = ("few_words", "repetitive", "symbolic", "odd_words", "dup_lines")
#: Standard deviations of the prior, and bounds of the share that rejects a host.
DEVIATIONS, LEAST, MOST = 2.0, 0.25, 0.75
#: The prior counts as so many documents at least and at most.
WEIGHTS = (1.0, 1000.0)


def _grams(hashes: Column) -> Column:
    """A 64-bit hash of each window, from the words' hashes (a column, as lambdas compute what is no column again and again)."""
    count = F.size(hashes) - (WINDOW - 1)
    return F.when(count >= 2, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def _covered(grams: Column) -> Column:
    """Words in windows that occur twice or more."""
    order = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(grams) - 1

    def repeated(s: Column) -> Column:
        alike = F.filter(
            s,
            lambda x, j: (F.when(j > 0, F.get(s, j - 1)["h"] == x["h"]).otherwise(False)) | (F.when(j < last, F.get(s, j + 1)["h"] == x["h"]).otherwise(False)),
        )
        at = F.sort_array(F.transform(alike, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).cast("bigint").alias("last"))
        return F.aggregate(
            at,
            start,
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("bigint"), p.cast("bigint") - a["last"])).alias("n"), p.cast("bigint").alias("last")),
            lambda a: a["n"],
        )

    # a one-element array binds the sorted array to a name, so that it is made once
    return F.get(F.transform(F.array(order), repeated), F.lit(0))


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), body.alias("t"))
    split = split.select(
        "doc_id",
        "host",
        F.array_remove(F.split("t", GAP), "").alias("words"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    split = split.select("doc_id", "host", "n_symbols", "words", "lines", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    split = split.select("doc_id", "host", "n_symbols", "words", "lines", _grams(F.col("hashes")).alias("grams"))
    return split.select(
        "doc_id",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), _covered(F.col("grams"))).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """Whether a row of ``features`` fails each rule."""
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repetitive": F.col("n_repeat_words") * 100 > n * 30,
        "symbolic": F.col("n_symbols") * 10 > n,
        "odd_words": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 15),
        "dup_lines": F.col("n_dup_lines") * 10 > n,
    }


BASE = ("few_words", "repetitive")


def prior(hosts: int, docs: int, squares: int, failed: int, spread: float) -> tuple[float, float]:
    """Mean and weight (a + b) of the beta prior, by moments of the beta-binomial law.

    ``squares`` is the sum of the hosts' documents squared, ``spread`` that of
    their failures squared over their documents. Of what the shares vary, chance
    makes up (hosts - 1) times mean times its complement; the rest gives the
    correlation within a host, whose inverse less 1 is the weight.
    """
    if not docs:
        return 0.0, WEIGHTS[1]
    mean = failed / docs
    chance = mean * (1 - mean)
    excess = spread - failed * failed / docs - chance * (hosts - 1)
    room = chance * (docs - squares / docs - (hosts - 1))
    if excess <= 0 or room <= 0:
        return mean, WEIGHTS[1]
    return mean, min(WEIGHTS[1], max(WEIGHTS[0], room / excess - 1))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """Hosts with their documents, failures (k_<rule>) and shrunk shares (rate_<rule>) by rule, and the verdict ``rejected``. ``judged`` has host and a boolean fail_<rule> for each rule."""
    n = F.col("n_docs")
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(F.col(f"fail_{r}").cast("bigint")).alias(f"k_{r}") for r in HOST_RULES))
    sums = [F.sum(f"k_{r}").alias(f"k_{r}") for r in HOST_RULES] + [F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / n).alias(f"s_{r}") for r in HOST_RULES]
    fitted = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares"), *sums).first()
    out, rejected = hosts, F.lit(False)
    for r in HOST_RULES:
        mean, weight = prior(fitted["hosts"], fitted["docs"] or 0, fitted["squares"] or 0, fitted[f"k_{r}"] or 0, fitted[f"s_{r}"] or 0.0)
        limit = min(MOST, max(LEAST, mean + DEVIATIONS * (mean * (1 - mean) / (weight + 1)) ** 0.5))
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + F.lit(weight * mean)) / (n + F.lit(weight)))
        rejected = rejected | (F.col(f"rate_{r}") >= limit)
    return out.withColumn("rejected", rejected)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: the features, base_failed, host_rejected, kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(features(docs, doc_id, text, host), "features")
    judged = rows.select("*", *(x.alias(f"fail_{r}") for r, x in rules().items()))
    bad = host_verdicts(judged).where("rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    out = judged.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    base = F.col("fail_few_words") | F.col("fail_repetitive")
    strict = F.col("fail_symbolic") | F.col("fail_odd_words") | F.col("fail_dup_lines")
    host_rejected = F.coalesce("bad", F.lit(False))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~(host_rejected & strict)).alias("kept"), host_rejected.alias("host_rejected"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM r) GROUP BY rid),
f AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON w.rid = c.rid),
j AS (SELECT *, n_words < 20 AS few_words, n_repeat_words * 100 > n_words * 30 AS repetitive, n_symbols * 10 > n_words AS symbolic,
        word_chars < n_words * 2 OR word_chars > n_words * 15 AS odd_words, n_dup_lines * 10 > n_words AS dup_lines FROM f),
k AS (SELECT source, unnest(['few_words', 'repetitive', 'symbolic', 'odd_words', 'dup_lines']) AS rule, count(*) AS n,
        unnest([sum(CAST(few_words AS INT)), sum(CAST(repetitive AS INT)), sum(CAST(symbolic AS INT)), sum(CAST(odd_words AS INT)), sum(CAST(dup_lines AS INT))]) AS k
      FROM j GROUP BY source),
p AS (SELECT rule, sum(k) / sum(n) AS m, sum(k) / sum(n) * (1 - sum(k) / sum(n)) AS c, sum(k * k / n) - sum(k) * sum(k) / sum(n) AS s, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, count(*) - 1 AS others FROM k GROUP BY rule),
q AS (SELECT rule, m, c, CASE WHEN s - c * others <= 0 OR c * room <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, c * room / (s - c * others) - 1)) END AS w FROM p),
h AS (SELECT source, bool_or((k + w * m) / (n + w) >= least(0.75, greatest(0.25, m + 2 * sqrt(c / (w + 1))))) AS rejected FROM k JOIN q ON k.rule = q.rule GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repetitive AS base_failed,
  NOT (few_words OR repetitive) AND NOT (coalesce(h.rejected, false) AND (symbolic OR odd_words OR dup_lines)) AS kept,
  coalesce(h.rejected, false) AS host_rejected
FROM j LEFT JOIN h ON j.source IS NOT DISTINCT FROM h.source
"""
