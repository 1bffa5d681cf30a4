"""Benchmark passages in documents, through a positional inverted index.

The index is a stored table of postings: document, term and place. A search goes
from a window's rarest term in the corpus (counts over all documents) to the
next rarest and on. The lists of these two are made of all documents. Where
they meet within a window's length, the other terms' lists are made of those
documents alone, as no others would be read. A phrase stands where the lists of
all its terms, moved by the terms' offsets, intersect; terms are near where each
list has a place within a distance of the rarest one's, in any order. Only
DataFrame functions are used.

``build`` takes the terms whose postings are stored; with none it indexes every
word. Documents are told apart by a 64-bit hash of doc_id and text.

Defined cases: a null text has no words; a document row counts for itself, so
repeated rows give a row each; empty tables give no rows or no hits; other
columns are ignored; items without words are in no document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm.scratch import Scratch, small_side, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Consecutive words of an item that make a window.
WINDOW = 13
#: A document is contaminated if one word in so many is hit.
SHARE = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The word that stands before each document, at place 0, so that documents without hits keep their row; no word is empty.
HEAD = ""


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, GAP), "")


def windows(items: DataFrame) -> DataFrame:
    """window_id (numbers that hold once this is stored), terms (the window's words) and items (ids that have it), one row for each distinct window."""
    rows = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    rows = rows.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), WINDOW).alias("terms"))
    rows = rows.groupBy("terms").agg(F.collect_set("item_id").alias("items"))
    return rows.select(F.monotonically_increasing_id().alias("window_id"), "terms", "items")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences in all documents of each of ``terms`` (a stored table), 0 included."""
    found = docs.select(F.explode(words(F.col("text"))).alias("term")).join(small_side(terms), "term", "left_semi")
    found = found.groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """The windows with their rarest term and the next other one: term1, off1, term2, off2 (first places in the window, from 0); with one term alone it is both."""
    rows = stored.select("window_id", F.posexplode("terms").alias("off", "term")).groupBy("window_id", "term").agg(F.min("off").alias("off"))
    rare = F.slice(F.sort_array(F.collect_list(F.struct("n", "term", "off"))), 1, 2)
    rows = rows.join(counts, "term").groupBy("window_id").agg(rare.alias("r")).join(stored, "window_id")
    one, two = F.get("r", F.lit(0)), F.get("r", F.size("r") - 1)
    return rows.select("window_id", "terms", "items", one["term"].alias("term1"), one["off"].alias("off1"), two["term"].alias("term2"), two["off"].alias("off2"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def build(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The postings of ``keyed`` documents: doc_id, key, n_words, term and place (from 1).

    ``terms`` is a stored table with the column term. Every document row has a
    posting of HEAD at place 0.
    """
    rows = docs.select("doc_id", "key", F.concat(F.array(F.lit(HEAD)), words(F.col("text"))).alias("w"))
    rows = rows.select("doc_id", "key", (F.size("w") - 1).cast("bigint").alias("n_words"), F.posexplode("w").alias("place", "term"))
    if terms is not None:
        head = terms.sparkSession.createDataFrame([(HEAD,)], "term string")
        rows = rows.join(small_side(terms.select("term").distinct().union(head)), "term", "left_semi")
    return rows.select("doc_id", "key", "n_words", "term", "place")


def lists(index: DataFrame) -> DataFrame:
    """key, term, place without HEAD; repeated rows are one document here."""
    return index.where(F.col("place") > 0).select("key", "term", "place").distinct()


def close_by(wanted: DataFrame, found: DataFrame, within: int) -> DataFrame:
    """Rows of ``wanted`` (key, term, at and more) with the place of each posting of that term within so many places of ``at``. Places meet by stretches of that length, so that a common term of a long document isn't compared with itself all over."""
    width = F.lit(within + 1)
    here = wanted.withColumn("near", F.explode(F.array(*(F.floor(F.col("at") / width) + d for d in (-1, 0, 1)))))
    there = found.select("key", "term", "place", F.floor(F.col("place") / width).alias("near"))
    return here.join(there, ["key", "term", "near"]).where(F.abs(F.col("at") - F.col("place")) <= within).drop("near")


def meetings(first: DataFrame, starts: DataFrame, within: int = WINDOW - 1) -> DataFrame:
    """key, window_id, at, begin and in_step: where a window's rarest term stands (at) with the next one within so many places; in_step if that one is at its offset, begin being where the phrase would start."""
    pairs = starts.select("term1", "term2").distinct()
    found = lists(first)
    wanted = found.select("key", F.col("term").alias("term1"), F.col("place").alias("at")).join(small_side(pairs), "term1").withColumnRenamed("term2", "term")
    met = close_by(wanted, found, within).withColumnRenamed("term", "term2")
    met = met.join(small_side(starts.select("window_id", "term1", "off1", "term2", "off2")), ["term1", "term2"])
    begin = F.col("at") - F.col("off1")
    met = met.select("key", "window_id", "at", begin.alias("begin"), (begin + F.col("off2") == F.col("place")).alias("in_step"))
    return met.groupBy("key", "window_id", "at", "begin").agg(F.max("in_step").alias("in_step"))


def phrases(met: DataFrame, others: DataFrame, stored: DataFrame) -> DataFrame:
    """key, window_id, begin, len: where all terms' lists, moved by the terms' offsets, intersect."""
    terms = stored.select("window_id", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term"))
    wanted = met.where("in_step").select("key", "window_id", "begin").join(small_side(terms), "window_id")
    wanted = wanted.select("key", "window_id", "begin", "len", "term", (F.col("begin") + F.col("off")).alias("place"))
    found = wanted.join(others, ["key", "term", "place"]).groupBy("key", "window_id", "begin", "len").agg(F.count("*").alias("n"))
    return found.where("n = len").select("key", "window_id", "begin", "len")


def proximity(met: DataFrame, others: DataFrame, stored: DataFrame, found: DataFrame, within: int = WINDOW - 1) -> DataFrame:
    """key, window_id, at: where all terms of a window stand within so many places (WINDOW - 1 or more) of its rarest one, in any order; not more than ``meetings`` looked at. The terms of a phrase that is ``found`` do, so only the other meetings are looked at again."""
    phrase = found.select("key", "window_id", "begin", F.lit(True).alias("whole"))
    met = met.select("key", "window_id", "at", F.when(F.col("in_step"), F.col("begin")).alias("begin")).join(phrase, ["key", "window_id", "begin"], "left")
    met = met.groupBy("key", "window_id", "at").agg(F.max("whole").alias("whole"))
    terms = stored.select("window_id", F.array_distinct("terms").alias("t")).select("window_id", F.size("t").alias("many"), F.explode("t").alias("term"))
    wanted = met.where("whole IS NULL").select("key", "window_id", "at").join(small_side(terms), "window_id")
    near = close_by(wanted, others, within).select("key", "window_id", "at", "many", "term").distinct()
    near = near.groupBy("key", "window_id", "at", "many").agg(F.count("*").alias("n"))
    return near.where("n = many").union(met.where("whole").select("key", "window_id", "at", F.lit(0), F.lit(0))).select("key", "window_id", "at")


def search(docs: DataFrame, items: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of the windows of ``items`` in ``keyed`` documents: the first index, the windows, ``phrases`` and ``proximity``, all stored."""
    stored = scratch.save(windows(items), "windows")
    terms = scratch.save(stored.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = scratch.save(term_counts(docs, terms), "counts")
    starts = scratch.save(anchors(stored, counts), "anchors")
    rare = scratch.save(starts.select(F.explode(F.array("term1", "term2")).alias("term")).distinct(), "rare")
    index = scratch.save(build(docs, rare), "postings")
    met = scratch.save(meetings(index, starts), "meetings")
    some = scratch.save(met.select("key").distinct(), "met-documents")
    others = scratch.save(lists(build(docs.join(small_side(some), "key", "left_semi"), terms)), "other-postings")
    # stored one after the other, so that the shuffles of neither wait for the end
    found = scratch.save(phrases(met, others, stored), "phrases")
    near = scratch.save(proximity(met, others, stored, found), "proximity")
    for name in ("meetings", "met-documents", "other-postings"):
        scratch.drop(name)
    return index, stored, found, near


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (the ids found, as strings, sorted), contaminated and n_near (items of which a window's words all stand near its rarest one), for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    index, stored, found, near = search(keyed(docs), items, scratch)
    of_window = small_side(stored.select("window_id", "items"))
    hits = found.join(of_window, "window_id").select("key", F.struct("begin", "len").alias("span"), "items")
    hits = hits.groupBy("key").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    near = near.select("key", "window_id").distinct().join(of_window, "window_id").groupBy("key").agg(F.flatten(F.collect_set("items")).alias("near"))
    near = near.select("key", F.size(F.array_distinct("near")).cast("bigint").alias("n_near"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))

    def cover(a: Column, s: Column) -> Column:
        end = s["begin"] + s["len"]
        more = F.greatest(end - F.greatest(a["end"], s["begin"]), F.lit(0))
        return F.struct((a["n"] + more.cast("bigint")).alias("n"), F.greatest(a["end"], end).alias("end"))

    hits = hits.select("key", F.aggregate("spans", zero, cover, lambda a: a["n"]).alias("n_hit"), F.array_sort(F.array_distinct(F.transform("items", lambda i: i.cast("string")))).alias("items"))
    rows = index.where(F.col("place") == 0).select("doc_id", "key", "n_words").join(hits, "key", "left").join(near, "key", "left")
    none = F.lit(0).cast("bigint")
    n_hit = F.coalesce("n_hit", none)
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", none).alias("n_near"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near",
    )


ORACLE = r"""
WITH b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, len(w[i:i + 12]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT n FROM q),
t AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT rid, i, t.n, item_id FROM t JOIN q ON t.g = q.g AND t.n = q.n),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
f AS (SELECT x AS term, count(*) AS n FROM (SELECT unnest(w) AS x FROM d) GROUP BY x),
v AS (SELECT g, any_value(string_split(g, ' ')) AS ts, list(item_id) AS items FROM q GROUP BY g),
r AS (SELECT g, ts, items, first(x.term ORDER BY coalesce(f.n, 0), x.term) AS rare FROM (SELECT g, ts, items, unnest(ts) AS term FROM v) x LEFT JOIN f ON x.term = f.term GROUP BY g, ts, items),
o AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS term FROM d),
m AS (SELECT DISTINCT o.rid, unnest(r.items) AS item_id FROM o JOIN r ON o.term = r.rare JOIN d ON d.rid = o.rid WHERE list_has_all(d.w[greatest(p - 12, 1):p + 12], r.ts)),
e AS (SELECT rid, count(DISTINCT item_id) AS n_near FROM m GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN k ON d.rid = k.rid LEFT JOIN e ON d.rid = e.rid
"""
