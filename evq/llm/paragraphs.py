"""Repeated passages: paragraph MinHash bands, exact Jaccard, components.

Texts are cut into paragraphs where their words say so, at words whose next
three have the least hash of SPREAD words to either side, so that a passage is
cut alike wherever it stands and whatever line ends it has. The paragraphs of a
text make up all its words. Equal ones (words in ASCII lower case) are one from
then on. BANDS bands of ROWS minima over their shingles of SHINGLE words find a
pair at Jaccard similarity 0.8 with probability 0.987; pairs that share a band are
verified on their whole sets of shingles, and the classes are the connected
groups. A paragraph of fewer words than a shingle only equals its like.

A paragraph repeats if its class stands in two documents, and consecutive
repeating paragraphs of PASSAGE words or more are a passage; a common sentence
alone is none. Of each class the occurrence with the smallest (doc_id, text,
number) stays, and the others go where they are part of a passage. What repeats
within its own document alone is left to the quality rules.

Paragraphs are told apart by a 64-bit hash of their words.

Defined cases: a null or empty text has no paragraphs; rows that share doc_id
and text are one document; a document that loses all its words has a null text;
an empty table gives no rows; other columns are ignored by ``passages`` and kept
by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evq.llm import units
from evq.llm.lines import FOLD, folded, mixed
from evq.llm.scratch import Scratch, table
from evq.llm.suffix import window_least

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 6, 3
#: Words to either side that a cut is the least of.
SPREAD = 8
#: Words of consecutive repeating paragraphs that make a passage. A passage's words up to its first cut and behind its last are in no repeating paragraph (17 on average), so this is less than the 50 words that are looked for.
PASSAGE = 25
#: Bytes of text that are cut up at a time.
BLOCK = 1 << 20
SEED = 42
#: All white space and control characters as spaces.
_SPACED = FOLD[:10] + b" " + FOLD[11:]
_KEYS = [f"key{k}" for k in range(BANDS)]
_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX, _WORD, _UNIT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407), np.uint64(0xD6E8FEB86659FD93)


class Cut(NamedTuple):
    """The paragraphs of joined texts, in order."""

    text: np.ndarray  # the text that each stands in
    ids: np.ndarray
    n_words: np.ndarray
    begin: np.ndarray  # bytes from its first word to the end of its last one
    end: np.ndarray
    shingles: np.ndarray  # of all paragraphs, and how many each has
    sizes: np.ndarray


def spaced(text: str) -> bytes:
    return text.encode().translate(_SPACED)


def cut_up(data: bytes) -> Cut:
    """The paragraphs of texts with a line end between them."""
    chars = np.frombuffer(data + b"\n", np.uint8)
    inside = chars > 32
    edge = np.diff(np.concatenate([[False], inside]).view(np.int8), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    if not n:
        none = np.empty(0, np.int64)
        return Cut(none, none.view(np.uint64), none, none, none, none.view(np.uint64), none)
    words = folded(chars[inside].astype(np.uint64) + np.uint64(1), ends - starts, _WORD)
    counts = np.diff(np.searchsorted(starts, np.flatnonzero(chars == 10)), prepend=0)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    ahead = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    runs = words  # hashes of the words from each place on, first three and then SHINGLE of them
    new = place == 0
    for k in range(1, SHINGLE):
        runs = mixed(runs * _MIX + ahead[k : k + n])
        if k == 2:
            rim = np.full(SPREAD, np.iinfo(np.uint64).max, np.uint64)
            least = window_least(np.concatenate([rim, runs, rim]), 2 * SPREAD + 1)
            new |= (place >= SPREAD) & (place + SPREAD + 3 <= counts[text]) & (runs == least)
    first = np.flatnonzero(new)
    n_words = np.diff(np.append(first, n))
    ids = folded(words, n_words, _UNIT)
    left = np.repeat(n_words, n_words) - (np.arange(n) - np.repeat(first, n_words))  # words to the end of the paragraph
    short = n_words < SHINGLE
    runs[first[short]] = ids[short]
    use = left >= SHINGLE
    use[first[short]] = True
    return Cut(text[first], ids, n_words, starts[first], ends[first + n_words - 1], runs[use], np.maximum(n_words - (SHINGLE - 1), 1))


def bands(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The BANDS keys of each run of ``sizes`` shingles, one row for each."""
    keys = np.zeros((len(sizes), BANDS), np.uint64)
    if not len(sizes):
        return keys.view(np.int64)
    starts = np.cumsum(sizes) - sizes
    for band in range(BANDS):
        for row in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat(shingles * _TIMES[row] + _PLUS[row], starts)
            mix = (keys[:, band] ^ least) * _MIX
            keys[:, band] = mix ^ (mix >> np.uint64(32))
        keys[:, band] += np.uint64(band)  # bands don't meet
    return keys.view(np.int64)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[int] = []
        held: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            found = cut_up(b"\n".join(held))
            text = found.text
            of_text = np.bincount(text, minlength=len(held))
            no = np.arange(len(text)) - (np.cumsum(of_text) - of_text)[text]
            keys = bands(found.shingles, found.sizes)
            take = pa.array(np.array(rows)[text])
            columns = [pa.array(found.ids.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(no.astype(np.int32)), pa.array(found.n_words.astype(np.int32))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(keys[:, k]) for k in range(BANDS))], names=["id", "doc_id", "text_id", "no", "n_words", *_KEYS])

        for row, text in enumerate(batch.column(2)):
            if text := text.as_py():
                rows.append(row)
                held.append(spaced(text))
                size += len(held[-1])
                if size > BLOCK:
                    yield done()
                    rows, held, size = [], [], 0
        if held:
            yield done()


def occurrences(docs: DataFrame) -> DataFrame:
    """id, doc_id, text_id (xxhash64 of the text), no, n_words and the bands' keys of every paragraph."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(_occurrences, f"id bigint, doc_id {kind}, text_id bigint, no int, n_words int, {', '.join(f'{k} bigint' for k in _KEYS)}")


def _contents(text: str, numbers: list[int]) -> list[bytes | None]:
    found = cut_up(spaced(text))
    end = np.cumsum(found.sizes)
    return [np.unique(found.shingles[end[i] - found.sizes[i] : end[i]]).tobytes() if i < len(end) else None for i in numbers]


def similar(a: bytes, b: bytes) -> bool:
    """Jaccard similarity of two sorted sets of 64-bit hashes."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    small, large = sorted((len(a), len(b)))
    if small < SIMILAR * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (small + large - both) - 1e-9


def matrix(contents: list[bytes]) -> np.ndarray:
    """Which of the sets are ``similar``, all pairs at once."""
    sets = [np.frombuffer(x, np.uint64) for x in contents]
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = np.flatnonzero(counts > 1)
    number = np.full(len(counts), -1)
    number[shared] = np.arange(len(shared))
    at = number[column]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(shared), 4096):
        some = (at >= low) & (at < low + 4096)
        has = np.zeros((len(sets), min(4096, len(shared) - low)), np.float32)
        has[row[some], at[some] - low] = 1
        both += has @ has.T
    return both >= SIMILAR * (sizes[:, None] + sizes[None, :] - both) - 1e-3


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, id, content: a row for each shingle."""
    for whole in batches:
        for cut in range(0, len(whole), 4096):
            batch = whole.slice(cut, 4096)
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in sets])
            take = pa.array(np.repeat(np.arange(len(sets)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(sets).view(np.int64))], names=["key", "id", "shingle"])


def split(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """``rows`` (key, id and more) with a row for each cell: sets of a key that are similar share one of their rarest shingles there, as only a fifth of a set may be missing in the other."""
    shingles = rows.select("key", "id").join(contents, "id").select("key", "id", "content").mapInArrow(_exploded, "key bigint, id bigint, shingle bigint")
    counts = shingles.groupBy("key", "shingle").agg(F.count("*").alias("many"))
    order = shingles.join(counts, ["key", "shingle"]).groupBy("key", "id").agg(F.sort_array(F.collect_list(F.struct("many", "shingle"))).alias("order"))
    rare = F.slice("order", 1, F.floor(F.size("order") * (1 - SIMILAR) + 1e-9).cast("int") + 1)
    cells = order.select("key", "id", F.explode(rare["shingle"]).alias("shingle"))
    return rows.join(cells, ["key", "id"]).withColumns({"nth": F.lit(-1), "cell": F.xxhash64("key", "shingle")})


def passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_id, no, n_words, class_id, class_size (occurrences), keep_doc, keep_no and kept, for every paragraph of a passage."""
    found = scratch.save(occurrences(docs), "occurrences")
    document = F.xxhash64("doc_id", "text_id")
    # any occurrence of a paragraph will do to fetch it, so that rows are hashed and not sorted
    distinct = found.groupBy("id").agg((F.min(document) < F.max(document)).alias("two"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "text_id", "no", *_KEYS)))
    distinct = scratch.save(distinct, "distinct")
    banded = distinct.select("id", F.explode(F.array(*_KEYS)).alias("key"))
    members = scratch.save(units.meeting(banded.select("key", "id", F.lit(0).cast("bigint").alias("print"))), "members")
    first = members.select("id").distinct().join(distinct.select("id", "doc_id", "text_id", "no"), "id")
    sets = units.contents(docs, first, _contents, scratch, by_text=True)
    edges = units.verified(members, sets, similar, scratch, split, matrix=matrix)
    # what stands in two documents, and classes that do
    # an id that has two documents of its own stands for any two
    places = distinct.select("id", "n", F.when(F.col("two"), F.least(document, F.bitwise_not(document))).otherwise(document).alias("low"), F.when(F.col("two"), F.greatest(document, F.bitwise_not(document))).otherwise(document).alias("high"))
    kept = units.classes(places, edges, scratch).where("low <> high").select("id", "class_id", "size")
    rows = scratch.save(found.select("id", "doc_id", "text_id", "no", "n_words").join(kept, "id").drop("id"), "repeated")
    for name in ("occurrences", "distinct", "members", "contents"):
        scratch.drop(name)
    least = rows.groupBy(F.col("class_id").alias("c")).agg(F.min(F.struct("doc_id", "text_id", "no")).alias("keep"))
    least = scratch.save(least, "least")
    text = ["doc_id", "text_id"]
    rows = rows.repartition(*text).dropDuplicates([*text, "no"])
    rows = rows.withColumn("run", F.col("no") - F.row_number().over(W.partitionBy(*text).orderBy("no")))
    rows = rows.withColumn("words", F.sum("n_words").over(W.partitionBy(*text, "run"))).where(F.col("words") >= PASSAGE)
    rows = rows.join(least, F.col("class_id") == F.col("c"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_id") == F.col("keep.text_id")) & (F.col("no") == F.col("keep.no"))
    return rows.select(
        *text, "no", F.col("n_words").cast("bigint").alias("n_words"), "class_id", F.col("size").alias("class_size"),
        F.col("keep.doc_id").alias("keep_doc"), F.col("keep.no").alias("keep_no"), stays.alias("kept"),
    )


def without_units(text: str, numbers: set[int]) -> str | None:
    """``text`` without the paragraphs of these numbers, each up to the next one; None if no word is left."""
    data, found = text.encode(), cut_up(spaced(text))
    if len(numbers) == len(found.ids):
        return None
    ends = np.append(found.begin[1:], len(data)).tolist()
    stay = [data[a:b] for i, (a, b) in enumerate(zip(found.begin.tolist(), ends)) if i not in numbers]
    return b"".join([data[: found.begin[0]], *stay]).decode()


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, its text without repeated passages but for the occurrence that stays, and last how many paragraphs it lost (units.REMOVED, with underscores if ``docs`` has that)."""
    scratch = Scratch(docs.sparkSession, "paragraphs")
    removed = passages(docs, scratch).where(~F.col("kept"))
    return units.without(docs, removed, scratch, without_units, by_text=True)


def query_rows(docs: DataFrame) -> DataFrame:
    """A row for each paragraph of a repeated passage: where it stands, its class, which occurrence stays and whether it is that one."""
    rows = passages(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "paragraphs"))
    return rows.select("doc_id", F.col("no").alias("paragraph"), "n_words", "class_id", "class_size", F.col("keep_doc").alias("keep_doc_id"), F.col("keep_no").alias("keep_paragraph"), "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_rows(table(spark, sf_dir, "documents"))
