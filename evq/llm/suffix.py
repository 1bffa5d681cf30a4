"""Exact substring dedup by longest-previous-factor arrays of suffix buckets.

Whether a byte goes depends on strings of one length only (LENGTH bytes), so
suffixes need no order beyond their first LENGTH bytes (windows). The suffix
order is made bucket by bucket:

1. Winnowing picks, for every window, its smallest GRAM-byte gram as the anchor.
   Equal windows have equal anchors at equal distances (their lead), so the
   windows of one anchor make a bucket. Consecutive windows with one anchor make
   a range.
2. Ranges whose whole text and place around the anchor are equal are a class,
   which collapses to its first range: the windows of the others have an earlier
   match there. A bucket of one class needs no order; this is most of a corpus.
3. The first ranges of a bucket of up to CLASSES classes get a suffix array, by
   prefix multiplying of ranks from the bytes. The previous and next smaller
   positions in suffix order are the only places where the longest earlier match
   of a suffix can start; its length there is read off the ranks. That is the
   longest-previous-factor array, cut at LENGTH. A window with a later match
   only is the source of another one's factor.
4. A bucket of more classes is split by what its windows must share: those with
   leads in one band of WIDTHS have all but the band's width of bytes in common
   places, so they are dealt by those bytes. Sub-ranges that are now equal
   collapse like classes; buckets that are still large are split by the next
   width, and at width 1 a bucket is one string. So a passage that a third of all
   documents share is no single task's work, and no link is lost.

``keep="first"`` removes what has an earlier match and keeps the first copy;
``keep="none"`` removes every copy. Grams, classes and buckets are told apart by
64-bit hashes; within a bucket bytes are compared.

Defined cases: a null text is empty; a text of under LENGTH bytes loses
nothing; rows that share doc_id and text are copies of each other; an empty
table gives no rows; other columns are ignored. A very long text is searched in
pieces that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm.scratch import Scratch, table

LENGTH = 400
GRAM = 32
#: Classes up to which a bucket gets its suffix array from one task.
CLASSES = 1024
#: Bytes of buckets that get one suffix array together; ranks of 16 bits are joined by four.
JOINED = 60_000
#: Leads of the windows that stay together when a larger bucket is split, once and again.
WIDTHS = (64, 8, 1)
#: Bytes of text that are winnowed at a time, and bits that hold a place in them.
PIECE, PLACE = 1 << 21, 24

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _eights(data: np.ndarray) -> np.ndarray:
    """A name for the 8 bytes at each place; the last 7 places have none."""
    x = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _double(names: np.ndarray, size: int, step: int) -> np.ndarray:
    """Names of size + step bytes from names of size bytes: that at a place with that ``step`` bytes on."""
    x = names[: len(names) - step] * _B
    x += names[step:]
    x ^= x >> np.uint64(31)
    x *= _C
    x ^= x >> np.uint64(30)
    return x


def names(data: np.ndarray, length: int) -> np.ndarray:
    """A name for the ``length`` bytes (8 or more) at each place, by prefix doubling."""
    x, size = _eights(data), 8
    while size < length:
        step = min(size, length - size)
        x, size = _double(x, size, step), size + step
    return x


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima within blocks."""
    count = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts data[start:end] joined in ``data``: text, first and last window, anchor (places in ``data``) and the anchor's gram, for each range."""
    if len(data) < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    grams = names(data, GRAM)
    low = np.uint64((1 << PLACE) - 1)
    tagged = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (window_least(tagged, LENGTH - GRAM + 1) & low).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.arange(len(anchor))
    good = np.flatnonzero(at + LENGTH <= ends[text[: len(at)]]) if len(starts) else at[:0]
    if not len(good):
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    a, t = anchor[good], text[good]
    cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(t) != 0) | (np.diff(good) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(good)]]) - 1
    return t[first], good[first], good[last], a[first], grams[a[first]]


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Row, offset and bytes of pieces that are winnowed together."""
    rows, offsets, held, size = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            piece = text[at : at + PIECE + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            rows.append(row)
            offsets.append(at)
            held.append(piece)
            size += len(piece)
            if size >= PIECE // 2:
                yield rows, offsets, held
                rows, offsets, held, size = [], [], [], 0
    if held:
        yield rows, offsets, held


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for whole in batches:
        for cut in range(0, len(whole), 1024):
            batch = whole.slice(cut, 1024)
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            for rows, offsets, held in _pieces(texts):
                sizes = np.array([len(x) for x in held])
                joined = b"".join(held)
                starts = np.cumsum(sizes) - sizes
                text, first, last, anchor, gram = ranges(np.frombuffer(joined, np.uint8), starts, starts + sizes)
                # equal classes have equal text, and the anchor at an equal place in it
                classes = [digest(joined[s : e + LENGTH], a - s) for s, e, a in zip(first.tolist(), last.tolist(), anchor.tolist())]
                shift = np.array(offsets)[text] - starts[text]
                take = pa.array(np.array(rows)[text])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(gram.view(np.int64)), pa.array(np.array(classes, np.uint64).view(np.int64)),
                     pa.array(first + shift), pa.array(last + shift), pa.array(anchor + shift)],
                    names=["doc_id", "text_id", "bucket", "class", "first", "last", "anchor"],
                )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")


def anchors(docs: DataFrame) -> DataFrame:
    """A row for each range: doc_id, text_id, bucket (its anchor's gram), class, first and last window, anchor (bytes in the text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(_anchors, f"doc_id {kind}, text_id bigint, bucket bigint, class bigint, first bigint, last bigint, anchor bigint")


def _ranked(x: np.ndarray) -> np.ndarray:
    """The rank of each value among all."""
    order = np.argsort(x)
    ranks = np.empty(len(x), np.uint32)
    ranks[order] = np.cumsum(np.concatenate([[0], np.diff(x[order]) != 0]), dtype=np.uint32)
    return ranks


def suffix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """By prefix multiplying, the ranks of the strings of 8 bytes, of some lengths between and at last of ``length`` bytes (8 or more) at each place that has so many. As many ranks as fit 64 bits make the next one."""
    first = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,)).astype(np.uint64)
    found, bits = [(8, _ranked(first))], len(data).bit_length()
    while (size := found[-1][0]) < length:
        ranks, longer = found[-1][1], min(size * (64 // bits), length)
        count = len(data) - longer + 1
        joined = np.zeros(count, np.uint64)
        for at in [*range(0, longer - size, size), longer - size]:
            joined = joined << np.uint64(bits) | ranks[at : at + count]
        found.append((longer, _ranked(joined)))
    return found


def smaller(values: np.ndarray) -> np.ndarray:
    """For each value the index of the nearest smaller one to its left, or -1. A larger neighbour is passed by way of its own nearest one so far."""
    back = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while len(todo := todo[(back[todo] >= 0) & (values[back[todo]] >= values[todo])]):
        back[todo] = back[back[todo]]
    return back


def common(ranks: list[tuple[int, np.ndarray]], data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the strings at places a and b that have the length of the last ranks; at most that."""
    length, whole = ranks[-1]
    same, at = whole[a] == whole[b], np.zeros(len(a), np.int64)
    for (size, rank), (longer, _) in list(zip(ranks, ranks[1:]))[::-1]:
        for _ in range(-(-longer // size) - 1):
            fits = at <= length - size
            step = np.where(fits, at, 0)
            at += np.where(fits & (rank[a + step] == rank[b + step]), size, 0)
    step = np.minimum(at, length - 8)  # the last 8 bytes or less, byte by byte
    eights = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    apart = eights[a + step].astype(np.uint64) ^ eights[b + step].astype(np.uint64)
    tail = sum((apart < np.uint64(1) << np.uint64(8 * k)).astype(np.int64) for k in range(8))
    return np.where(same, length, np.maximum(at, step + tail))


def previous_factors(ranks: list[tuple[int, np.ndarray]], data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the suffixes at ``starts`` (ascending) the length of its longest match with an earlier one, cut at the length of the last ranks, and the number of that earlier one.

    In suffix order such a match starts at the previous or the next smaller
    position.
    """
    whole = ranks[-1][1]
    order = np.argsort(whole[starts], kind="stable")
    factors, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    for other in (smaller(order), len(order) - 1 - smaller(order[::-1])[::-1]):
        has = np.flatnonzero((other >= 0) & (other < len(order)))
        to = order[other[has]]
        has = order[has]
        match = common(ranks, data, starts[has], starts[to])
        better = match > factors[has]
        factors[has[better]], source[has[better]] = match[better], to[better]
    return factors, source


def _runs(flags: np.ndarray, group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (into the arrays) of runs of flagged neighbours of one group at consecutive places."""
    hit = np.flatnonzero(flags)
    if not len(hit):
        return hit, hit
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(group[hit]) != 0) | (np.diff(at[hit]) != 1)) + 1
    return hit[np.concatenate([[0], cut])], hit[np.concatenate([cut, [len(hit)]]) - 1]


def _windows(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the joined contexts: its context, its number there, and its place."""
    sizes = np.array([len(x) for x in contexts])
    counts = sizes - LENGTH + 1
    context = np.repeat(np.arange(len(contexts)), counts)
    nth = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    return context, nth, (np.cumsum(sizes) - sizes)[context] + nth


def _in_order(keep_first: bool):
    """Rows (bucket, context, doc_id, text_id, first), sorted by bucket and then by the rest in order: the stretches of windows with an earlier match, or with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # many buckets are put in order at once; one is never torn
                if size >= JOINED and rows[-1][0] != row[0]:
                    yield done(rows, batch.schema)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1])
        if rows:
            yield done(rows, batch.schema)

    def done(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        contexts = [r[1] for r in rows]
        context, nth, starts = _windows(contexts)
        data = np.frombuffer(b"".join(contexts), np.uint8)
        ranks = suffix_ranks(data, LENGTH)
        factors, source = previous_factors(ranks, data, starts)
        hit = factors == LENGTH
        if not keep_first:  # the first of equal windows is the source of the second
            hit[source[hit]] = True
        a, b = _runs(hit, context, nth)
        who = context[a]
        begin = np.array([r[4] for r in rows])[who] + nth[a]
        ids = [pa.array([r[k] for r in rows], schema.field(name).type).take(pa.array(who)) for k, name in ((2, "doc_id"), (3, "text_id"))]
        return pa.RecordBatch.from_arrays([*ids, pa.array(begin, pa.int64()), pa.array(begin + (b - a), pa.int64())], names=["doc_id", "text_id", "first", "last"])

    return run


def _split(width: int):
    """Rows (bucket, lead, context, doc_id, text_id, first): a row for each band of ``width`` leads, in the bucket of what all windows with such leads share."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, len(whole), 512):
                batch = whole.slice(cut, 512)
                take, out = [], []
                for row, (bucket, lead, context, first) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5)))):
                    least = lead - (len(context) - LENGTH)  # of its last window
                    for band in range(least // width, lead // width + 1):
                        low, high = max(least, band * width), min(lead, (band + 1) * width - 1)
                        part = context[lead - high : lead - low + LENGTH]
                        shared = context[lead - band * width : lead - (band + 1) * width + 1 + LENGTH] if width > 1 else part
                        key = digest(b"%d %d " % (bucket, band) + shared)
                        take.append(row)
                        out.append((key, digest(part, high), first + lead - high, first + lead - low, high, part))
                keys, names, firsts, lasts, leads, parts = zip(*out)
                where = pa.array(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(names, np.uint64).view(np.int64)), batch.column(3).take(where), batch.column(4).take(where),
                     pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), pa.array(leads, pa.int64()), pa.array(parts, pa.binary())],
                    names=["bucket", "class", "doc_id", "text_id", "first", "last", "lead", "context"],
                )

    return run


def _contexts(docs: DataFrame, first: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, lead, context, doc_id, text_id, first of the ranges ``first``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = first.groupBy(F.col("doc_id").alias("w_doc"), F.col("text_id").alias("w_text")).agg(F.collect_list(F.struct("bucket", "first", "last", "anchor")).alias("ranges"))
    wanted = scratch.save(wanted, "wanted").hint("shuffle_hash")
    # equal rows are one text here
    rows = _texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_id") == F.col("w_text"))).select("doc_id", "text_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = (batch.column(2)[i].as_py() or "").encode()
                found = batch.column(3)[i].as_py()
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["bucket"] for r in found], pa.int64()), pa.array([r["anchor"] - r["first"] for r in found], pa.int64()),
                     pa.array([data[r["first"] : r["last"] + LENGTH] for r in found], pa.binary()), batch.column(0).take(pa.array([i] * n)),
                     batch.column(1).take(pa.array([i] * n)), pa.array([r["first"] for r in found], pa.int64())],
                    names=["bucket", "lead", "context", "doc_id", "text_id", "first"],
                )

    found = rows.mapInArrow(run, f"bucket bigint, lead bigint, context binary, doc_id {kind}, text_id bigint, first bigint")
    return scratch.save(found.dropDuplicates(["doc_id", "text_id", "bucket", "first"]), "contexts")


def _collapsed(found: DataFrame, keep: str, scratch: Scratch, level: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The stretches that copies of a class make (doc_id, text_id, first, last), and of the buckets with several classes (how many: classes) each class's first range."""
    place = ["doc_id", "text_id", "first", "last"]
    least = F.min(F.struct(*place, *carry)).alias("least")
    classes = scratch.save(found.groupBy("bucket", "class").agg(F.count("*").alias("n"), least), f"classes-{level}")
    many = scratch.save(classes.where("n > 1").select(F.col("bucket").alias("b"), F.col("class").alias("c"), *(F.col(f"least.{x}").alias(f"least_{x}") for x in place)), f"many-{level}")
    copies = found.join(many, (F.col("bucket") == F.col("b")) & (F.col("class") == F.col("c")))
    if keep == "first":
        same = F.lit(True)
        for x in place:
            same = same & F.col(x).eqNullSafe(F.col(f"least_{x}"))
        copies = copies.where(~same)
    several = classes.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("classes")).where("classes > 1")
    several = scratch.save(several, f"several-{level}")
    first = classes.join(several, F.col("bucket") == F.col("b")).select("bucket", "classes", "least.*")
    return copies.select(*place), scratch.save(first, f"first-{level}")


def repeats(docs: DataFrame, keep: str, scratch: Scratch) -> DataFrame:
    """doc_id, text_id, first, last: stretches of windows to remove."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = scratch.save(anchors(docs), "anchors")
    marked, first = _collapsed(found, keep, scratch, 0, ["anchor"])
    scratch.drop("classes-0")
    large = scratch.save(first.where(F.col("classes") > CLASSES).select(F.col("bucket").alias("large")).distinct(), "large")
    rows = _contexts(docs, first, scratch).join(large, F.col("bucket") == F.col("large"), "left")
    columns = ["bucket", "lead", "context", "doc_id", "text_id", "first"]

    def ordered(rows: DataFrame) -> DataFrame:
        rows = rows.select("bucket", "context", "doc_id", "text_id", "first").repartition("bucket").sortWithinPartitions("bucket", "doc_id", "text_id", "first")
        return rows.mapInArrow(_in_order(keep == "first"), f"doc_id {kind}, text_id bigint, first bigint, last bigint")

    marked = marked.unionByName(ordered(rows.where("large IS NULL")))
    rows, schema = rows.where("large IS NOT NULL").select(*columns), f"bucket bigint, class bigint, doc_id {kind}, text_id bigint, first bigint, last bigint, lead bigint, context binary"
    for level, width in enumerate(WIDTHS, 1):
        if rows.isEmpty():
            break
        part = scratch.save(rows.mapInArrow(_split(width), schema), f"split-{level}")
        copies, first = _collapsed(part, keep, scratch, level, ["lead", "context"])
        marked = marked.unionByName(copies).unionByName(ordered(first.where(F.col("classes") <= CLASSES)))
        rows = first.where(F.col("classes") > CLASSES).select(*columns)
    return marked


def remove(docs: DataFrame, keep: str = "first") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "suffix")
    gone = repeats(docs, keep, scratch).groupBy(F.col("doc_id").alias("g_doc"), F.col("text_id").alias("g_text"))
    gone = scratch.save(gone.agg(F.collect_set(F.struct("first", "last")).alias("gone")), "gone").hint("shuffle_hash")
    rows = _texts(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("text_id") == F.col("g_text")), "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, stretches in zip(batch.column(1), batch.column(2)):
                data, kept, at, end, spans = (text.as_py() or "").encode(), [], 0, 0, 0
                for first, last in sorted((s["first"], s["last"] + LENGTH) for s in stretches.as_py() or ()):
                    if first > end or not spans:
                        kept.append(data[at:first])
                        spans += 1
                    end = max(end, last)
                    at = end
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((len(data), len(data) - len(left), spans, left))
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([x[3] for x in out], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove(table(spark, sf_dir, "documents"), keep="none")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"))
