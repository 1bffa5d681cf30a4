"""Fuzzy line dedup: MinHash bands, edit similarity, components.

Lines are compared in ASCII lower case with single spaces; equal ones are one
from then on. They link if their edit similarity (1 - distance / length of the
longer) is SIMILAR or more. Candidates come from one-permutation MinHash over
the lines' grams of GRAM bytes, in any script: lines meet if both minima of one
of BANDS bands agree, and AGREE of the TESTS bytes of their sketches (minima of
other bins), and their lengths allow the similarity. That is no guarantee; the
README has the measured recall against edit similarity alone. Of each connected
group the occurrence with the smallest (doc_id, line number) stays.

Lines of under MIN_CHARS characters are no evidence of copying and always stay,
as do lines of ASCII punctuation alone. Lines are told apart by a 64-bit hash.

Defined cases: a null or empty text has no lines to remove; rows that share a
doc_id are one document; a document that loses all lines with words has a null
text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from os.path import commonprefix
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evq.llm import units
from evq.llm.components import components
from evq.llm.scratch import Scratch, table

SIMILAR = 0.8
MIN_CHARS = 20
#: ASCII letters in lower case, control characters but line ends as spaces.
FOLD = bytes(ord(chr(b).lower()) if 32 < b < 127 else 10 if b == 10 else 32 for b in range(128)) + bytes(range(128, 256))
#: Bytes of letters and digits; a line without any has no words.
_WORDY = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_BARE = bytes(np.flatnonzero(~_WORDY).tolist())
GRAM = 8
BANDS, ROWS = 16, 2
TESTS, AGREE = 7, 2
_BINS = BANDS * ROWS + TESTS
_KEYS = [f"key{k}" for k in range(BANDS)]
#: Steps of the logarithm of a length to one factor of SIMILAR.
_STEPS = 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def normal(line: str) -> bytes:
    """What is compared of a line; nothing if it has no words."""
    words = line.encode().translate(FOLD).split()
    return b" ".join(words) if b"".join(words).translate(None, _BARE) else b""


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def folded(values: np.ndarray, sizes: np.ndarray, by: np.uint64) -> np.ndarray:
    """A hash of each run of ``sizes`` values: a polynomial in ``by``, mixed with the size."""
    starts = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()), by, np.uint64))
    place = np.arange(len(values))
    place -= np.repeat(starts, sizes)
    terms = powers[place]
    terms *= values
    return mixed(np.add.reduceat(terms, starts) ^ (sizes.astype(np.uint64) * _A))


def _parsed(data: bytes, least: int = 0) -> tuple[np.ndarray, ...]:
    """Of the lines of folded bytes that have words and ``least`` characters: the normal bytes of all, each with a space behind, the sizes and hashes of their words, words and number of each line, and its characters."""
    chars = np.frombuffer(data + b"\n", np.uint8)
    inside = chars > 32
    edge = np.diff(np.concatenate([[False], inside]).view(np.int8), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    before = np.searchsorted(starts, np.flatnonzero(chars == 10))  # words before each line end
    counts = np.diff(before, prepend=0)
    number = np.flatnonzero(counts)
    counts = counts[number]
    first = np.cumsum(counts) - counts
    if len(counts):
        begin, end, length = starts[first], ends[first + counts - 1], np.add.reduceat(ends - starts, first)
        bare, tails = (np.diff(np.searchsorted(np.flatnonzero(x), [begin, end]), axis=0)[0] for x in (inside & ~_WORDY[chars], chars & 0xC0 == 0x80))
        keep = bare < length
        length += counts - 1 - tails
        keep &= length >= least
        stay = np.repeat(keep, counts)
        starts, ends, number, counts, length = starts[stay], ends[stay], number[keep], counts[keep], length[keep]
    if not len(counts):
        return tuple(np.empty(0, t) for t in (np.uint8, np.int64, np.uint64, np.int64, np.int64, np.int64))
    turn = np.zeros(len(chars) + 1, np.int8)
    turn[starts] += 1
    turn[ends + 1] -= 1
    flat = chars[np.cumsum(turn[:-1], dtype=np.int8).view(bool)]
    flat = np.where(flat > 32, flat, np.uint8(32))
    sizes = ends - starts
    words = folded(flat[flat > 32].astype(np.uint64) + np.uint64(1), sizes, _A)
    return flat, sizes, words, counts, number, length


def minima(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least hash of the grams of each line in each of _BINS bins; an empty bin has that of another, the same for the same grams. ASCII punctuation counts as space here."""
    flat = np.where(_WORDY[flat], flat, np.uint8(32))
    stay = (flat != 32) | np.concatenate([[False], flat[:-1] != 32])
    sizes = np.add.reduceat(stay, np.cumsum(sizes) - sizes, dtype=np.int64)
    flat = flat[stay]
    grams = np.ndarray(len(flat), "<u8", np.concatenate([flat, np.zeros(8, np.uint8)]).tobytes(), 0, (1,)) & np.uint64((1 << 8 * GRAM) - 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.arange(len(flat)) <= np.repeat(np.cumsum(sizes) - GRAM, sizes)
    short = np.flatnonzero(sizes < GRAM)  # their one gram is all they have
    at = (np.cumsum(sizes) - sizes)[short]
    grams[at] &= (np.uint64(1) << (8 * sizes[short]).astype(np.uint64)) - np.uint64(1)
    whole[at] = True
    found = mixed(grams[whole] * _A)
    place = found >> np.uint64(32)
    place *= np.uint64(_BINS)
    place >>= np.uint64(32)
    place = place.view(np.int64)
    place += row[whole] * _BINS
    out = np.full(len(sizes) * _BINS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(out, place, found.astype(np.uint32))
    full = np.zeros(len(out), bool)
    full[place] = True
    empty, turn = np.flatnonzero(~full), 0
    while len(empty):
        turn += 1
        tried = (mixed((empty % _BINS + _BINS * turn).astype(np.uint64) * _A) % np.uint64(_BINS)).astype(np.int64) + empty // _BINS * _BINS
        hit = full[tried]
        out[empty[hit]] = out[tried[hit]]
        empty = empty[~hit]
    return out.reshape(-1, _BINS)


def sketched(least: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BANDS keys of each line, and its sketch: TESTS bytes and above them a class of its length."""
    pairs = least[:, : BANDS * ROWS].astype(np.uint64)
    keys = mixed((pairs[:, ::ROWS] << np.uint64(32) | pairs[:, 1::ROWS]) * _A + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    sketch = np.minimum(255, np.log(length) / -np.log(SIMILAR) * _STEPS).astype(np.uint64)
    for k in range(TESTS):
        sketch = sketch << np.uint64(8) | (least[:, BANDS * ROWS + k] & np.uint32(255)).astype(np.uint64)
    return keys, sketch.view(np.int64)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of sketches may be similar lines."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    x = a ^ b
    for k in (4, 2, 1):
        x |= x >> np.uint64(k)
    apart = np.bitwise_count(x & np.uint64(0x01010101010101))
    top = np.uint64(56)
    return (apart <= TESTS - AGREE) & (np.abs((a >> top).view(np.int64) - (b >> top).view(np.int64)) <= _STEPS + 1)


def partnered(key: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which rows have a ``close`` one of the same key (sorted). Each row is held against others until it has one; keys of over PAIRS rows are split by the sketch."""
    out = np.zeros(len(key), bool)
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(bounds)
    end = np.repeat(bounds[1:], sizes)
    at, step = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= PAIRS), sizes)), 1
    while len(at := at[at + step < end[at]]):
        some = at[~(out[at] & out[at + step])]
        some = some[close(prints[some], prints[some + step])]
        out[some] = out[some + step] = True
        step += 1
    for i in np.flatnonzero(sizes > PAIRS):
        out[bounds[i] : bounds[i + 1]] = _split(prints[bounds[i] : bounds[i + 1]])
    return out


def _split(prints: np.ndarray) -> np.ndarray:
    """``partnered`` for the rows of one large key: under each two bytes of the sketch only those that agree in both are compared."""
    unique, back, counts = np.unique(prints, return_inverse=True, return_counts=True)
    out = counts > 1
    for first in range(TESTS):
        for second in range(first + 1, TESTS):
            if out.all():
                return out[back]
            cell = (unique >> np.int64(8 * first) & np.int64(255)) << np.int64(8) | (unique >> np.int64(8 * second) & np.int64(255))
            order = np.lexsort((unique, cell))
            cut = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
            end = np.repeat(np.append(cut[1:], len(order)), np.diff(np.append(cut, len(order))))
            at, step = np.arange(len(order)), 1
            while len(at := at[at + step < end[at]]):
                a, b = order[at], order[at + step]
                use = ~(out[a] & out[b])
                a, b = a[use], b[use]
                hit = close(unique[a], unique[b])
                out[a[hit]] = out[b[hit]] = True
                step += 1
    return out[back]


#: Lines whose keys are packed together, lines that a task knows again, and the first bucket of places.
_PACK, _SEEN, PLACES = 1 << 16, 1 << 20, 1 << 16


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, value: lines with their places as Arrow streams (bucket PLACES and above), and the keys of lines that the task has not seen yet, packed."""
    seen: set[int] = set()
    new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lines = 0

    def out(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=["bucket", "value"])

    def keyed() -> pa.RecordBatch:
        ids, prints, keys = (np.concatenate(x) for x in zip(*new))
        return out(list(units.packed(keys.ravel(), np.repeat(ids, BANDS), np.repeat(prints, BANDS))))

    def done(batch: pa.RecordBatch, rows: list[int], held: list[bytes]) -> list[tuple[int, bytes]]:
        nonlocal lines
        lines_of = np.array([x.count(b"\n") + 1 for x in held])
        begin = np.cumsum(lines_of) - lines_of
        flat, sizes, words, counts, line, length = _parsed(b"\n".join(held), MIN_CHARS)
        if not len(counts):
            return []
        text = np.searchsorted(begin, line, side="right") - 1
        ids = folded(words, counts, _C).view(np.int64)
        places = pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).take(pa.array(np.array(rows)[text])), pa.array((line - begin[text]).astype(np.int32))], names=["id", "doc_id", "no"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, places.schema) as stream:
            stream.write_batch(places)
        if len(seen) > _SEEN:
            seen.clear()
        unique, first = np.unique(ids, return_index=True)
        fresh = np.sort(first[[x not in seen for x in unique.tolist()]])
        seen.update(unique.tolist())
        if len(fresh):
            size = np.add.reduceat(sizes + 1, np.cumsum(counts) - counts)
            stay = np.zeros(len(counts), bool)
            stay[fresh] = True
            keys, prints = sketched(minima(flat[np.repeat(stay, size)], size[fresh]), length[fresh])
            new.append((ids[fresh], prints, keys))
            lines += len(fresh)
        return [(PLACES + (int(ids[0]) & 0xFFFF), sink.getvalue().to_pybytes())]

    for batch in batches:
        rows: list[int] = []
        held: list[bytes] = []
        size = 0
        for row, text in enumerate(batch.column(1)):
            if text := text.as_py():
                rows.append(row)
                held.append(text.encode().translate(FOLD))
                size += len(held[-1])
            if size > 1 << 20 or held and row + 1 == len(batch):
                yield out(done(batch, rows, held))
                rows, held, size = [], [], 0
                if lines > _PACK:
                    yield keyed()
                    new, lines = [], 0
    if lines:
        yield keyed()


def _met(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """key, id, print of the lines that meet, and id, doc_id, no of all lines, from what ``_occurrences`` gives, bucket by bucket."""
    names, buckets = ["key", "id", "print", "doc_id", "no"], units.Buckets(partnered)

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.nulls(len(columns[0]), kind), pa.nulls(len(columns[0]), pa.int32())], names=names)

    for batch in batches:
        for bucket, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket < PLACES:
                yield from map(out, buckets.add(bucket, value.as_buffer()))
                continue
            yield from map(out, buckets.rest())
            for found in pa.ipc.open_stream(value.as_buffer()):
                none = pa.nulls(len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([none, found.column(0), none, *found.columns[1:]], names=names)
    yield from map(out, buckets.rest())


def occurrences(docs: DataFrame) -> DataFrame:
    """key, id, print of the lines that are long enough and meet another (key is null in no row), and id, doc_id, no of every line that is long enough (key is null)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_occurrences, "bucket int, value binary")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    kind_of = to_arrow_type(docs.schema["doc_id"].dataType)
    return rows.mapInArrow(lambda batches: _met(batches, kind_of), f"key bigint, id bigint, print bigint, doc_id {kind}, no int")


#: Prints up to which all pairs of a key are compared at once.
PAIRS = 4096


#: Members of a chunk of a key; two of them are one task's work at most.
CHUNK = 512
#: Characters that must agree for an alignment to go on.
ANCHOR = 8


def distance(a: str, b: str) -> int:
    """Levenshtein's, by bit vectors as long as the shorter text."""
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    a, b = (a[: len(a) - tail], b[: len(b) - tail]) if tail else (a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # rows of the matrix that are one more, one less than the row above
    for c in b:
        x = at.get(c, 0) | down
        same = ((up + (x & up)) ^ up) | x
        more, less = down | (~(up | same) & full), up & same
        score += bool(more & top) - bool(less & top)
        more = (more << 1 | 1) & full
        up, down = (less << 1 & full) | (~(more | same) & full), more & same & full
    return score


def _at_most(a: str, b: str, limit: float) -> bool:
    """Whether a plain alignment shows that the distance is ``limit`` or less: behind each difference it goes on at the next place in ``b`` of ANCHOR characters of ``a``."""
    i = j = cost = 0
    while True:
        step = 64
        while step:
            if a[i : i + step] == b[j : j + step] and i + step <= len(a) and j + step <= len(b):
                i, j, step = i + step, j + step, step * 2
            else:
                step //= 2
        room = int(limit - cost)
        for skip in range(1, room + 1):
            if i + skip + ANCHOR > len(a):
                break
            k = b.find(a[i + skip : i + skip + ANCHOR], j, j + room + ANCHOR)
            if k >= 0:
                cost += max(skip, k - j)
                i, j = i + skip, k
                break
        else:
            return cost + max(len(a) - i, len(b) - j) <= limit
        if i + skip + ANCHOR > len(a):
            return cost + max(len(a) - i, len(b) - j) <= limit


def similar(a: str, b: str) -> bool:
    longer = max(len(a), len(b))
    limit = (1 - SIMILAR) * longer + 1e-9
    if abs(len(a) - len(b)) > limit:
        return False
    return _at_most(a, b, limit) or _bag(a, b) <= limit and distance(a, b) <= limit


def _bag(a: str, b: str) -> int:
    """No more than the distance: characters that one has and the other lacks."""
    return max(sum(max(0, x.count(c) - y.count(c)) for c in set(x)) for x, y in ((a, b), (b, a)))


def _counted(codes: np.ndarray, row: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """How often each row has codes of each of 2^bits bins."""
    place = (row << bits) + (codes.astype(np.uint64) * _A >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(place, minlength=rows << bits).reshape(rows, 1 << bits).astype(np.int32)


class Screen:
    """Many lines, of which pairs are held against each other, many at once.

    ``likely`` leaves out what can't be similar: an edit changes one character and two
    pairs of neighbours at most, and lines differ by no fewer edits than their
    counts of both (in bins) say. ``alike`` decides the rest, by the distances of
    many pairs at once, whatever groups they come from. ``may`` and ``within`` do the same for one line against others.
    """

    def __init__(self, contents: list[bytes]):
        self.strings = [x.decode() for x in contents]
        self.sizes = np.array([len(x) for x in self.strings], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.codes = np.frombuffer("".join(self.strings).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(contents)), self.sizes)
        inner = row[1:] == row[:-1]
        pairs = (self.codes[:-1].astype(np.uint64) << np.uint64(32) | self.codes[1:])[inner]
        self.counts = [(1, _counted(self.codes, row, len(contents), 6)), (2, _counted(pairs, row[1:][inner], len(contents), 8))]

    def limits(self, a: Any, b: np.ndarray) -> np.ndarray:
        return (1 - SIMILAR) * np.maximum(self.sizes[a], self.sizes[b]) + 1e-9

    def likely(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of lines may be similar."""
        limit = self.limits(a, b)
        out = np.abs(self.sizes[a] - self.sizes[b]) <= limit
        for each, found in self.counts:
            for some in _blocks(np.flatnonzero(out), 1024):
                apart = found[a[some]] - found[b[some]]
                whole, total = np.abs(apart).sum(axis=1), apart.sum(axis=1)  # what one has more is half of both
                out[some] = whole + np.abs(total) <= 2 * each * limit[some]
        return out

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of lines are similar; all may be by their sizes."""
        limits, longer = self.limits(a, b).astype(np.int64), np.maximum(self.sizes[a], self.sizes[b])
        out = np.zeros(len(a), bool)
        for k in np.flatnonzero(longer > _LONG):
            out[k] = _at_most(self.strings[a[k]], self.strings[b[k]], limits[k])
        order = np.flatnonzero(~out)
        order = order[np.argsort(longer[order], kind="stable")]
        while len(order):
            least = int(longer[order[0]])
            count = min(max(_ROOM // max(least, 1), _FEW), int(np.searchsorted(longer[order], least + least // 2 + 32, side="right")))
            block, order = order[:count], order[count:]
            if count < _FEW:
                out[block] = [distance(self.strings[a[k]], self.strings[b[k]]) <= limits[k] for k in block]
            else:
                out[block] = _near([self._text(k) for k in a[block]], [self._text(k) for k in b[block]], limits[block])
        return out

    def _text(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] - self.sizes[i] : self.ends[i]]

    def may(self, i: int, others: np.ndarray) -> np.ndarray:
        return self.likely(np.full(len(others), i), others)

    def within(self, i: int, others: np.ndarray) -> np.ndarray:
        return self.alike(np.full(len(others), i), others)


def _blocks(x: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for at in range(0, len(x), size):
        yield x[at : at + size]


#: Characters of pairs whose distances are found at once, and the number of pairs below which one by one is faster.
_ROOM, _FEW = 1 << 17, 12
#: Characters above which a plain alignment is tried first.
_LONG = 600
#: Antidiagonals between looks at which pairs are out of reach.
_LOOK = 48


def _near(firsts: list[np.ndarray], seconds: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """Which pairs of a first and a second text are at most so many edits apart.

    The matrices of all pairs are filled together, antidiagonal by antidiagonal, and
    only where a path within the limit can pass. Cells are named by their diagonal
    (place in the second text less place in the first); a cell's neighbours are then the
    diagonals beside it, and what stands in its own is the cell before it.
    """
    sizes = np.array([[len(x) for x in firsts], [len(x) for x in seconds]])
    alive = np.argsort(sizes.sum(axis=0), kind="stable")  # in the order in which they are done
    (n, m), limits = sizes[:, alive], limits[alive]
    ends, last = n + m, m - n
    out = np.zeros(len(firsts), bool)
    low, high = -int(((limits - last) // 2).max()), int(((limits + last) // 2).max())
    rows_a, rows_b = int(n.max()), int(m.max())
    top = max(int(x.max(initial=0)) for some in (firsts, seconds) for x in some)
    chars = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    back, grid = np.zeros((len(alive), rows_a), chars), np.ones((len(alive), rows_b), chars)
    for k, i in enumerate(alive):
        a, b = firsts[i], seconds[i]
        if np.array_equal(a[:16], b[:16]):  # pairs that differ at once are out of reach sooner
            a, b = a[::-1], b[::-1]
        back[k, rows_a - len(a) :], grid[k, : len(b)] = a[::-1], b
    back, grid = np.ascontiguousarray(back.T), np.ascontiguousarray(grid.T)
    kind = np.int16 if rows_a + rows_b + high - low < 30000 else np.int32
    # rows of one parity of the diagonal each, with a row out of reach at both ends
    base = low - 2 - (low % 2)  # an even diagonal below all
    count = (high - base) // 2 + 3
    diagonals = [base + odd + 2 * np.arange(count) for odd in (0, 1)]
    away = [np.abs(d[:, None] - last).astype(kind) for d in diagonals]
    far, due = np.iinfo(kind).max // 2, set(ends.tolist())
    rows = []
    for d in diagonals:
        start = np.where((d >= low) & (d <= high), np.abs(d), far).astype(kind)
        rows.append(np.repeat(start[:, None], len(alive), axis=1))
    for s in range(1, int(ends[-1]) + 1):
        odd = s & 1
        first = max(low, -(s - 2), s - 2 * rows_a)
        final = min(high, s - 2, 2 * rows_b - s)
        first += (first ^ s) & 1
        final -= (final ^ s) & 1
        if first <= final:
            at, size = (first - base - odd) // 2, (final - first) // 2 + 1
            here, beside = rows[odd][at : at + size], rows[1 - odd]
            under = at - 1 + odd  # row of the diagonal below the first
            i, j = (s - first) // 2, (s + first) // 2
            differ = grid[j - 1 : j - 1 + size] != back[rows_a - i : rows_a - i + size]
            step = np.minimum(beside[under : under + size], beside[under + 1 : under + 1 + size])
            step += 1
            here += differ
            np.minimum(here, step, out=here)
        if s in due:
            done = np.arange(*np.searchsorted(ends, (s, s + 1)))
            out[alive[done]] = rows[odd][(last[done] - base - odd) // 2, done] <= limits[done]
        if s % _LOOK == 0:
            least = np.minimum(*((r + x).min(axis=0) for r, x in zip(rows, away)))
            stay = (least <= limits) & (ends > s)
            if not stay.any():
                break
            if 4 * stay.sum() < 3 * len(stay):
                alive, ends, last, limits = alive[stay], ends[stay], last[stay], limits[stay]
                back, grid = np.ascontiguousarray(back[:, stay]), np.ascontiguousarray(grid[:, stay])
                rows, away = ([np.ascontiguousarray(r[:, stay]) for r in some] for some in (rows, away))
    return out


def linked(a: bytes, b: bytes) -> bool:
    return similar(a.decode(), b.decode())


def split(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """``rows`` (key, id, print and more) with a row for each AGREE bytes of the sketch, as ``close`` prints agree in so many."""
    byte = [F.shiftrightunsigned("print", 8 * k).bitwiseAND(F.lit(255)) for k in range(TESTS)]
    cells = [F.xxhash64("key", F.lit(" ".join(map(str, some))), *(byte[k] for k in some)) for some in combinations(range(TESTS), AGREE)]
    return rows.select("*", F.posexplode(F.array(*cells)).alias("nth", "cell"))


def owner(nth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of prints share the ``nth`` cell and none before it."""
    some = list(combinations(range(TESTS), AGREE))[nth]
    out, x = np.ones(len(a), bool), (a ^ b).view(np.uint64)
    for k in range(some[-1] + 1):
        out &= ((x >> np.uint64(8 * k) & np.uint64(255)) == 0) == (k in some)
    return out


def _contents(text: str, numbers: list[int]) -> list[bytes | None]:
    parts = text.split("\n")
    return [normal(parts[i]) if i < len(parts) else None for i in numbers]


def without_lines(text: str, numbers: set[int]) -> str | None:
    """``text`` without the lines of these numbers; None if no word is left."""
    left = [x for i, x in enumerate(text.split("\n")) if i not in numbers]
    return "\n".join(left) if any(x.split() for x in left) else None


def duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, no, keep_doc, keep_no, class_id: the lines to remove and the one that stays instead."""
    met = scratch.save(occurrences(docs), "met")
    found = met.where("key IS NULL").select("id", "doc_id", "no")
    members = met.where("key IS NOT NULL").groupBy("key", "id").agg(F.first("print").alias("print"))
    members = scratch.save(members, "members")
    # any occurrence of a line will do to fetch it, so that rows are hashed and not sorted
    first = found.join(members.select("id").distinct(), "id").groupBy("id").agg(F.first("doc_id").alias("doc_id"), F.first("no").alias("no"))
    texts = units.contents(docs, first, _contents, scratch)
    scratch.drop("wanted")
    edges = units.verified(members, texts, linked, scratch, split, close, Screen, owner, CHUNK)
    repeats = found.groupBy("id").count().where("count > 1").select("id")
    parts = components(edges).select(F.col("node").alias("id"), "component")
    kept = repeats.join(parts, "id", "full").select("id", F.coalesce("component", "id").alias("class_id"))
    rows = scratch.save(found.join(kept, "id").drop("id"), "repeated")
    for name in ("met", "members", "contents"):
        scratch.drop(name)
    least = rows.groupBy(F.col("class_id").alias("c")).agg(F.min(F.struct("doc_id", "no")).alias("keep"))
    rows = rows.join(scratch.save(least, "least"), F.col("class_id") == F.col("c"))
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("no") == F.col("keep.no"))
    return rows.where(~same).select("doc_id", "no", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.no").alias("keep_no"), "class_id")


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, its text without near-duplicate lines, and last how many it lost (units.REMOVED, with underscores if ``docs`` has that)."""
    scratch = Scratch(docs.sparkSession, "lines")
    return units.without(docs, duplicates(docs, scratch), scratch, without_lines)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col(units.REMOVED).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
