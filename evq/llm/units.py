"""Near-duplicate lines and paragraphs: what line and paragraph dedup share.

A unit is a part of a text; its number counts from 0. Equal units (after
normalising) share an id, and everything but the first and the last step works
on distinct units. Candidates are units that meet under a key. The members of a
key get their contents, and a spanning forest of the verified links comes out
of each key, so that a group of n variants gives n - 1 rows and not n * n.

Keys under which the same units meet are one from then on.

A key with more than CELL members (or what the caller says) is dealt into chunks. First each chunk is
compared with itself and with chunk 0, which joins variants of one text in work
that grows with their number. Where several groups are left and chunks that have
not met, members of a few chunks are compared chunk by chunk, those of many are
dealt once more, by what two of them must share to be similar (``split``), so
that members that only have something common in common don't meet. What is still large is compared chunk by chunk, so that no link is lost
and no task gathers more than two chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evq.llm.components import components
from evq.llm.scratch import Scratch

#: Members of a chunk.
CELL = 1024
#: Eighths of the rows at hand that are looked at as pairs before links are counted for the first time.
TRIES = 6
#: Rows and bytes of cells that are looked at together.
BULK, BULK_BYTES = 1 << 15, 1 << 24
#: Chunks up to which each pair of a key's chunks is compared, and the key is not split.
FEW = 16
#: Rows of one key that are held at once; a longer key passes without a look at its members.
HELD = 1 << 16
#: Buckets of keys that are dealt out together, as a shift of the key; rows of a bucket that are held at once.
_SHIFT, BUCKET = 64 - 12, 1 << 22
_HALF = np.uint64(32)
#: The column that tells how many units a document has lost; ``without`` adds underscores while the table has one of that name.
REMOVED = "__removed"


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def meeting(rows: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """key, id, print of the rows that meet another under their key; ``near`` tells which of the rows of sorted keys (numbers, prints) have a partner. The new keys are hashes of the ids that meet. Keys of over HELD rows are read as a stream and keep all their rows."""
    # a single sort column of 64 bits is sorted by its bytes, without looking at rows
    rows = rows.select("key", "id", "print").repartition("key").sortWithinPartitions("key")

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "id", "print"])

    def settled(columns: list[np.ndarray]) -> pa.RecordBatch:
        return out(_settled(*columns, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the last key, which may go on
        size, passing = 0, None  # rows held, and a long key whose rows pass
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if passing is not None and len(columns[0]):
                same = columns[0] == passing
                n = int(np.argmin(same)) if not same.all() else len(same)
                yield out([c[:n] for c in columns])
                columns = [c[n:] for c in columns]
                passing = passing if not len(columns[0]) else None
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut or held and held[0][0][0] != columns[0][0]:
                yield settled([np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns])])
                held, size = [], 0
            held.append([c[cut:] for c in columns])
            size += len(held[-1][0])
            if size > HELD:
                passing = held[0][0][0]
                yield out([np.concatenate(x) for x in zip(*held)])
                held, size = [], 0
        if held:
            yield settled([np.concatenate(x) for x in zip(*held)])

    met = rows.mapInArrow(run, "key bigint, id bigint, print bigint")
    return met.groupBy("key", "id").agg(F.first("print").alias("print"))


def _settled(key: np.ndarray, ids: np.ndarray, prints: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> list[np.ndarray]:
    """Of whole keys (sorted) the rows that meet another, under new keys."""
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    keep = np.bincount(group)[group] > 1
    if near is not None:
        some = np.flatnonzero(keep)
        keep[some] = near(group[some], prints[some])
    take = np.flatnonzero(keep)
    if not len(take):
        return [x[:0] for x in (key, ids, prints)]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group[take]) != 0]))
    mixed = _mixed(ids[take].view(np.uint64))
    # keys of much the same members mostly have the same least one, and with it the upper half of their names
    names = np.minimum.reduceat(mixed, starts) >> _HALF << _HALF | _mixed(np.add.reduceat(mixed, starts)) >> _HALF
    return [np.repeat(names, np.diff(np.append(starts, len(take)))).view(np.int64), ids[take], prints[take]]


def packed(key: np.ndarray, ids: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows by bucket, the highest bits of the key: many rows of a bucket are one value then, which is dealt out at the cost of one row."""
    order = np.argsort(key)
    rows = np.stack([key[order], ids[order], prints[order]])
    cuts = (np.flatnonzero(np.diff(rows[0] >> _SHIFT)) + 1).tolist()
    for at, end in zip([0, *cuts], [*cuts, len(order)]):
        yield int(rows[0][at] >> _SHIFT), rows[:, at:end].tobytes()


class Buckets:
    """As ``meeting``, of ``packed`` values that come bucket by bucket; rows that come twice count once.

    ``add`` and ``rest`` give key, id and print. Of a bucket that is too large to be held rows of keys of
    over HELD rows pass, and the others too if they are still too many.
    """

    def __init__(self, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None):
        self.near, self.held, self.size = near, [], 0
        self.last, self.all_pass, self.passing = None, False, np.empty(0, np.int64)

    def add(self, bucket: int, value: Any) -> Iterator[list[np.ndarray]]:
        if bucket != self.last:
            self.last, self.all_pass, self.passing = bucket, False, self.passing[:0]
            if self.size > BUCKET // 16:
                yield from self.rest()
        rows = np.frombuffer(value, np.int64).reshape(3, -1)
        if self.all_pass or len(self.passing):
            goes = self.all_pass | np.isin(rows[0], self.passing)
            yield list(rows[:, goes])
            rows = rows[:, ~goes]
        self.held.append(rows)
        self.size += rows.shape[1]
        if self.size > BUCKET:
            rows = np.concatenate(self.held, axis=1)
            here = rows[0] >> _SHIFT == bucket
            key, counts = np.unique(rows[0][here], return_counts=True)
            self.passing = np.concatenate([self.passing, key[counts > HELD]])
            goes = np.isin(rows[0], self.passing)
            if goes.sum() < BUCKET // 2:
                self.all_pass, goes = True, here
            yield list(rows[:, goes])
            self.held, self.size = [rows[:, ~goes]], int((~goes).sum())

    def rest(self) -> Iterator[list[np.ndarray]]:
        if not self.size:
            return
        key, ids, prints = np.concatenate(self.held, axis=1)
        self.held, self.size = [], 0
        order = np.argsort(key)
        again = np.diff(key[order]) == 0
        order = order[np.concatenate([[False], again]) | np.concatenate([again, [False]])]
        order = order[np.lexsort((ids[order], key[order]))]
        key, ids, prints = key[order], ids[order], prints[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        if len(key):
            yield _settled(key[first], ids[first], prints[first], self.near)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def forest(ids: list[int], contents: list[Any], similar: Callable[[Any, Any], bool], parts: list[int]) -> Iterator[tuple[int, int]]:
    """Verified links that connect what all verified links connect. A member is held against the others until one of each group is similar; those that share a part are one group from the start."""
    groups: dict[int, list[int]] = {}
    for i, part in enumerate(parts):
        groups.setdefault(part, []).append(i)
    made: list[list[int]] = []
    for some in groups.values():
        apart = []
        for group in made:
            hit = next(((i, j) for i in some for j in group if similar(contents[i], contents[j])), None)
            if hit is None:
                apart.append(group)
            else:
                yield ids[hit[0]], ids[hit[1]]
                some = some + group
        made = [*apart, some]


def sparse(cell: np.ndarray, ids: np.ndarray, contents: list[Any], parts: np.ndarray, prints: np.ndarray, close: Callable[[np.ndarray, np.ndarray], np.ndarray], key: np.ndarray, keys: tuple[np.ndarray, np.ndarray], nth: np.ndarray, owner: Callable[[int, np.ndarray, np.ndarray], np.ndarray], matrix: Callable[[list[Any]], Any], chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``forest``, of the links between members of a cell with ``close`` prints, for the rows of many cells (sorted) at once. The screen that ``matrix`` makes leaves those out that can't be similar and decides about many at once.

    Of a pair that meets under several keys (their numbers and who has them) only the least one looks at it, of the cells that a key is split into the one that ``owner`` says, and of the cells of chunks the one that has to: members of chunk 0 are guests among another chunk (nth -1), and once that is done only different chunks but the first are left (nth -2 and more).
    """
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    end = np.repeat(starts + sizes, sizes)
    guest = (chunk == 0) & (np.repeat(np.maximum.reduceat(chunk, starts), sizes) > 0)
    lesser = _lesser(np.repeat(np.arange(len(starts)), sizes), key, *keys)
    parent = np.unique(parts, return_index=True, return_inverse=True)
    parent = parent[1][parent[2]]  # a row for each part, whatever cells it is in
    _, first, line = np.unique(ids, return_index=True, return_inverse=True)
    root, screen = parent.copy(), matrix([contents[i] for i in first.tolist()])
    links: list[tuple[int, int]] = []

    def decide(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        use = root[a] != root[b]
        a, b = a[use], b[use]
        use = screen.likely(line[a], line[b])
        a, b = a[use], b[use]
        share = 1.0  # of the pairs looked at last that were similar
        while len(a):
            # most are similar, so that those of a forest leave little to look at; of what is seldom similar all are looked at together
            now = _tree(root[a], root[b], prints[a] ^ prints[b]) if share > 0.5 else np.ones(len(a), bool)
            hit = screen.alike(line[a[now]], line[b[now]])
            share = hit.mean()
            for i, j in zip(a[now][hit].tolist(), b[now][hit].tolist()):
                x, y = _top(parent, i), _top(parent, j)
                if x != y:
                    parent[x] = y
                    links.append((i, j))
            while not np.array_equal(further := parent[root], root):
                root = further
            use = ~now & (root[a] != root[b])
            a, b = a[use], b[use]

    held, size, room = [], 0, max(64, len(cell) * TRIES // 8)
    at, step = np.flatnonzero(end - np.arange(len(cell)) > 1), 1
    while len(at := at[at + step < end[at]]):
        a, b = at, at + step
        use = (root[a] != root[b]) & ~(guest[a] & guest[b])
        use &= (nth[a] == -1) | (chunk[a] != chunk[b]) & (chunk[a] != 0) & (chunk[b] != 0)
        a, b = a[use], b[use]
        use = close(prints[a], prints[b])
        a, b = a[use], b[use]
        use = np.ones(len(a), bool)
        for k in np.unique(nth[a]):
            if k >= 0:
                some = nth[a] == k
                use[some] = owner(int(k), prints[a[some]], prints[b[some]])
        a, b = a[use], b[use]
        if lesser.shape[1] and len(a):
            use = ~((lesser[a][:, :, None] == lesser[b][:, None, :]) & (lesser[a] >= 0)[:, :, None]).any(axis=(1, 2))
            a, b = a[use], b[use]
        held.append((a, b))
        size, step = size + len(a), step + 1
        if size >= room:
            decide(*map(np.concatenate, zip(*held)))
            held, size, room = [], 0, min(4 * room, 1 << 14)
    if held:
        decide(*map(np.concatenate, zip(*held)))
    if not links:
        return ids[:0], ids[:0]
    return tuple(ids[list(x)] for x in zip(*links))


def _tree(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which pairs make a spanning forest of all, taken in the order of how many bytes are apart."""
    x = apart.view(np.uint64)
    for k in (4, 2, 1):
        x = x | x >> np.uint64(k)
    out, parent = np.zeros(len(a), bool), {}
    for k in np.argsort(np.bitwise_count(x & np.uint64(0x0101010101010101)), kind="stable").tolist():
        ends = []
        for i in (int(a[k]), int(b[k])):
            while (up := parent.get(i, i)) != i:
                parent[i] = i = parent.get(up, up)
            ends.append(i)
        if ends[0] != ends[1]:
            parent[ends[0]] = ends[1]
            out[k] = True
    return out


def _top(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = int(parent[i])
    return i


def _lesser(cell: np.ndarray, key: np.ndarray, values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of each row the lesser keys that it shares with others of its cell, by numbers; -1 where it has no more."""
    use = values < key[row]
    values, row = values[use], row[use]
    order = np.lexsort((values, cell[row]))
    v, c = values[order], cell[row[order]]
    number = np.cumsum(np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])])) if len(v) else np.empty(0, np.int64)
    shared = np.bincount(number)[number] > 1 if len(v) else np.empty(0, bool)
    row, number = row[order][shared], number[shared]
    order = np.argsort(row, kind="stable")
    row, number = row[order], number[order]
    counts = np.bincount(row, minlength=len(cell))
    out = np.full((len(cell), int(counts.max(initial=0))), -1, np.int64)
    out[row, np.arange(len(row)) - (np.cumsum(counts) - counts)[row]] = number
    return out


def _bulks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole cells (sorted by the first column), as many together as BULK rows and bytes allow."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        cell = rows.column(0).to_numpy()
        cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        size = np.cumsum(np.fromiter((len(x.as_buffer()) for x in rows.column("content")), np.int64, len(rows)) + BULK_BYTES // BULK)
        at = 0
        for k in range(len(cuts)):
            if k + 1 == len(cuts) or size[cuts[k + 1] - 1] - (size[at - 1] if at else 0) > BULK_BYTES:
                yield rows.slice(at, int(cuts[k]) - at)
                at = int(cuts[k])
        held = [rows.slice(at)]
    yield from held


def _solved(rows: DataFrame, contents: DataFrame, similar, close, matrix, owner) -> DataFrame:
    """src, dst of the links in each cell of ``rows`` (cell, id, print, part, key, nth, chunk) between members of different parts; ``contents`` has id, content and keys."""
    rows = rows.join(contents, "id").select("cell", "id", "print", "part", "content", "key", "keys", "nth", "chunk")
    # the work of a cell grows faster than its bytes, by which adaptive execution would merge the partitions
    # keys of the same group are dealt to one task, where links of one count in the others
    deal = F.col("cell") if close is None else F.shiftright("cell", 32)
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), deal).sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, held = None, [], [], []

        def done() -> list[tuple[int, int]]:
            if matrix is not None and len(ids) > 32:
                return list(_spanning(ids, matrix(held), parts))
            return list(forest(ids, held, similar, parts))

        for batch in batches:
            edges = []
            for cell, unit, part, content in zip(*(batch.column(c).to_pylist() for c in ("cell", "id", "part", "content"))):
                if cell != at:
                    if len(ids) > 1:
                        edges += done()
                    at, ids, parts, held = cell, [], [], []
                ids.append(unit)
                parts.append(part)
                held.append(content)
            yield _edges(edges)
        if len(ids) > 1:
            yield _edges(done())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bulks(batches):
            cell, unit, found, part, key, number, chunk = (rows.column(c).to_numpy() for c in ("cell", "id", "print", "part", "key", "nth", "chunk"))
            keys = rows.column("keys")
            of = np.repeat(np.arange(len(rows)), keys.value_lengths().to_numpy())
            ends = sparse(cell, unit, rows.column("content").to_pylist(), part, found, close, key, (keys.flatten().to_numpy(), of), number, owner, matrix, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["src", "dst"])

    return rows.mapInArrow(run if close is None else together, "src bigint, dst bigint")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])


def _spanning(ids: list[int], linked: np.ndarray, parts: list[int]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links of a symmetric matrix."""
    waiting = np.ones(len(ids), bool)
    for i in range(len(ids)):
        todo = [i] if waiting[i] else []
        waiting[i] = False
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(linked[a] & waiting):
                waiting[b] = False
                todo.append(int(b))
                if parts[a] != parts[b]:
                    yield ids[a], ids[b]


def _chunks(rows: DataFrame, by: str, scratch: Scratch, name: str, cell: int) -> DataFrame:
    """``by`` and chunks: how many chunks its values with over ``cell`` rows are dealt into."""
    many = rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > cell)
    return scratch.save(many.select(by, F.ceil(F.col("n") / cell).cast("int").alias("chunks")), name)


def verified(members: DataFrame, contents: DataFrame, similar: Callable[[Any, Any], bool], scratch: Scratch, split: Callable[[DataFrame, DataFrame], DataFrame], close: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, matrix: Callable[[list[Any]], Any] | None = None, owner: Callable[[int, np.ndarray, np.ndarray], np.ndarray] | None = None, cell: int | None = None) -> DataFrame:
    """src, dst: verified links among the ``members`` (key, id, print) of each key; ``contents`` has id and the content that ``similar`` compares.

    ``matrix`` tells all similar pairs of many contents at once. With ``close``
    only members with close prints are compared, and ``matrix`` (needed then) makes a
    screen for ``sparse`` instead (``lines.Screen``). ``split`` adds a column cell
    (bigint) to rows of members, several rows for each, so that two that can be
    similar share one; with ``close`` also which of a row's cells each is (nth),
    and ``owner`` tells which is the first that two prints share.
    """
    cell = cell or CELL
    large = _chunks(members, "key", scratch, "large-keys", cell)
    if close is None:
        contents = contents.withColumn("keys", F.array().cast("array<bigint>"))
    else:
        contents = contents.join(members.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    cells = F.when(F.col("chunks").isNull(), F.array(F.col("key"))).otherwise(F.transform(F.when(chunk == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk)), lambda c: F.xxhash64(F.col("key"), c)))
    held = F.coalesce(chunk, F.lit(0)).alias("chunk")
    rows = members.join(large, "key", "left").select("id", "print", F.col("id").alias("part"), "key", F.lit(-1).alias("nth"), held, F.explode(cells).alias("cell"))
    links = scratch.save(_solved(rows, contents, similar, close, matrix, owner), "links")
    large = large.where("chunks > 2")  # chunks 0 and 1 are compared with each other and themselves
    if large.isEmpty():
        return links
    parts = scratch.save(components(links), "large-parts").select(F.col("node").alias("id"), "component")
    rows = members.join(large, "key").join(parts, "id", "left").select("key", "id", "print", held, "chunks", F.coalesce("component", "id").alias("part"))
    rows = scratch.save(rows, "large-members")
    several = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    rows = rows.join(scratch.save(several, "several-parts"), "key")
    few = F.lit(close is not None) & (F.col("chunks") <= FEW)
    # of a few chunks each pair is a cell, which costs fewer rows than a split
    mates = F.transform(F.sequence(F.lit(1), F.col("chunks") - 1), lambda c: F.xxhash64(F.col("key"), F.least(c, F.col("chunk")), F.greatest(c, F.col("chunk"))))
    mates = F.filter(mates, lambda c: c != F.xxhash64(F.col("key"), F.col("chunk"), F.col("chunk")))
    paired = rows.where(few & (F.col("chunk") > 0)).select("id", "print", "part", "key", F.lit(-2).alias("nth"), "chunk", F.explode(mates).alias("cell"))
    rows = split(rows.where(~few).drop("chunks"), contents.select("id", "content")).select("id", "print", "part", "key", "nth", "chunk", "cell").distinct()
    rows = scratch.save(rows, "split-members")
    large = _chunks(rows, "cell", scratch, "large-cells", cell)
    # each pair of chunks is a cell of its own
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    mates = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.xxhash64(F.col("cell"), F.least(c, chunk), F.greatest(c, chunk)))
    cells = F.when(F.col("chunks").isNull(), F.array(F.col("cell"))).otherwise(mates)
    rows = rows.join(large, "cell", "left").select("id", "print", "part", "key", "nth", "chunk", F.explode(cells).alias("cell"))
    return links.union(scratch.save(_solved(rows.union(paired), contents, similar, close, matrix, owner), "large-links"))


def contents(docs: DataFrame, first: DataFrame, content: Callable[[str, list[int]], list[bytes | None]], scratch: Scratch, by_text: bool = False) -> DataFrame:
    """id, content of the units that stand first at ``first`` (id, doc_id, no); with ``by_text`` also text_id, xxhash64 of the text. ``content`` gives the contents of the numbers of a text; None where it has no such unit."""
    wanted = first.groupBy(F.col("doc_id").alias("w_doc"), (F.col("text_id") if by_text else F.lit(0)).alias("w_text")).agg(F.collect_list(F.struct("no", "id")).alias("units"))
    wanted = scratch.save(wanted, "wanted").hint("shuffle_hash")
    on = F.col("doc_id").eqNullSafe(F.col("w_doc"))
    rows = docs.select("doc_id", "text").join(wanted, on & F.xxhash64("text").eqNullSafe(F.col("w_text")) if by_text else on).select("text", "units")

    def made(ids: list[int], found: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["id", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, size = [], [], 0
            for text, units in zip(batch.column(0), batch.column(1).to_pylist()):
                for u, x in zip(units, content(text.as_py() or "", [u["no"] for u in units])):
                    if x is not None:
                        ids.append(u["id"])
                        found.append(x)
                        size += len(x)
                if size > 1 << 22:
                    yield made(ids, found)
                    ids, found, size = [], [], 0
            yield made(ids, found)

    # a document that stands twice gives its units twice
    return scratch.save(rows.mapInArrow(run, "id bigint, content binary"), "contents").dropDuplicates(["id"])


def classes(distinct: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, class_id, low, high, size: for every id that occurs twice or is linked, the least and the greatest place of its group and how many occurrences there are.

    ``distinct`` has id, n, low and high (any type that has an order). An unlinked id is its own class.
    """
    parts = scratch.save(components(links), "parts")
    linked = distinct.join(parts.withColumnRenamed("node", "id"), "id", "left")
    linked = linked.where((F.col("n") > 1) | F.col("component").isNotNull()).select("id", "n", "low", "high", F.coalesce("component", "id").alias("class_id"))
    linked = scratch.save(linked, "linked")
    least = scratch.save(linked.groupBy(F.col("class_id").alias("c")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("size")), "classes")
    return scratch.save(linked.select("id", "class_id").join(least, F.col("class_id") == F.col("c")).drop("c"), "keepers")


def without(docs: DataFrame, removed: DataFrame, scratch: Scratch, cut: Callable[[str, set[int]], str | None], by_text: bool = False) -> DataFrame:
    """All columns of ``docs``, its text as ``cut`` leaves it without the ``removed`` units (doc_id, no; with ``by_text`` also text_id), and as the last column, REMOVED or ``fresh``, how many it has lost."""
    key, lost, count = (fresh(docs.columns, x) for x in ("__gone_key", "__gone", REMOVED))
    ids = ["doc_id", "text_id"] if by_text else ["doc_id"]
    gone = removed.groupBy(F.struct(*ids).alias(key)).agg(F.collect_set("no").alias(lost))
    gone = scratch.save(gone, "gone").hint("shuffle_hash")
    texts: list[Column] = [docs["doc_id"], F.xxhash64(docs["text"])][: len(ids)]
    on = [a.eqNullSafe(gone[key][x]) for a, x in zip(texts, ids)]
    rows = docs.join(gone, on[0] & on[1] if by_text else on[0], "left").select(*(docs[c] for c in docs.columns), lost)
    at, names = docs.columns.index("text"), [*docs.columns, count]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, numbers in zip(batch.column(at), batch.column(len(names) - 1)):
                text, numbers = text.as_py(), set(numbers.as_py() or ())
                texts.append(cut(text, numbers) if numbers and text is not None else text)
                counts.append(len(numbers))
            columns = list(batch.columns[: len(names) - 1])
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=names)

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(count, T.LongType())]))
