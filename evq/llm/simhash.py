"""Near-duplicate documents by SimHash and BK-trees.

Fingerprints of word shingles link at a small Hamming distance. Links are found
among distinct fingerprints only, so copies cost nothing. The distinct
fingerprints are dealt into shards: the 64 bits are cut into BLOCKS blocks, and
for every choice of RADIUS blocks a fingerprint goes to the shard of all those
that agree with it in the other blocks. Two fingerprints within the radius meet
in at least one shard, and as only the bits of the chosen blocks are free there,
no shard has more than 2 ** 14 fingerprints, whatever the data. Each shard gets
a BK-tree, whose children are keyed by the distance to their parent, and is
searched along the edges within the radius. The trees stay where their shard is
instead of being broadcast, as together they grow with the corpus. A shard
gives a spanning forest of its links, and components join them.

Defined cases: a null or empty text has the fingerprint zero, which links like
any other; repeated rows give a row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm.components import components
from evq.llm.scratch import Scratch, table

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCKS = 10


def _cuts() -> list[int]:
    """A mask for each block; the first ones are a bit wider."""
    width, wider = divmod(64, BLOCKS)
    masks, at = [], 0
    for i in range(BLOCKS):
        n = width + (i < wider)
        masks.append(((1 << n) - 1) << at)
        at += n
    return masks


_ONES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes the bits that are set in over half of them.

    Eight sums over words whose bytes each count one bit; as a byte holds 255,
    longer runs are summed in parts.
    """
    parts = -(-sizes // 255)
    run = np.repeat(np.cumsum(sizes) - sizes, parts)
    first = np.cumsum(parts) - parts
    starts = run + 255 * (np.arange(len(run)) - np.repeat(first, parts))
    counts = np.empty((len(starts), 64), np.int32)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, starts)
        counts[:, k::8] = sums.view(np.uint8).reshape(-1, 8)
    if len(starts) > len(sizes):
        counts = np.add.reduceat(counts, first, axis=0)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _hashes(text: str | None) -> list[int]:
    """Of each shingle, repeats included."""
    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(SHINGLE)))]


def fingerprint(text: str | None) -> int:
    """Unsigned; a bit is 1 if it is set in over half of the shingles' hashes."""
    hashes = np.array(_hashes(text), dtype=np.uint64)
    return int(majority(hashes, np.array([len(hashes)]))[0]) if len(hashes) else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.zeros(len(batch), np.uint64)
        rows: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for row, text in enumerate(batch.column(1)):
            if found := _hashes(text.as_py()):
                rows.append(row)
                held.append(np.array(found, dtype=np.uint64))
                size += len(found)
            if held and (size > 200_000 or row == len(batch) - 1):
                prints[rows] = majority(np.concatenate(held), np.array([len(x) for x in held]))
                rows, held, size = [], [], 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a bigint)."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


class BKTree:
    """Integers under the Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (x, {})
                return
            node = child

    def near(self, x: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                yield value
            for k in range(max(1, d - radius), d + radius + 1):
                if k in children:
                    todo.append(children[k])


def _forest(prints: list[int], first: dict[frozenset[int], int], shard: int, masks: list[int]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links that this shard is the first to see."""
    tree, parent = BKTree(), {x: x for x in prints}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in prints:
        for y in tree.near(x, RADIUS):
            diff = x ^ y
            if first[frozenset(i for i, m in enumerate(masks) if diff & m)] == shard and (a := root(x)) != (b := root(y)):
                parent[a] = b
                yield x, y
        tree.add(x)


def _linker():
    masks = _cuts()
    shards = list(combinations(range(BLOCKS), RADIUS))
    first: dict[frozenset[int], int] = {}
    for n in range(RADIUS + 1):
        for some in combinations(range(BLOCKS), n):
            first[frozenset(some)] = next(i for i, s in enumerate(shards) if set(some) <= set(s))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, key, fp), sorted by shard and key."""
        rest = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in _and_end(batches):
            if batch is not None:
                rest = [np.concatenate([a, b.to_numpy(zero_copy_only=False)]) for a, b in zip(rest, batch.columns)]
            shard, key, fp = rest
            if not len(fp):
                continue
            new = np.flatnonzero((shard[1:] != shard[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
            if batch is not None:  # the last group may go on in the next batch
                rest = [a[starts[-1] :] for a in rest]
                starts, ends = starts[:-1], ends[:-1]
            many = np.flatnonzero(ends - starts > 1)
            out = [e for i in many for e in _forest([int(x) & (1 << 64) - 1 for x in fp[starts[i] : ends[i]]], first, int(shard[starts[i]]), masks)]
            yield pa.RecordBatch.from_arrays([pa.array([_signed(e[k]) for e in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return link


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame) -> DataFrame:
    """src, dst: links between distinct fingerprints (column fp) that connect what all links connect."""
    masks = _cuts()
    keys = []
    for i, chosen in enumerate(combinations(range(BLOCKS), RADIUS)):
        fixed = (1 << 64) - 1
        for b in chosen:
            fixed &= ~masks[b]
        keys.append(F.struct(F.lit(i).alias("shard"), F.col("fp").bitwiseAND(F.lit(_signed(fixed))).alias("key")))
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.shard", "k.key", "fp")
    rows = rows.repartition("shard", "key").sortWithinPartitions("shard", "key")
    return rows.mapInArrow(_linker(), "src bigint, dst bigint")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the group) for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs), "fingerprints")
    prints = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    edges = scratch.save(links(prints.select("fp")), "links")
    parts = scratch.save(components(edges), "components")
    joined = prints.join(parts.withColumnRenamed("node", "fp"), "fp")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = scratch.save(joined.join(scratch.save(least, "least"), "component").select("fp", "component_id"), "linked")
    ids = prints.join(linked, "fp", "left").select(F.col("fp").alias("id_fp"), F.coalesce("component_id", "least").alias("component_id"))
    ids = scratch.save(ids, "ids")
    return rows.join(ids, F.col("fp") == F.col("id_fp")).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
