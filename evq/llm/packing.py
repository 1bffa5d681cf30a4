"""Packing of documents into token sequences along a Hilbert curve.

A document's vector is the mean of its tokens' rows of a fixed random matrix,
that is, a random projection of its hashed counts to DIMS dimensions. The vectors
are scaled by the corpus' means and deviations, every document gets the Hilbert
key of its cell, and documents are sorted by range along the curve. Laid end to
end in that order, with running sums over partitions and then within them, they
are cut at every multiple of the sequence length, so neighbours on the curve
share sequences and only the last sequence of all is short.

Tokens are made once and stored; ties on the curve (copies) are dealt by doc_id
and row, so that a large group of copies does not meet in one task.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm.scratch import Scratch, table

LENGTH = 2048
END = 1
DIMS = 4
#: Bits of the key per dimension.
BITS = 10
#: Cells reach so many deviations to either side of the mean.
REACH = 3.0


def vocabulary() -> str:
    """The installed tokenizer file of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids that ``tokenizers`` gives with the file at ``path``, without special tokens around them.

    A text that holds one of the file's added tokens goes through ``tokenizers``;
    the others through ``tiktoken``, which gives the same ids from the file's
    vocabulary several times as fast, as its merges are in the order of the ids.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        parsed = json.load(f)
    byte, added = _bytes_of(), [t["content"] for t in parsed["added_tokens"]]
    ranks = {bytes(byte[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in added}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError(f"{path}: ids of over 16 bits")
    fast, exact = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


@lru_cache(maxsize=1)
def _matrix(size: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(42).standard_normal((size, DIMS)).astype(np.float32)


def _tokens(path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, matrix, pack = encoder(path), _matrix(), zstandard.ZstdCompressor(level=1)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sizes, vectors, blobs = [], [], []
                for text in part.column(1):
                    ids = [*encode(text.as_py() or ""), END]
                    array = np.array(ids, dtype="<u2")
                    sizes.append(len(array))
                    vectors.append(matrix[array].mean(axis=0, dtype=np.float64) * np.sqrt(len(array)))
                    blobs.append(pack.compress(array.tobytes()))
                v = np.array(vectors)
                columns = [part.column(0), pa.array(np.arange(uid, uid + len(part))), pa.array(sizes, pa.int64()), *(pa.array(v[:, i]) for i in range(DIMS)), pa.array(blobs, pa.binary())]
                uid += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "n", *(f"x{i}" for i in range(DIMS)), "ids"])

    return run


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, uid (a number for each row), n, x0.. (the vector) and ids (zstd of 16-bit ids, END included)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, uid bigint, n bigint, {', '.join(f'x{i} double' for i in range(DIMS))}, ids binary"
    return docs.select("doc_id", "text").mapInArrow(_tokens(path or vocabulary(), pa.int64()), schema)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of points with integer coordinates below 2 ** bits; one row for each point."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of each level
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _keys(means: list[float], deviations: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.column_stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(DIMS)])
            z = (v - means) / deviations
            cells = np.clip((z + REACH) / (2 * REACH) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hilbert(cells))], names=["doc_id", "uid", "n", "key"])

    return run


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places within the partition, which is sorted along the curve."""
    task, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy(zero_copy_only=False)
        ends = total + np.cumsum(n)
        total = int(ends[-1]) if len(ends) else total
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - n), pa.array(np.full(len(n), task, np.int32)), batch.column(1)], names=["uid", "at", "part", "n"])


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(7)]
            take: list[int] = []
            for row, (n, at, blob) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))):
                ids = np.frombuffer(unpack.decompress(blob.as_py()), dtype="<u2").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    take.append(row)
                    for column, x in zip(out, (start, size, zlib.crc32(ids[start : start + size].tobytes()), n, sequence, offset)):
                        column.append(x)
                    start += size
            columns = [batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(x, pa.int64()) for x in out[:6])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.save(tokens(docs, path), "tokens")
    axes = [f"x{i}" for i in range(DIMS)]
    scale = rows.agg(*(F.avg(x).alias(f"m{x}") for x in axes), *(F.stddev_pop(x).alias(f"s{x}") for x in axes)).first()
    means, deviations = [scale[f"m{x}"] or 0.0 for x in axes], [scale[f"s{x}"] or 1.0 for x in axes]
    curve = rows.select("doc_id", "uid", "n", *axes).mapInArrow(_keys(means, deviations), f"doc_id {kind}, uid bigint, n bigint, key bigint")
    order = scratch.save(curve, "curve").repartitionByRange("key", "doc_id", "uid").sortWithinPartitions("key", "doc_id", "uid")
    placed = scratch.save(order.select("uid", "n").mapInArrow(_offsets, "uid bigint, at bigint, part int, n bigint"), "placed")
    # one row for each partition, whatever the number of documents
    sums = sorted((r["part"], r["total"]) for r in placed.groupBy("part").agg(F.sum("n").alias("total")).collect())
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    base = spark.createDataFrame(starts, "part int, base bigint")
    at = placed.join(F.broadcast(base), "part").select("uid", (F.col("at") + F.col("base")).alias("at"))
    joined = rows.select("doc_id", "uid", "n", "ids").join(at, "uid").select("doc_id", "n", "at", "ids")
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return joined.mapInArrow(_pieces(length), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
