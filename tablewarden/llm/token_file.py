"""Token ids as files of patched frame-of-reference blocks.

A file is a table of chunks, written and committed by Spark. A chunk holds whole documents in order;
its payload is a run of blocks of 256 ids. Of each block the minimum is subtracted, the rest is packed
at the width that holds a percentile of the values, and values that do not fit are kept apart with
their places. The payload starts with an index of where each block starts.

Payload, all little-endian: ids u4, blocks u4; minimum u4 per block; width u1 per block; exceptions
u2 per block; start u4 per block; packed bits; places u1 and values u4 of all exceptions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.encode import encoder, encoding
from tablewarden.llm.store import ROW_GROUP_BYTES, lean, partition_offsets
from tablewarden.llm.words import slices
from tablewarden.session import scratch_path

BLOCK = 256
PERCENTILE = 95
CHUNK_IDS = 1 << 16

CHUNKS = (
    "part int, chunk int, start bigint, tokens bigint, doc_ids array<bigint>, sizes array<bigint>, payload binary"
)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The payload of a run of ids below 2**32."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = np.array([n, blocks], "<u4").tobytes()
    if not n:
        return head
    table = np.full(blocks * BLOCK, ids[-1], np.uint32)
    table[:n] = ids
    table = table.reshape(blocks, BLOCK)
    low = table.min(axis=1)
    rest = table - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    fits = np.partition(rest, rank, axis=1)[:, rank]
    width = np.zeros(blocks, np.uint8)
    for bit in range(32):
        width += (fits >> np.uint32(bit) > 0).astype(np.uint8)
    outside = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.cumsum(size) - size
    packed = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        bits = (rest[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
        coded = np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        packed[(start[rows][:, None] + np.arange(coded.shape[1])).ravel()] = coded.ravel()
    parts = [
        low.astype("<u4"),
        width,
        outside.sum(axis=1).astype("<u2"),
        start.astype("<u4"),
        packed,
        np.nonzero(outside)[1].astype(np.uint8),
        rest[outside].astype("<u4"),
    ]
    return head + b"".join(p.tobytes() for p in parts)


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first:last, found by the index; all of them by default."""
    n, blocks = np.frombuffer(payload, "<u4", 2).tolist()
    if not n:
        return np.zeros(0, np.uint32)
    at = 8

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(payload, kind, count, at)
        at += found.nbytes
        return found

    low, width, odd, start = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u4", blocks)
    packed = take("u1", int(width.astype(np.int64).sum()) * (BLOCK // 8))
    places, values = take("u1", int(odd.sum())), take("<u4", int(odd.sum()))
    last = blocks if last is None else min(last, blocks)
    rest = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[first:last]).tolist():
        rows = np.flatnonzero(width[first:last] == w)
        if w:
            where = start[first:last][rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)
            bits = np.unpackbits(packed[where], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            found = np.zeros((len(rows), BLOCK), np.uint32)
            for bit in range(w):
                found |= bits[:, :, bit].astype(np.uint32) << np.uint32(bit)
            rest[rows] = found
    ends = np.cumsum(odd)
    a, b = (int(ends[first - 1]) if first else 0), (int(ends[last - 1]) if last else 0)
    rest[np.repeat(np.arange(last - first), odd[first:last]), places[a:b]] = values[a:b]
    whole = (rest + low[first:last, None]).ravel()
    return whole[: n - first * BLOCK]


def _chunks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    end = np.array([end_id], coder.dtype).tobytes()
    part = TaskContext.get().partitionId()
    start = chunk = held = 0
    doc_ids: list = []
    coded: list[bytes] = []
    unit = np.dtype(coder.dtype).itemsize

    def flush() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(coded), coder.dtype)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([chunk], pa.int32()),
                pa.array([start], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([[len(c) // unit for c in coded]], pa.list_(pa.int64())),
                pa.array([pack(ids)], pa.binary()),
            ],
            ["part", "chunk", "start", "tokens", "doc_ids", "sizes", "payload"],
        )

    for batch in batches:
        for part_of in slices(batch):
            ids_of_texts = coder.encode_many(part_of["text"].to_pylist())
            for doc_id, ids in zip(part_of["doc_id"].to_pylist(), ids_of_texts, strict=True):
                doc_ids.append(doc_id)
                coded.append(ids + end)
                held += len(coded[-1]) // unit
                if held >= CHUNK_IDS:
                    yield flush()
                    start, chunk, held, doc_ids, coded = start + held, chunk + 1, 0, [], []
    if doc_ids:
        yield flush()


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1) -> None:
    """Encode every whole text, append ``end_id`` and write the chunks in ascending doc_id order.

    Texts are range-partitioned by doc_id before they are encoded, so the sampling of bounds encodes
    nothing. A null text is empty, a null doc_id comes first; rows of one doc_id are ordered by text.
    """
    (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(lambda batches: encoding(_chunks(batches, tokenizer_path, end_id), encoder(tokenizer_path)), CHUNKS)
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(folder)
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = unpack(row["payload"])
            sizes = np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            crcs = [zlib.crc32(ids[e - s : e].astype("<u4").tobytes()) for s, e in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + row["_offset"] + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(spark, folder: str) -> DataFrame:
    """Per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``."""
    chunks = spark.read.schema(CHUNKS).parquet(folder)
    offsets = F.broadcast(partition_offsets(chunks, "part", "tokens"))
    return chunks.join(offsets, "part").mapInArrow(
        lambda batches: lean(_digests(batches)), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the token files of ``docs`` to a new shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, folder, end_id)
    return read_digests(docs.sparkSession, folder)
