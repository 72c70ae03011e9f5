"""Packing by concatenation and cutting.

Every partition writes its documents' ids with their places inside the partition. Prefix sums over
the partition totals turn these into places in one long stream, which fixed windows cut: a window is a
sequence, and a document that crosses a window's edge gets one record per window.
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
from tablewarden.llm.store import keep, lean, partition_offsets, small_batches

WINDOW = 1024
BATCH_IDS = 1 << 18

ENCODED = "part int, start bigint, doc_id bigint, tokens bigint, ids binary"
PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    end = np.array([end_id], coder.dtype).tobytes()
    unit = np.dtype(coder.dtype).itemsize
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        doc_ids, texts = batch["doc_id"].to_pylist(), batch["text"]
        at = 0
        while at < len(doc_ids):
            begin, coded, held = at, [], 0
            while at < len(doc_ids) and held < BATCH_IDS:
                coded.append(coder.encode(texts[at].as_py()) + end)
                held += len(coded[-1]) // unit
                at += 1
            sizes = np.array([len(c) // unit for c in coded], np.int64)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(coded), part, np.int32)),
                    pa.array(start + ends - sizes),
                    pa.array(doc_ids[begin:at], pa.int64()),
                    pa.array(sizes),
                    pa.array(coded, pa.binary()),
                ],
                ["part", "start", "doc_id", "tokens", "ids"],
            )
            start += held


def _cut(batches: Iterator[pa.RecordBatch], window: int, kind: str) -> Iterator[pa.RecordBatch]:
    unit = np.dtype(kind).itemsize
    for batch in batches:
        sizes = batch["tokens"].to_numpy()
        places = batch["start"].to_numpy() + batch["_offset"].to_numpy()
        first, last = places // window, (places + sizes - 1) // window
        each = last - first + 1
        row = np.repeat(np.arange(len(sizes)), each)
        sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        begin = np.maximum(sequence * window, places[row])
        stop = np.minimum((sequence + 1) * window, places[row] + sizes[row])
        start = begin - places[row]
        ids = batch["ids"].to_pylist()
        pieces = [
            np.frombuffer(ids[r], kind, n, s * unit).astype("<u4").tobytes()
            for r, s, n in zip(row.tolist(), start.tolist(), (stop - begin).tolist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"].take(pa.array(row)),
                pa.array(start),
                pa.array(stop - begin),
                pa.array(sizes[row]),
                pa.array(sequence),
                pa.array(begin - sequence * window),
                pa.array(pieces, pa.binary()),
            ],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    A null text is empty and gives its end id alone; repeated rows are packed once each. The stream's
    order is that of the written partitions. Nothing is shuffled but one total per partition.
    """
    encoded = keep(
        small_batches(docs).select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
        ).mapInArrow(lambda batches: encoding(_encoded(batches, tokenizer_path, end_id), encoder(tokenizer_path)), ENCODED),
        "packing-ids",
    )
    kind = encoder(tokenizer_path).dtype
    offsets = F.broadcast(partition_offsets(encoded, "part", "tokens"))
    return encoded.join(offsets, "part").mapInArrow(lambda batches: lean(_cut(batches, window, kind)), PIECES)


def _with_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = pa.array([zlib.crc32(x) for x in batch["ids"].to_pylist()], pa.int64())
        yield batch.drop_columns(["ids"]).append_column("ids_crc32", crcs)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    return pieces.mapInArrow(_with_crc, PIECES.replace("ids binary", "ids_crc32 bigint"))


def sequences(pieces: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """Padded sequences ``sequence_id, ids array<bigint>, tokens``; at most ``window`` ids meet.

    Only the last sequence can be short: it is padded to the window, except at a power of two.
    """

    def joined(batches):
        for table in batches:
            rows = sorted(table.to_pylist(), key=lambda r: r["offset"])
            ids = np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist()
            n = len(ids)
            padded = ids if n & (n - 1) == 0 else ids + [pad_id] * (window - n)
            yield pa.RecordBatch.from_pylist(
                [{"sequence_id": rows[0]["sequence_id"], "ids": padded, "tokens": n}]
            )

    def one(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(joined([table])))

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(
        one, "sequence_id bigint, ids array<bigint>, tokens bigint"
    )
