"""Texts and number columns as compressed bytes, so that shuffles and kept tables stay below the input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.store import keep, lean, small_batches

SLICE_BYTES = 1 << 20


def pack_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + bytes(pa.Codec("zstd").compress(data, asbytes=True))


def unpack_bytes(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(blob[8:], size, asbytes=True) if size else b""


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of one length; ``unpack_columns`` is given their types."""
    return pack_bytes(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack_columns(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = unpack_bytes(blob)
    n, at, found = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        found.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return found


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        coded = [pack_bytes(t.as_py().encode()) if t.is_valid else pack_bytes(b"") for t in batch["text"]]
        rows = np.arange(row, row + len(coded))
        row += len(coded)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), batch["doc_id"], pa.array(coded, pa.binary())], ["row", "doc_id", "blob"]
        )


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc_id, blob`` of all rows. ``row`` also tells repeated doc_ids apart."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(texts).mapInArrow(lambda batches: lean(_numbered(batches)), "row bigint, doc_id bigint, blob binary")


def numbered_texts(docs: DataFrame, label: str) -> DataFrame:
    """``numbered``, written once, so that rows keep their numbers."""
    return keep(numbered(docs), label)


def text_slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with a ``blob`` column, each with its texts and of about ``most`` bytes."""
    blobs = batch["blob"]
    start, held, texts = 0, 0, []
    for i, blob in enumerate(blobs):
        texts.append(unpack_bytes(blob.as_py()))
        held += len(texts[-1])
        if held >= most or i + 1 == len(blobs):
            yield batch.slice(start, len(texts)), pa.array(texts, pa.large_binary()).cast(pa.large_string())
            start, held, texts = i + 1, 0, []
