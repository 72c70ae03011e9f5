"""Byte-level BPE over whole texts by overlapping chunks.

A long text is cut into overlapping chunks. Each is pre-tokenized on its own, so the boundaries it finds
at its start may be out of step; where they agree with those of the chunk before, both are in step from
there on. The pieces between such places are encoded on their own, and a document's ids are the
pieces' ids in order. A text of one chunk is one piece. Where two chunks share no boundary in their
overlap, the whole document is encoded as one piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10

_CODERS: dict[tuple[str, str], tiktoken.Encoding] = {}


def coder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """One coder per worker process, rank file and pattern."""
    if (ranks_path, pattern) not in _CODERS:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _CODERS[ranks_path, pattern] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
    return _CODERS[ranks_path, pattern]


def _digest(ids: list[int], enc: tiktoken.Encoding) -> tuple[int, str, str]:
    written = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digest_batch(doc_ids: list, found: list[tuple[int, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array(columns[0], pa.int64()),
            pa.array(columns[1], pa.string()),
            pa.array(columns[2], pa.string()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _short(batches: Iterator[pa.RecordBatch], enc_of) -> Iterator[pa.RecordBatch]:
    enc = enc_of()
    for batch in batches:
        found = [_digest(enc.encode_ordinary(text.as_py()), enc) for text in batch["text"]]
        yield _digest_batch(batch["doc_id"].to_pylist(), found)


def _boundaries(pattern: regex.Pattern, text: str, start: int, last: bool) -> np.ndarray:
    """Where tokens end in ``text``, at places of the document. Only ends after a printing character
    count: a run of spaces is split by what follows it, so it must stay with that."""
    ends = [m.end() for m in pattern.finditer(text)]
    return np.array([start + e for e in ends if (last or e < len(text)) and not text[e - 1].isspace()], np.int64)


CHUNKS = "row bigint, doc_id bigint, i int, start bigint, own int, text string, head array<bigint>, tail array<bigint>"


def _cut(batches: Iterator[pa.RecordBatch], pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    compiled = regex.compile(pattern)
    for batch in batches:
        for row, doc_id, text in zip(
            batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True
        ):
            text = text.as_py()
            rows = []
            for i, start in enumerate(range(0, len(text), chunk)):
                part = text[start : start + chunk + overlap]
                after = start + chunk
                ends = _boundaries(compiled, part, start, start + len(part) >= len(text))
                rows.append(
                    {
                        "row": row,
                        "doc_id": doc_id,
                        "i": i,
                        "start": start,
                        "own": min(chunk, len(text) - start),
                        "text": part,
                        "head": ends[ends < start + overlap].tolist() if i else [],
                        "tail": ends[ends >= after].tolist(),
                    }
                )
            schema = pa.schema(
                [("row", pa.int64()), ("doc_id", pa.int64()), ("i", pa.int32()), ("start", pa.int64()),
                 ("own", pa.int32()), ("text", pa.string()), ("head", pa.list_(pa.int64())),
                 ("tail", pa.list_(pa.int64()))]
            )
            yield pa.RecordBatch.from_pylist(rows, schema)


def _encode_pieces(batches: Iterator[pa.RecordBatch], enc_of) -> Iterator[pa.RecordBatch]:
    enc = enc_of()
    for batch in batches:
        ids, texts = [], []
        for start, own, first, stop, text, whole in zip(
            *(batch[c].to_pylist() for c in ("start", "own", "first", "stop", "text", "whole")), strict=True
        ):
            if whole:
                ids.append(None)
                texts.append(text[:own])
            else:
                stop = len(text) if stop is None else stop - start
                ids.append(np.array(enc.encode_ordinary(text[first - start : stop]), "<u4").tobytes())
                texts.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch["row"], batch["doc_id"], batch["i"], pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
            ["row", "doc_id", "i", "ids", "text"],
        )


def _join_pieces(batches: Iterator[pa.RecordBatch], enc_of) -> Iterator[pa.RecordBatch]:
    enc = enc_of()
    for batch in batches:
        found = []
        for pieces in batch["pieces"].to_pylist():
            pieces = sorted(pieces, key=lambda p: p["i"])
            if pieces[0]["ids"] is None:
                ids = enc.encode_ordinary("".join(p["text"] for p in pieces))
            else:
                ids = np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist()
            found.append(_digest(ids, enc))
        yield _digest_batch(batch["doc_id"].to_pylist(), found)


def round_trips(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    A null text is empty and has no tokens; repeated rows give a row each. Other columns are not read.
    """

    def enc_of():
        return coder(ranks_path, pattern)

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    is_long = F.length("text") > chunk
    short = texts.filter(~is_long).mapInArrow(lambda b: _short(b, enc_of), DIGESTS)

    chunks = (
        texts.filter(is_long)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .mapInArrow(lambda b: _cut(b, pattern, chunk, overlap), CHUNKS)
    )
    in_doc = Window.partitionBy("row").orderBy("i")
    first = F.when(F.col("i") == 0, F.lit(0)).otherwise(
        F.array_min(F.array_intersect("head", F.lag("tail").over(in_doc)))
    )
    pieces = (
        chunks.select("row", "doc_id", "i", "start", "own", "text", first.cast("bigint").alias("first"))
        .select(
            "*",
            F.lead("first").over(in_doc).alias("stop"),
            F.max(F.col("first").isNull()).over(Window.partitionBy("row")).alias("whole"),
        )
        .mapInArrow(
            lambda b: _encode_pieces(b, enc_of), "row bigint, doc_id bigint, i int, ids binary, text string"
        )
    )
    joined = (
        pieces.groupBy("row", "doc_id")
        .agg(F.collect_list(F.struct("i", "ids", "text")).alias("pieces"))
        .mapInArrow(lambda b: _join_pieces(b, enc_of), DIGESTS)
    )
    return short.unionByName(joined)
