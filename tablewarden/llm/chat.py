"""Chat formatting at token level.

A turn is written ``<s>[INST] role [/INST]text</s>``. Its role and text are encoded on their own and
reserved ids, past the tokenizer's, stand for the template's marks, so no text can produce a mark's
id. In case the ids are spelled out again, control strings inside a text are escaped reversibly as well.
Places of a conversation's turns, and of the loss mask over assistant texts, are prefix sums of the
turns' lengths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.encode import TextEncoder, encoder

ESCAPE = "␛"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
MARKS = ("<s>[INST] ", " [/INST]", "</s>")

_ESCAPED = {ESCAPE: ESCAPE + "0"} | {c: f"{ESCAPE}{i}" for i, c in enumerate(CONTROLS, 1)}
_PLAIN = {v: k for k, v in _ESCAPED.items()}
_TO_ESCAPE = re.compile("|".join(map(re.escape, _ESCAPED)))
_TO_PLAIN = re.compile(f"{ESCAPE}[0-{len(CONTROLS)}]")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return _TO_PLAIN.sub(lambda m: _PLAIN[m[0]], text)


TURNS = "conv_id bigint, turn bigint, ids binary, text_at bigint, text_ids bigint, loss boolean"


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Each turn alone: mark, role, mark, text, mark."""
    coder = encoder(path, spell_special=True)
    base = coder.tokenizer.get_vocab_size()
    opens, says, ends = (np.array([base + i], "<u4").tobytes() for i in range(len(MARKS)))

    def ids_of(text: str) -> bytes:
        return np.frombuffer(coder.encode(escape(text)), coder.dtype).astype("<u4").tobytes()

    for batch in batches:
        ids, at, sizes = [], [], []
        for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            head = opens + ids_of(role or "") + says
            body = ids_of(text or "")
            ids.append(head + body + ends)
            at.append(len(head) // 4)
            sizes.append(len(body) // 4)
        loss = pa.compute.fill_null(pa.compute.equal(batch["role"], "assistant"), False)
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["turn"], pa.array(ids, pa.binary()), pa.array(at, pa.int64()),
             pa.array(sizes, pa.int64()), loss],
            ["conv_id", "turn", "ids", "text_at", "text_ids", "loss"],
        )


FORMATTED = "conv_id bigint, turn_no bigint, start bigint, ids binary, loss_start bigint, loss_end bigint"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix sums along each conversation, whose turns arrive in order. Nothing is held but one sum."""
    current, seen, place, turn_no = None, False, 0, 0
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if not seen or row["conv_id"] != current:
                current, seen, place, turn_no = row["conv_id"], True, 0, 0
            start = place + row["text_at"]
            rows.append(
                {
                    "conv_id": current,
                    "turn_no": turn_no,
                    "start": place,
                    "ids": row["ids"],
                    "loss_start": start if row["loss"] else None,
                    "loss_end": start + row["text_ids"] if row["loss"] else None,
                }
            )
            place, turn_no = place + len(row["ids"]) // 4, turn_no + 1
        schema = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in
                            ("conv_id", "turn_no", "start", "ids", "loss_start", "loss_end")])
        yield pa.RecordBatch.from_pylist(rows, schema)


def format_conversations(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """The formatted corpus, a row per turn in order: ``conv_id, turn_no, start, ids, loss_start, loss_end``.

    ``ids`` are little-endian unsigned 32-bit numbers; ``start`` and the mask count ids from the
    conversation's start. Turns are encoded where they are read. Only then do a conversation's turns
    meet, sorted by Spark and passed on one by one, so a conversation of any length needs no memory.
    Null role and text count as empty. Turns of one number are ordered by their ids; turns without a
    number come first; rows without a conv_id form one conversation.
    """
    return (
        turns.select(
            F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
        )
        .mapInArrow(lambda b: _encoded(b, tokenizer_path), TURNS)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "ids")
        .mapInArrow(_placed, FORMATTED)
    )


class _Reader:
    """Spells ids as bytes; the reserved ids are the template's marks."""

    def __init__(self, coder: TextEncoder):
        self.base = coder.tokenizer.get_vocab_size()
        letters = {letter: byte for byte, letter in coder.letters.items()}
        self.spelled = [b""] * self.base
        for token, i in coder.tokenizer.get_vocab().items():
            if all(c in letters for c in token):
                self.spelled[i] = bytes(letters[c] for c in token)

    def text(self, ids: np.ndarray) -> str:
        return b"".join([self.spelled[i] for i in ids.tolist()]).decode()


def _read(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    reader = _Reader(encoder(path, spell_special=True))
    state: dict = {}

    def closed() -> pa.RecordBatch:
        row = {k: v.hexdigest() if hasattr(v, "hexdigest") else v for k, v in state.items()}
        return pa.RecordBatch.from_pylist([row], _DIGEST_SCHEMA)

    for batch in batches:
        for row in batch.to_pylist():
            if not state or state["conv_id"] != row["conv_id"]:
                if state:
                    yield closed()
                state = {"conv_id": row["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(),
                         "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
            ids = np.frombuffer(row["ids"], "<u4")
            _, says, ends = np.flatnonzero(ids >= reader.base).tolist()
            role, text = reader.text(ids[1:says]), reader.text(ids[says + 1 : ends])
            state["n_turns"] += 1
            state["turns_sha256"].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            state["formatted_chars"] += sum(map(len, MARKS)) + len(role) + len(text)
            if row["loss_start"] is not None:
                masked = ids[row["loss_start"] - row["start"] : row["loss_end"] - row["start"]]
                learned = unescape(reader.text(masked))
                state["loss_chars"] += len(learned)
                state["loss_sha256"].update(learned.encode())
    if state:
        yield closed()


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
_DIGEST_SCHEMA = pa.schema(
    [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGESTS.split(", ")]
)


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests per conversation, from ids and mask alone. Reads the rows in the order they have."""
    return formatted.mapInArrow(lambda b: _read(b, tokenizer_path), DIGESTS)
