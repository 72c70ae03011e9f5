"""Quality rules with a language's own n-gram model: texts it finds too odd, or too plain, go.

The model is an interpolated modified Kneser-Ney model of byte 5-grams, one per language, counted by
Spark over every text of the table. A run of white space counts as one space and a text starts after
four spaces; nothing else is normalized, so case, digits and signs are judged as they stand.

Texts are cut into slices of one language and about 16 MB. A slice is read once: its base counts, its
different 5-grams with their counts, and its compressed texts are written to a table bucketed by slice.
Then

1. the counts of all slices are added up by a grouping, and the lower orders' continuation counts follow
   from the different 5-grams by one grouping each; every group of a context has at most 256 rows;
2. the probability of each 5-gram is stored in arrays sorted by hash (a bijection of the 5-gram, so
   nothing collides), one array per language and hash range;
3. every slice asks each range once for its different 5-grams, as a sorted array as well, and gets their
   log-probabilities in the same order;
4. the answers meet the slices bucket by bucket, without moving the texts again, and a text is scored by
   an interpolation lookup in the slice's own sorted hash array.

What is gathered grows with the different n-grams of the slices. Nothing of it is broadcast or collected.

Bands: the quartiles of the log-perplexity per byte are taken per language over all texts that pass the
base rules, exactly, from a histogram. A text is rejected if it is more than ``ABOVE`` interquartile
ranges over the upper one, or more than ``BELOW`` under the lower one; that reach is wider, for the model
has learned every text that it judges, and texts with many copies best. A language with fewer than ``LEAST_TEXTS`` such texts has no band and keeps all of them.

A null text is empty and has no words, so it fails the base rules. A null language is one language.
Rows that repeat are texts of their own and count as often as they occur. Only doc_id, lang and text are
read. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.blobs import pack_bytes, pack_columns, unpack_bytes, unpack_columns
from tablewarden.llm.store import keep, keep_bucketed, lean
from tablewarden.llm.words import Words, mix, slices, text_bytes

ORDER = 5
SLICE_BYTES = 16 << 20
HELD_BYTES = 2 * SLICE_BYTES
WINDOW = 1 << 20  # places of a text handled at once
RANGE_GRAMS = 1 << 21

# Fixed values of the base rules.
SIGNS = b"#*$%&|<>"
SPACES = bytes([0x20, *range(0x09, 0x0E)])
REPEAT_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

ABOVE, BELOW = 3.0, 6.0
LEAST_TEXTS = 40
BINS = 1000  # per unit of log-perplexity

_CONTINUED = bytes(range(0x80, 0xC0))
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


# ---- one slice ---------------------------------------------------------------------------------


def repeated_words(column: pa.Array, size: int = REPEAT_WORDS) -> np.ndarray:
    """Per text, the words inside ``size``-word windows that occur twice or more in that text.

    Windows are compared by 64-bit numbers of all their words, within one text.
    """
    words = Words(column)
    grams, each = words.grams(size)
    counts = words.counts()
    if not len(grams):
        return np.zeros(len(counts), np.int64)
    owner = np.repeat(np.arange(len(each)), each)
    own = grams ^ mix(owner.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(counts), np.int64)
    at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    found = np.flatnonzero(twice[at] == own)
    begin = np.cumsum(each) - each
    start = words.first[:-1][owner[found]] + found - begin[owner[found]]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + size, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
    return covered[words.first[1:]] - covered[words.first[:-1]]


def base_counts(column: pa.Array) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    counted = []
    for text in pa.compute.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()):
        raw = text.as_py()
        letters = raw.translate(None, SPACES)
        lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
        counted.append((
            len(letters.translate(None, _CONTINUED)),
            len(raw) - len(raw.translate(None, SIGNS)),
            len(lines) - len(set(lines)),
        ))
    table = np.zeros((len(counted), 5), np.int64)
    if counted:
        table[:, 1:4] = counted
        table[:, 0] = Words(column).counts()
        table[:, 4] = repeated_words(column)
    return table


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each after ``ORDER - 1`` spaces and with runs of white space as one space, and
    how many bytes of each are scored."""
    space = _SPACE[data]
    stays = np.ones(len(data), bool)
    stays[1:] = ~(space[1:] & space[:-1])
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    stays[starts] = ~space[starts]  # the spaces before a text stand for its leading ones
    sizes = np.zeros(len(offsets) - 1, np.int64)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        sizes[filled] = np.add.reduceat(stays.view(np.uint8), starts, dtype=np.int64)
    plain = data[stays]
    plain[_SPACE[plain]] = 0x20
    pad = ORDER - 1
    out = np.full(len(plain) + pad * len(sizes), 0x20, np.uint8)
    own = np.ones(len(out), bool)
    begin = np.cumsum(sizes + pad) - sizes - pad
    for i in range(pad):
        own[begin + i] = False
    out[own] = plain
    return out, sizes


def _windows(out: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The 5-grams that end at scored bytes, some places at a time, and the text of each."""
    pad = ORDER - 1
    ends = np.cumsum(sizes + pad)
    begin = ends - sizes - pad
    for a in range(pad, len(out), WINDOW):
        b = min(a + WINDOW, len(out))
        owner = np.searchsorted(ends, np.arange(a, b), side="right")
        scored = np.arange(a, b) - begin[owner] >= pad
        gram = np.zeros(b - a, np.uint64)
        for i in range(ORDER):
            gram = (gram << np.uint64(8)) | out[a - pad + i : b - pad + i]
        yield gram[scored], owner[scored]


def different_grams(out: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different 5-grams of a stream, ascending, and how often each occurs."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for gram, _ in _windows(out, sizes):
        fresh, times = np.unique(gram, return_counts=True)
        keys, counts = _added([keys, fresh], [counts, times])
    return keys, counts


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys of all arrays, their counts added up."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    if not len(key):
        return key, count
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count, first)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return pack_columns(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_columns(blob, "<u8")[0], dtype=np.uint64)


SLICED = (
    "slice bigint, tongue string, doc_ids array<bigint>, texts binary, sizes binary, base binary, "
    "grams binary, times binary, n_grams bigint"
)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    held: dict[str, list[pa.RecordBatch]] = {}
    bytes_of: dict[str, int] = {}

    def flush(tongue: str) -> pa.RecordBatch:
        nonlocal number
        rows = pa.Table.from_batches(held.pop(tongue)).combine_chunks()
        bytes_of.pop(tongue)
        column = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
        base = np.concatenate([base_counts(part["text"]) for part in _thin(column)])
        data, offsets = text_bytes(column)
        out, sizes = stream(data, offsets)
        grams, times = different_grams(out, sizes)
        number += 1
        found = [
            pa.array([number - 1], pa.int64()),
            pa.array([tongue], pa.string()),
            pa.array([rows["doc_id"].to_pylist()], pa.list_(pa.int64())),
            pa.array([pack_bytes(out.tobytes())], pa.binary()),
            pa.array([pack_columns(sizes)], pa.binary()),
            pa.array([pack_columns(base.ravel())], pa.binary()),
            pa.array([_pack_sorted(grams)], pa.binary()),
            pa.array([pack_columns(times)], pa.binary()),
            pa.array([len(grams)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(found, [part.split()[0] for part in SLICED.split(", ")])

    for batch in batches:
        for part in slices(batch):
            for tongue in pa.compute.unique(part["tongue"]).to_pylist():
                mine = part.filter(pa.compute.equal(part["tongue"], tongue))
                held.setdefault(tongue, []).append(mine)
                size = pa.compute.sum(pa.compute.binary_length(mine["text"])).as_py() or 0
                bytes_of[tongue] = bytes_of.get(tongue, 0) + size
                if bytes_of[tongue] >= SLICE_BYTES:
                    yield flush(tongue)
            while sum(bytes_of.values()) > HELD_BYTES:
                yield flush(max(bytes_of, key=bytes_of.get))
    for tongue in list(held):
        yield flush(tongue)


def _thin(column: pa.Array) -> Iterator[pa.RecordBatch]:
    return slices(pa.RecordBatch.from_arrays([column], ["text"]), most=2 << 20)


# ---- the model ---------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 5-grams of a task's slices, added up per language before they are sent."""
    held: dict[str, list] = {}

    def flush(tongue: str) -> pa.RecordBatch:
        keys, counts = held.pop(tongue)
        return pa.RecordBatch.from_arrays(
            [pa.array([tongue] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)],
            ["tongue", "gram", "n"],
        )

    for batch in batches:
        for tongue, grams, times in zip(*[batch[c].to_pylist() for c in ("tongue", "grams", "times")], strict=True):
            fresh, counts = _unpack_sorted(grams), unpack_columns(times, "<i8")[0]
            before = held.get(tongue, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            held[tongue] = _added([before[0], fresh], [before[1], counts])
            if sum(len(k) for k, _ in held.values()) > 2 * RANGE_GRAMS:
                yield flush(max(held, key=lambda t: len(held[t][0])))
    for tongue in list(held):
        yield flush(tongue)


def _discounts(counted: DataFrame) -> DataFrame:
    """``tongue, d1, d2, d3``: what is taken off grams seen once, twice, more often.

    Where a count of counts is zero its discount cannot be estimated and is that of the one before it.
    """
    t = counted.groupBy("tongue").agg(*[F.sum((F.col("n") == i).cast("bigint")).alias(f"t{i}") for i in range(1, 5)])
    y = F.when(F.col("t1") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(F.lit(0.0))
    raw = [
        F.when(F.col(f"t{i}") > 0, F.least(F.greatest(F.lit(float(i)) - (i + 1) * F.col("y") * F.col(f"t{i + 1}")
               / F.col(f"t{i}"), F.lit(0.0)), F.lit(float(i))))
        for i in (1, 2, 3)
    ]
    found = t.withColumn("y", y).select("tongue", *[d.alias(f"e{i}") for i, d in enumerate(raw, 1)])
    d1 = F.coalesce("e1", F.lit(0.0))
    d2 = F.coalesce(F.col("e2"), d1)
    return found.select("tongue", d1.alias("d1"), d2.alias("d2"), F.coalesce(F.col("e3"), d2).alias("d3"))


BROADCAST_TONGUES = 100_000


def _small_join(rows: DataFrame, facts: DataFrame, label: str, how: str = "inner") -> DataFrame:
    """Join one row per language to many rows. Few languages, as counted, are broadcast; if there are
    very many, none of them is large, and an ordinary join will do."""
    facts = keep(facts, label)
    return rows.join(F.broadcast(facts) if facts.count() <= BROADCAST_TONGUES else facts, "tongue", how)


def _order_probabilities(counted: DataFrame, order: int, lower: DataFrame | None) -> DataFrame:
    """``tongue, gram, p`` of one order; the lowest is interpolated with 256 equal bytes."""
    context = Window.partitionBy("tongue", F.shiftright("gram", 8))  # at most 256 rows each

    def sure(i: int) -> Column:
        return F.sum(((F.col("n") == i) if i < 3 else (F.col("n") >= 3)).cast("bigint")).over(context)

    rows = _small_join(counted, _discounts(counted), f"perplexity-d{order}").select(
        "tongue",
        "gram",
        (F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        .alias("left"),
        F.sum("n").over(context).alias("total"),
        (F.col("d1") * sure(1) + F.col("d2") * sure(2) + F.col("d3") * sure(3)).alias("taken"),
    )
    if lower is None:
        return rows.select(
            "tongue", "gram", ((F.col("left") + F.col("taken") / 256) / F.col("total")).alias("p")
        )
    short = F.col("gram").bitwiseAND((1 << 8 * (order - 1)) - 1)
    below = lower.select("tongue", F.col("gram").alias("_short"), F.col("p").alias("_below"))
    return rows.withColumn("_short", short).join(below, ["tongue", "_short"]).select(
        "tongue", "gram", ((F.col("left") + F.col("taken") * F.col("_below")) / F.col("total")).alias("p")
    )


def probabilities(counts: DataFrame, label: str = "perplexity") -> DataFrame:
    """``tongue, gram, p`` of every 5-gram in ``tongue, gram, n``, by modified Kneser-Ney smoothing.

    The count of a lower-order gram is the number of different bytes seen before it.
    """
    orders = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        short = F.col("gram").bitwiseAND((1 << 8 * order) - 1).alias("gram")
        orders[order] = keep(
            orders[order + 1].groupBy("tongue", short).agg(F.count(F.lit(1)).alias("n")), f"{label}-{order}"
        )
    p = None
    for order in range(1, ORDER + 1):
        p = keep(_order_probabilities(orders[order], order, p), f"{label}-p{order}")
    return p


# ---- sorted hash arrays ------------------------------------------------------------------------


def _ranges(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """``(range, from, to)`` of sorted hashes, by their top bits."""
    if not bits:
        return [(0, 0, len(hashes))]
    edges = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
    return [(i, a, b) for i, (a, b) in enumerate(zip(edges, [*edges[1:], len(hashes)], strict=True)) if b > a]


def _stored(table: pa.Table) -> pa.Table:
    """One range of the model: hashes ascending, and their log-probabilities."""
    hashes = mix(table["gram"].to_numpy().astype(np.uint64))
    order = np.argsort(hashes)
    logs = np.log(table["p"].to_numpy()[order]).astype("<f4")
    return pa.table(
        {
            "tongue": table["tongue"].slice(0, 1),
            "range": table["range"].slice(0, 1),
            "hashes": pa.array([_pack_sorted(hashes[order])], pa.binary()),
            "logs": pa.array([pack_columns(logs)], pa.binary()),
        }
    )


def _asked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            hashes = np.sort(mix(_unpack_sorted(batch["grams"][i].as_py())))
            parts = _ranges(hashes, bits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch["slice"][i].as_py()] * len(parts), pa.int64()),
                    pa.array([batch["tongue"][i].as_py()] * len(parts), pa.string()),
                    pa.array([r for r, _, _ in parts], pa.int32()),
                    pa.array([_pack_sorted(hashes[a:b]) for _, a, b in parts], pa.binary()),
                ],
                ["slice", "tongue", "range", "hashes"],
            )


def _answered(asked: pa.Table, model: pa.Table) -> pa.Table:
    hashes = _unpack_sorted(model["hashes"][0].as_py())
    logs = unpack_columns(model["logs"][0].as_py(), "<f4")[0]
    out = []
    for blob in asked["hashes"]:
        wanted = _unpack_sorted(blob.as_py())
        out.append(pack_columns(logs[np.searchsorted(hashes, wanted)]))
    return pa.table({"slice": asked["slice"], "range": asked["range"], "logs": pa.array(out, pa.binary())})


class Lookup:
    """Places of hashes in a sorted array that holds them, by interpolation: the top bits of a hash give
    the first place it can be at, and few are before it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(1, min(26, int(len(hashes)).bit_length() + 2))
        tops = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.searchsorted(hashes, tops).astype(np.int32)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        at = self.first[(wanted >> np.uint64(64 - self.bits)).astype(np.int64)]
        late = np.flatnonzero(self.hashes[at] < wanted)
        while len(late):
            at[late] += 1
            late = late[self.hashes[at[late]] < wanted[late]]
        return at


SCORED = (
    "doc_id bigint, tongue string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, log_perplexity double"
)


def _scored(held: pa.Table, answers: pa.Table) -> pa.Table:
    """The texts of one slice with their base counts and their log-perplexity per byte."""
    row = held.to_pylist()[0]
    sizes = unpack_columns(row["sizes"], "<i8")[0]
    base = unpack_columns(row["base"], "<i8")[0].reshape(-1, 5)
    total = np.zeros(len(sizes))
    if row["n_grams"]:
        lookup = Lookup(np.sort(mix(_unpack_sorted(row["grams"]))))
        parts = sorted(zip(answers["range"].to_pylist(), answers["logs"].to_pylist(), strict=True))
        logs = np.concatenate([unpack_columns(blob, "<f4")[0] for _, blob in parts]).astype(np.float64)
        for gram, owner in _windows(np.frombuffer(unpack_bytes(row["texts"]), np.uint8), sizes):
            total += np.bincount(owner, weights=logs[lookup.places(mix(gram))], minlength=len(sizes))
    names = [part.split()[0] for part in SCORED.split(", ")]
    columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["tongue"]] * len(sizes), pa.string())]
    columns += [pa.array(base[:, i]) for i in range(5)]
    mean = -total / np.maximum(sizes, 1)
    columns.append(pa.array(mean, pa.float64(), mask=sizes == 0))
    return pa.table(dict(zip(names, columns, strict=True)))


def scores(docs: DataFrame) -> DataFrame:
    """Per text: ``doc_id, tongue``, the base counts and ``log_perplexity`` (null without words)."""
    tongue = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        tongue.alias("tongue"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    held = keep_bucketed(texts.mapInArrow(lambda b: lean(_sliced(b)), SLICED), "slice", "perplexity-slices")
    counted = held.select("tongue", "grams", "times").mapInArrow(_counted, "tongue string, gram bigint, n bigint")
    counts = keep(counted.groupBy("tongue", "gram").agg(F.sum("n").alias("n")), "perplexity-counts")
    asked_for = held.agg(F.sum("n_grams")).first()[0] or 0
    bits = max(0, (asked_for // RANGE_GRAMS).bit_length())
    # The range of a 5-gram is known where its hash is; the bijection is numpy's, so it is a small map.
    ranged = probabilities(counts).mapInArrow(
        lambda b: _ranged(b, bits), "tongue string, gram bigint, p double, range int"
    )
    model = ranged.groupBy("tongue", "range").applyInArrow(
        _stored, "tongue string, range int, hashes binary, logs binary"
    )
    model = keep(model, "perplexity-model")
    asked = held.select("slice", "tongue", "grams").mapInArrow(
        lambda b: _asked(b, bits), "slice bigint, tongue string, range int, hashes binary"
    )
    answers = (
        asked.groupBy("tongue", "range")
        .cogroup(model.groupBy("tongue", "range"))
        .applyInArrow(_answered, "slice bigint, range int, logs binary")
    )
    return held.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_scored, SCORED)


def _ranged(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = mix(batch["gram"].to_numpy().astype(np.uint64))
        top = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
        yield batch.append_column("range", pa.array(top.astype(np.int32)))


# ---- verdicts ----------------------------------------------------------------------------------


def base_failed() -> Column:
    few = F.col("n_words") < LEAST_WORDS
    return few | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(scored: DataFrame, below: float = BELOW, above: float = ABOVE, least: int = LEAST_TEXTS) -> DataFrame:
    """``tongue, low, high`` of the log-perplexity, over the texts that pass the base rules."""
    binned = scored.filter(~base_failed() & F.col("log_perplexity").isNotNull()).select(
        "tongue", F.floor(F.col("log_perplexity") * BINS).alias("bin")
    )
    # One row per language and filled bin; a log-perplexity is a small number.
    histogram = binned.groupBy("tongue", "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tongue")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = histogram.select("tongue", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all"))

    def quartile(i: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= i * F.col("all"), F.col("bin")))

    found = placed.groupBy("tongue").agg(
        quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("all").alias("texts")
    )
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(BINS // 50))
    return found.filter(F.col("texts") >= least).select(
        "tongue",
        ((F.col("q1") - below * spread) / BINS).alias("low"),
        ((F.col("q3") + above * spread) / BINS).alias("high"),
    )


def verdicts(
    docs: DataFrame, below: float = BELOW, above: float = ABOVE, least: int = LEAST_TEXTS
) -> DataFrame:
    """Per text: doc_id, the base counts, ``base_failed``, ``kept``, ``log_perplexity`` and its band."""
    scored = keep(scores(docs), "perplexity-scores")
    judged = _small_join(scored, bands(scored, below, above, least), "perplexity-bands", "left")
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(inside, F.lit(True))).alias("kept"),
        "log_perplexity",
        "low",
        "high",
    )
