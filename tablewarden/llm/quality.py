"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of about 512 bytes. Each passage is described by its byte classes, their
pairs, and how its words repeat; a layer encodes it, a gated attention weighs the passages of a
document, and a logistic layer scores the weighted sum. Only documents have labels; which
passages speak for the label is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.store import lean, small_batches
from tablewarden.llm.words import Words, slices

PASSAGE_BYTES = 512
HIDDEN, GATE = 24, 12
MAX_LABELLED = 4000
MAX_LABELLED_BYTES = 64 << 20  # what the driver learns from is about as large
EPOCHS, BAGS, RATE = 30, 64, 0.004

_CLASS = np.full(256, 9, np.uint8)  # other signs
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x0A] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[[ord(c) for c in ".,"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[[ord(c) for c in "#$%&*|<>{}[]=~^_\\/+"]] = 7
_CLASS[128:] = 8
CLASSES = 10
FEATURES = CLASSES * CLASSES + CLASSES + 6


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages of each; at least one."""
    words = Words(column, lower=True)
    sizes = np.diff(words.offsets)
    each = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    total = int(each.sum())
    begin = np.cumsum(each) - each
    doc = np.repeat(np.arange(len(sizes)), each)
    place = np.arange(total) - begin[doc]
    # Equal shares: the last passage of a text is as long as the others.
    starts = words.offsets[:-1][doc] + place * sizes[doc] // each[doc]
    stops = words.offsets[:-1][doc] + (place + 1) * sizes[doc] // each[doc]
    length = stops - starts

    raw = Words.bytes_of(column)
    kind = _CLASS[raw].astype(np.int64)
    owner = np.repeat(np.arange(total), length)
    single = np.bincount(owner * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES)
    inner = owner[1:] == owner[:-1]
    code = owner[1:] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:]
    pairs = np.bincount(code[inner], minlength=total * CLASSES * CLASSES).reshape(total, -1)

    h = words.hashes()
    mine = np.searchsorted(starts, words.starts, side="right") - 1 if len(h) else np.zeros(0, np.int64)
    # Empty texts share a start with the next passage; the last of equal starts is the filled one.
    count = np.bincount(mine, minlength=total)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (mine[1:] == mine[:-1])
    again = np.bincount(mine[same], minlength=total)
    order = np.lexsort((h, mine))
    fresh = np.ones(len(h), bool)
    if len(h):
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (mine[order][1:] != mine[order][:-1])
    different = np.bincount(mine[order][fresh], minlength=total)
    size = words.ends - words.starts
    letters = np.bincount(mine, weights=size, minlength=total)
    short = np.bincount(mine[size <= 3], minlength=total)
    n = np.maximum(count, 1)
    features = np.empty((total, FEATURES), np.float32)
    features[:, : CLASSES * CLASSES] = pairs / np.maximum(length, 1)[:, None]
    features[:, CLASSES * CLASSES : CLASSES * CLASSES + CLASSES] = single / np.maximum(length, 1)[:, None]
    extra = [again / n, different / n, letters / n / 10, short / n, np.log1p(length) / 7, count > 0]
    features[:, -6:] = np.stack(extra, axis=1)
    return features, each


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        features, each = passages(pa.array(frame["text"], pa.string()))
        ends = np.cumsum(each)
        coded = [features[e - k : e].tobytes() for e, k in zip(ends, each, strict=True)]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "quality": frame["quality"], "bag": coded})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(model: dict, x: np.ndarray, each: np.ndarray) -> dict:
    """Every step of the score; ``each`` passages of ``x`` belong to one document."""
    start = np.cumsum(each) - each
    x = (x - model["mean"]) / model["scale"]
    h = np.tanh(x @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (t * g) @ model["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), each))
    a = e / np.repeat(np.add.reduceat(e, start), each)
    z = np.add.reduceat(h * a[:, None], start)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ model["c"] + model["d"][0])}


def _gradients(model: dict, s: dict, each: np.ndarray, y: np.ndarray) -> dict:
    start = np.cumsum(each) - each
    dp = (s["p"] - y) / len(y)
    dz = np.repeat(np.outer(dp, model["c"]), each, axis=0)
    da = (dz * s["h"]).sum(axis=1)
    de = s["a"] * (da - np.repeat(np.add.reduceat(s["a"] * da, start), each))
    dgate = np.outer(de, model["w"])
    dt = dgate * s["g"] * (1 - s["t"] ** 2)
    dg = dgate * s["t"] * s["g"] * (1 - s["g"])
    dh = (dz * s["a"][:, None] + dt @ model["V"].T + dg @ model["U"].T) * (1 - s["h"] ** 2)
    return {
        "W": s["x"].T @ dh,
        "b": dh.sum(axis=0),
        "V": s["h"].T @ dt,
        "U": s["h"].T @ dg,
        "w": (s["t"] * s["g"]).T @ de,
        "c": s["z"].T @ dp,
        "d": np.array([dp.sum()]),
    }


def learn(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> dict:
    """Fit the model by Adam over bags of passages. With no bags every document scores one half."""
    rng = np.random.default_rng(seed)
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE),
              "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    model = {k: rng.normal(0, 1 / np.sqrt(shape[0]), shape) if k not in "bd" else np.zeros(shape)
             for k, shape in shapes.items()}
    model["mean"], model["scale"] = np.zeros(FEATURES), np.ones(FEATURES)
    if not bags:
        model["c"] = np.zeros(HIDDEN)
        return model
    everything = np.concatenate(bags).astype(np.float64)
    model["mean"], model["scale"] = everything.mean(axis=0), everything.std(axis=0) + 0.02
    moments = {k: (np.zeros(v), np.zeros(v)) for k, v in shapes.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BAGS):
            chosen = order[at : at + BAGS]
            each = np.array([len(bags[i]) for i in chosen])
            state = _forward(model, np.concatenate([bags[i] for i in chosen]), each)
            step += 1
            for k, grad in _gradients(model, state, each, labels[chosen]).items():
                if k not in "bd":
                    grad = grad + 1e-4 * model[k]
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                model[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_bytes: int = MAX_LABELLED_BYTES
) -> dict:
    """Learn from at most ``most`` labelled documents outside the held-out fifth.

    Which ones is decided by a hash of doc_id; should their texts exceed ``most_bytes``, the longest are
    left out, whole. Texts, nothing else, become features. Null or other
    labels and null ids are not used; of a doc_id labelled twice the smaller label counts.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    texts = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    sizes = found.groupBy("doc_id", "quality").agg(F.sum(F.octet_length("text").cast("bigint") + 1).alias("size"))
    # A row per chosen doc_id, so one task may order them.
    total = F.sum("size").over(Window.orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taught = sizes.withColumn("_total", total).filter(F.col("_total") <= most_bytes)
    taught = taught.select(F.col("doc_id").alias("_id"), "quality")
    rows = (
        texts.join(F.broadcast(taught), F.col("doc_id") == F.col("_id"))
        .select("doc_id", "quality", "text")
        .mapInPandas(_bags, "doc_id bigint, quality int, bag binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "bag")
        .limit(2 * most)  # repeated doc_ids keep the bound
        .collect()
    )
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return learn(bags, np.array([r["quality"] for r in rows], np.float64))


def _scores(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=1 << 19):
            features, each = passages(part["text"])
            score = _forward(model, features.astype(np.float64), each)["p"]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(score)], ["doc_id", "score"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score`` of every row: the chance of label 1. Null and empty texts are one empty passage."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).mapInArrow(lambda batches: lean(_scores(batches, model)), "doc_id bigint, score double")


def _kept(batches: Iterator[pa.RecordBatch], model: dict, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=1 << 19):
            features, each = passages(part["text"])
            enough = _forward(model, features.astype(np.float64), each)["p"] >= least
            yield part.filter(pa.array(enough))


def accepted(docs: DataFrame, model: dict, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``."""
    return small_batches(docs).mapInArrow(lambda batches: lean(_kept(batches, model, least)), docs.schema)
