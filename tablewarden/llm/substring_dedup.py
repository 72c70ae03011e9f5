"""Repeated passages by prefix-partitioned suffix trees.

The suffixes are those that start at a word with at least 20 words left, cut at depth 20; a node of that
depth with several suffixes below it is a repeat.

Suffixes that cannot repeat are left out first. Every window of 20 words holds a smallest one of its
6-word runs, and equal windows hold the same; a first pass over these runs alone tells which of them occur
once, and a suffix around such a run is a leaf. A slice of a task counts a run it has often only once.

The others are split into memory-sized groups by prefixes of variable length: a suffix takes the shortest
of its prefixes of 4, 8, 12, 16 and 20 words whose group is not too large, by counts over all suffixes.
Each group is then built on its own: its suffixes are sorted by their words, the words that neighbours
share give the depth of the internal nodes between them, and below each node of depth 20 every suffix but
the first in the corpus is a repeat. Adjoining repeats make up the maximal ones.

Where one passage fills much of the corpus, each slice of a task sends only its first suffix of every
window; the others are repeats already and go straight to their rows. The trees are over a small alphabet:
a word is a letter of 4 bits of its number, so a suffix travels as 10 bytes of letters. Words that share a
letter only add nodes; suffixes whose letters all agree are one node of depth 20 only if their 64-bit window
numbers agree too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.blobs import numbered, pack_columns, text_slices, unpack_columns
from tablewarden.llm.store import keep, keep_bucketed, lean
from tablewarden.llm.words import Words, mix, numbers, starts_of

WINDOW_WORDS = 20
PREFIX_WORDS = 6
GROUP_SUFFIXES = 1 << 20
MOST_GROUPS = 1 << 17  # bounds the table of group sizes; beyond it groups grow instead
LAST = np.iinfo(np.int64).max

_WEIGHTS = numbers(41, 64)
_SURE = ("<i8", "<u4")  # row, start
_OPEN = ("<u8", "<i8", "<i8", "<u4")  # window number, doc_id, row, start; then a column per two letters


def _pairs(letters: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of letters, two to a byte."""
    odd = [np.zeros_like(letters[0])] if len(letters) % 2 else []
    even = letters + odd
    return [(even[i] << 4 | even[i + 1]).astype(np.uint8) for i in range(0, len(even), 2)]


def _unpaired(pairs: list[np.ndarray], words: int) -> np.ndarray:
    return np.stack([x for pair in pairs for x in (pair >> 4, pair & 15)][:words])


def prefix_lengths(words: int) -> list[int]:
    """Lengths that a prefix may have, shortest first; the last is the whole window."""
    return sorted({max(1, words * i // 5) for i in range(1, 6)})


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A number of the ``n`` words from each place on, row borders ignored."""
    size = max(len(h) - n + 1, 0)
    total = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            total += h[i : i + size] * _WEIGHTS[i]
    return mix(total)


def _smallest(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest number among ``width`` from each place on, by doubling."""
    place, reach = np.arange(len(g)), 1
    while reach < width:
        shift = min(reach, width - reach)
        left, right = place[: len(place) - shift], place[shift:]
        place = np.where(g[right] < g[left], right, left)
        reach += shift
    return place


class _Suffixes:
    """Windows of a slice of texts: ``starts`` and ``prefix`` are word places, ``doc`` the slice's row."""

    def __init__(self, texts: pa.Array, words: int, short: int):
        self.words = Words(texts)
        self.h = self.words.hashes()
        count = self.words.counts()
        each = np.maximum(count - words + 1, 0)
        self.doc = np.repeat(np.arange(len(count)), each)
        self.starts = starts_of(self.words.first[:-1], each)
        self.g = _runs(self.h, short)
        if len(self.starts):
            self.prefix = _smallest(self.g, words - short + 1)[self.starts]
        else:
            self.prefix = np.zeros(0, np.int64)

    def heads(self) -> np.ndarray:
        """One window of each different prefix place."""
        new = np.ones(len(self.prefix), bool)
        new[1:] = self.prefix[1:] != self.prefix[:-1]
        return np.flatnonzero(new)


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, short: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_slices(batch):
            found = _Suffixes(texts, words, short)
            heads = found.heads()
            doc, place = found.doc[heads], found.prefix[heads]
            run = found.g[place]
            _, first, group = np.unique(run, return_index=True, return_inverse=True)
            often = np.bincount(group.ravel(), minlength=len(first))[group.ravel()] > 1
            salt = part["row"].to_numpy()[doc] % 1024 + 1
            salt[first] = 0  # only these need counting, the others occur twice already
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(run.view(np.int64)),
                    pa.array(salt.astype(np.int32)),
                    pa.array(often),
                    pa.array(part["row"].to_numpy()[doc]),
                    pa.array((place - found.words.first[doc]).astype(np.int32)),
                ],
                ["prefix", "salt", "often", "row", "place"],
            )


class _Open:
    """Suffixes of a slice that may repeat, ordered so that equal windows adjoin, first in the corpus first."""

    def __init__(self, part: pa.RecordBatch, texts: pa.Array, words: int, short: int):
        found = _Suffixes(texts, words, short)
        repeated = np.zeros(len(found.h) + 1, bool)
        for i, places in enumerate(part["places"].to_pylist()):
            repeated[found.words.first[i] + np.array(places, np.int64)] = True
        mine = np.flatnonzero(repeated[found.prefix]) if len(found.prefix) else np.zeros(0, np.int64)
        self.h, at, doc = found.h, found.starts[mine], found.doc[mine]
        window = _runs(self.h, words)[at]
        docs, rows = part["doc_id"].fill_null(LAST).to_numpy()[doc], part["row"].to_numpy()[doc]
        start = (at - found.words.first[doc]).astype(np.uint32)
        order = np.lexsort((start, rows, docs, window))
        self.at, self.window, self.docs, self.rows, self.start = (
            x[order] for x in (at, window, docs, rows, start)
        )
        self.first = np.ones(len(order), bool)
        self.first[1:] = self.window[1:] != self.window[:-1]

    def buckets(self, length: int, groups: int) -> np.ndarray:
        """The bucket of each first suffix by its prefix of ``length`` words."""
        number = _runs(self.h, length)[self.at[self.first]]
        return (mix(number + np.uint64(length)) % np.uint64(groups)).astype(np.int64)


def _sizes(
    batches: Iterator[pa.RecordBatch], words: int, short: int, groups: int
) -> Iterator[pa.RecordBatch]:
    """How many suffixes of this task each bucket has, for every length of a prefix."""
    lengths = prefix_lengths(words)
    total = np.zeros((len(lengths), groups), np.int64)
    for batch in batches:
        for part, texts in text_slices(batch):
            suffixes = _Open(part, texts, words, short)
            if len(suffixes.at):
                for level, length in enumerate(lengths):
                    total[level] += np.bincount(suffixes.buckets(length, groups), minlength=groups)
    level, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(level.astype(np.int32)), pa.array(bucket), pa.array(total[level, bucket])],
        ["level", "bucket", "n"],
    )


def _candidates(
    batches: Iterator[pa.RecordBatch], words: int, short: int, groups: int, large: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The first suffix of every window of a slice, by group; the other ones as repeats, by row.

    ``large`` tells for each length of a prefix but the last which buckets hold too many suffixes.
    """
    lengths = prefix_lengths(words)
    for batch in batches:
        for part, texts in text_slices(batch):
            suffixes = _Open(part, texts, words, short)
            if not len(suffixes.at):
                continue
            first, out = suffixes.first, []
            group = np.full(int(first.sum()), -1, np.int64)
            for level, length in enumerate(lengths):
                bucket = suffixes.buckets(length, groups)
                fits = group < 0
                if level + 1 < len(lengths):
                    fits &= ~large[level, bucket]
                group[fits] = level * groups + bucket[fits]
            letters = (suffixes.h >> np.uint64(60)).astype(np.uint8)
            at, order = suffixes.at[first], np.argsort(group, kind="stable")
            group = group[order]
            columns = [x[first][order] for x in (suffixes.window, suffixes.docs, suffixes.rows, suffixes.start)]
            columns += _pairs([letters[at[order] + i] for i in range(words)])
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((int(group[a]), False, pack_columns(*(c[a:b] for c in columns))))
            rows, start = suffixes.rows[~first], suffixes.start[~first]
            if len(rows):
                by = rows % groups
                order = np.argsort(by, kind="stable")
                by, rows, start = by[order], rows[order], start[order]
                cuts = np.flatnonzero(np.diff(by, prepend=-1, append=-1))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    out.append((-1 - int(by[a]), True, pack_columns(rows[a:b], start[a:b])))
            groups_, repeats, blobs = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups_, pa.int64()), pa.array(repeats, pa.bool_()), pa.array(blobs, pa.binary())],
                ["group", "repeat", "blob"],
            )


class Tree:
    """The suffix tree of a group as its sorted suffixes and the depth of the node above each neighbouring two."""

    def __init__(self, letters: np.ndarray, window: np.ndarray, ties: tuple[np.ndarray, ...]):
        """``letters`` (below 16) has a column per suffix; of suffixes with equal windows the first by ``ties`` leads."""
        depth, n = letters.shape
        keys = []
        for i in range(0, depth, 16):  # sixteen letters a key
            key = np.zeros(n, np.uint64)
            for j in range(i, min(i + 16, depth)):
                key = (key << np.uint64(4)) | letters[j].astype(np.uint64)
            keys.append(key)
        self.order = np.lexsort((*reversed(ties), window, *reversed(keys)))
        self.depth = np.zeros(n, np.int64)  # words shared with the suffix before
        alike = np.ones(max(n - 1, 0), bool)
        for column in letters:
            along = column[self.order]
            alike &= along[1:] == along[:-1]
            self.depth[1:] += alike
        apart = window[self.order][1:] != window[self.order][:-1]
        self.depth[1:][apart & (self.depth[1:] == depth)] = depth - 1  # letters that only look alike

    def below(self, depth: int) -> np.ndarray:
        """The suffixes below internal nodes of ``depth``, without the first one of every node."""
        return self.order[self.depth >= depth]


REPEATS = "row bigint, start int"  # a row per repeat: as many as the input has, however it is grouped


def _repeats(words: int):
    def repeats(table: pa.Table) -> pa.Table:
        """Repeated suffixes of one group."""
        rows, starts, open_ = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], []
        for sure, blob in zip(table["repeat"].to_pylist(), table["blob"], strict=True):
            if sure:
                row, start = unpack_columns(blob.as_py(), *_SURE)
                rows.append(row)
                starts.append(start)
            else:
                open_.append(unpack_columns(blob.as_py(), *_OPEN, *["<u1"] * -(-words // 2)))
        if open_:
            window, doc, row, start = (np.concatenate([c[i] for c in open_]) for i in range(4))
            pairs = [np.concatenate([c[4 + i] for c in open_]) for i in range(-(-words // 2))]
            letters = _unpaired(pairs, words)
            del open_
            found = Tree(letters, window, (doc, row, start)).below(words)
            rows.append(row[found])
            starts.append(start[found])
        row, start = np.concatenate(rows), np.concatenate(starts)
        return pa.table({"row": pa.array(row, pa.int64()), "start": pa.array(start.astype(np.int32))})

    return repeats


def _mark(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_slices(batch):
            total, spans, digests = [], [], []
            for text, found in zip(texts.cast(pa.large_binary()), part["found"], strict=True):
                own = text.as_py().split()
                removed = np.zeros(len(own), bool)
                if found.is_valid:
                    starts = found.values.to_numpy()
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + words, -1)
                    removed = np.cumsum(edge)[:-1] > 0
                ends = np.flatnonzero(np.diff(removed.astype(np.int8), prepend=0, append=0))
                kept = [w for w, gone in zip(own, removed.tolist(), strict=True) if not gone] if found.is_valid else own
                total.append(len(own))
                spans.append([{"first": int(a), "last": int(b)} for a, b in zip(ends[::2], ends[1::2], strict=True)])
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(total, pa.int64()), pa.array(spans, spans_type), pa.array(digests)],
                ["doc_id", "n_words", "spans", "kept_sha256"],
            )


def repeated_passages(
    docs: DataFrame,
    words: int = WINDOW_WORDS,
    short: int = PREFIX_WORDS,
    group_suffixes: int = GROUP_SUFFIXES,
) -> DataFrame:
    """Per document: ``doc_id, n_words, spans, kept_sha256``.

    ``spans`` are the maximal runs of words [first, last) covered by windows that also start earlier: in
    a smaller doc_id, or earlier in the same document. Null doc_ids come last; rows that repeat a doc_id
    come one after the other in the order of the written table. A null text has no words. Only ``doc_id``
    and ``text`` are read.
    """
    spark = docs.sparkSession
    texts = keep_bucketed(numbered(docs), "row", "substring-texts", dealt=True)
    runs = texts.mapInArrow(
        lambda b: lean(_prefixes(b, words, short)),
        "prefix bigint, salt int, often boolean, row bigint, place int",
    )
    counted = runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("prefix", "salt")))
    repeated = keep(
        counted.filter("n > 1 or often").groupBy("row").agg(F.collect_list("place").alias("places")),
        "substring-prefixes",
    )
    # A run has (words - short + 2) / 2 windows on average.
    found = repeated.agg(F.sum(F.size("places"))).first()[0] or 0
    suffixes = found * (words - short + 2) // 2
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(min(-(-suffixes // group_suffixes), MOST_GROUPS), partitions)
    candidates = texts.join(repeated, "row").select("row", "doc_id", "blob", "places")
    sizes = candidates.mapInArrow(
        lambda b: lean(_sizes(b, words, short, groups)), "level int, bucket bigint, n bigint"
    )
    limit = max(group_suffixes, suffixes // MOST_GROUPS)
    over = sizes.groupBy("level", "bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > limit)
    large = np.zeros((len(prefix_lengths(words)), groups), bool)
    for level, bucket in over.select("level", "bucket").collect():  # fewer than the groups, for every length
        large[level, bucket] = True
    repeats = (
        candidates.mapInArrow(
            lambda b: lean(_candidates(b, words, short, groups, large)),
            "group bigint, repeat boolean, blob binary",
        )
        .groupBy("group")
        .applyInArrow(_repeats(words), REPEATS)
        .groupBy("row")
        .agg(F.collect_list("start").alias("found"))
    )
    return texts.join(repeats, "row", "left").select("doc_id", "blob", "found").mapInArrow(
        lambda b: lean(_mark(b, words)),
        "doc_id bigint, n_words bigint, spans array<struct<first:bigint,last:bigint>>, kept_sha256 string",
    )


def removal_digests(passages: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return passages.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")
