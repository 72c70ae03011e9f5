"""Similarity join of documents on word n-grams by parity sketches.

A document's set of n-grams is a parity sketch: every n-gram flips one bit, so what two sets share
cancels out and the Hamming distance of two sketches is at most the size of the sets' symmetric
difference. Links of similarity t between sets of sizes a and b differ in at most (a+b)(1-t)/(1+t) n-grams.
Per band of sizes the sketch is cut into more pieces than that; by the pigeonhole principle linked sets
agree in a piece, and pieces are joined by equality. A piece is sent as a linear 64-bit hash of its bits.

Sketches have eight bits and more for each n-gram in which linked sets of that size may differ, up to 16,384,
and are folded to the shorter one's width; shorter ones would pass any two large sets.

Sets that agree in a piece are candidates. A bucket of few sets tries all its pairs; a larger one tries
all its sets against one hub. Buckets then still in several components are merged with those of much the
same sets, since sets that just miss the threshold share a bucket for every few of their n-grams. What is
outside a merged bucket's largest component meets the rest in blocks, where sketches are compared in
memory. Of the candidates that pass the sketches' bound every set first sends its nearest ones; while any
were held back and their components are still apart, more follow, at last all. Candidates are verified on
the whole sets. So no pair that could change a component is left out, and none is written out merely for
sharing a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.blobs import numbered, text_slices
from tablewarden.llm.components import components
from tablewarden.llm.store import keep, keep_bucketed, lean
from tablewarden.llm.words import Words, mix, numbers
from tablewarden.operators.joins import spread_join

BAND_RATIO = 1.3
SMALL = 5  # sets of a bucket that tries all its pairs
BLOCK = 256
NEAREST = (8, 64, 1 << 30)  # candidates that a set sends from a pair of blocks, round by round
SKETCH_WORDS, MOST_SKETCH_WORDS = 8, 256

_TEXT_SALT, _PIECE_SALT, _BIT_SALT, _SIGN_A, _SIGN_B = numbers(61, 5)


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of each text as (owner, number), sorted; a shorter text is one n-gram."""
    words = Words(texts, lower=True)
    h = words.hashes()
    grams, each = words.grams(n, h)
    owner = np.repeat(np.arange(len(each)), each)
    count = words.counts()
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        with np.errstate(over="ignore"):
            whole = [mix(np.bitwise_xor.reduce(mix(h[a:b] + np.arange(b - a, dtype=np.uint64) * _TEXT_SALT))[None])[0]
                     for a, b in zip(words.first[few], words.first[few + 1], strict=True)]
        grams = np.concatenate([grams, np.array(whole, np.uint64)])
        owner = np.concatenate([owner, few])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], grams[new]


def _sums(owner: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    total = np.zeros(rows, np.uint64)
    if len(owner):
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        with np.errstate(over="ignore"):
            total[owner[begin]] = np.add.reduceat(values, begin)
    return total


PROFILE = "row bigint, doc_id bigint, text_md5 string, n bigint, a bigint, b bigint, sketch array<bigint>"


def _profiles(batches: Iterator[pa.RecordBatch], n: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_slices(batch):
            owner, grams = _sets(texts, n)
            rows = len(part)
            with np.errstate(over="ignore"):
                signs = [_sums(owner, mix(grams * s), rows).view(np.int64) for s in (_SIGN_A, _SIGN_B)]
                bit = mix(grams ^ _BIT_SALT)
            n_grams = np.bincount(owner, minlength=rows)
            width = bands.sketch_words(n_grams)
            first = np.concatenate([[0], np.cumsum(width)])
            sketch = np.zeros(first[-1], np.uint64)
            word = (bit // np.uint64(64) % width[owner].astype(np.uint64)).astype(np.int64)
            np.bitwise_xor.at(sketch, first[owner] + word, np.uint64(1) << (bit % np.uint64(64)))
            yield pa.RecordBatch.from_arrays(
                [
                    part["row"],
                    part["doc_id"],
                    pa.array([hashlib.md5(t.as_py()).hexdigest() for t in texts.cast(pa.large_binary())]),
                    pa.array(n_grams),
                    *map(pa.array, signs),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(sketch.view(np.int64))),
                ],
                ["row", "doc_id", "text_md5", "n", "a", "b", "sketch"],
            )


class Bands:
    """Size bands for a similarity of percent/100, and how many pieces each needs."""

    def __init__(self, percent: int, ratio: float = BAND_RATIO):
        self.percent = percent
        # Below this size only equal sets are linked.
        smallest = 1
        while (2 * smallest + 1) * (100 - percent) // (100 + percent) < 1:
            smallest += 1
        self.low = [smallest]
        while self.low[-1] < 1 << 31:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * ratio)))
        self.low = np.array(self.low, np.int64)
        self.pieces, self.spare = zip(*map(self._pieces, range(len(self.low) - 1)), strict=True)

    def most(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def sketch_words(self, sizes: np.ndarray) -> np.ndarray:
        """Words of a set's sketch: a power of two, so that a wider sketch folds to a narrower one."""
        words = np.clip(8 * self.most(sizes, sizes) / 64, SKETCH_WORDS, MOST_SKETCH_WORDS)
        return 1 << np.ceil(np.log2(words)).astype(np.int64)

    def _pieces(self, band: int) -> tuple[int, int]:
        """Pieces, and how many empty ones a set may have before it must send them, too."""
        top = int(self.low[band + 1]) - 1
        need, spare = int(self.most(top, top)) + 1, 0
        for _ in range(3):
            total = need + spare
            empty = total * np.exp(-float(self.low[band]) * self.percent / 100 / total)
            spare = int(np.ceil(empty + 2 * np.sqrt(empty))) if empty > 0.02 else 0
        return need + spare, spare

    def of(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sets, band) in which they take part: their own, and those of larger partners."""
        own = np.searchsorted(self.low, sizes, side="right") - 1
        top = np.searchsorted(self.low, sizes * 100 // self.percent, side="right") - 1
        found, step = [], 0
        while True:
            chosen = np.flatnonzero((own >= 0) & (own + step <= top))
            if not len(chosen):
                return found
            found.append((chosen, own[chosen] + step))
            step += 1


def _pieces(batches: Iterator[pa.RecordBatch], n: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    pieces, spare = np.array(bands.pieces), np.array(bands.spare)
    for batch in batches:
        for part, texts in text_slices(batch):
            owner, grams = _sets(texts, n)
            sizes = np.bincount(owner, minlength=len(part))
            ids = part["cid"].to_numpy()
            place, bit = mix(grams ^ _PIECE_SALT) >> np.uint64(32), mix(grams + _PIECE_SALT)
            for sets, band in bands.of(sizes):
                band_of = np.full(len(part), -1)
                band_of[sets] = band
                mine = np.flatnonzero(band_of[owner] >= 0)
                count = np.zeros(len(part), np.int64)
                count[sets] = pieces[band]
                begin = np.cumsum(count) - count
                at = begin[owner[mine]] + (place[mine] * count[owner[mine]].astype(np.uint64) >> np.uint64(32)).astype(
                    np.int64
                )
                total = int(count.sum())
                order = np.argsort(at, kind="stable")
                at = at[order]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                value = np.zeros(total, np.uint64)
                value[at[first]] = np.bitwise_xor.reduceat(bit[mine][order], first)
                filled = np.zeros(total, bool)
                filled[at[first]] = True
                doc = np.repeat(np.arange(len(part)), count)
                empty = np.bincount(doc[~filled], minlength=len(part))
                limit = np.zeros(len(part), np.int64)
                limit[sets] = spare[band]
                sent = np.flatnonzero(filled | (empty > limit)[doc])
                piece = (np.arange(total) - begin[doc]).astype(np.uint64)
                where = mix(piece * np.uint64(1 << 12) + band_of[doc].astype(np.uint64))
                key = mix(value + where)[sent]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids[doc[sent]])], ["key", "cid"]
                )


def _verified(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for side_a, texts_a in text_slices(batch.rename_columns(["a", "b", "blob", "other"])):
            _, texts_b = next(text_slices(side_a.select(["b", "other"]).rename_columns(["b", "blob"]), most=1 << 62))
            (oa, ga), (ob, gb) = _sets(texts_a, n), _sets(texts_b, n)
            rows = len(side_a)
            size = np.bincount(oa, minlength=rows) + np.bincount(ob, minlength=rows)
            owner, grams = np.concatenate([oa, ob]), np.concatenate([ga, gb])
            order = np.lexsort((grams, owner))
            owner, grams = owner[order], grams[order]
            twice = (owner[1:] == owner[:-1]) & (grams[1:] == grams[:-1])
            shared = np.bincount(owner[1:][twice], minlength=rows)
            links.append(side_a.filter(pa.array(100 * shared >= percent * (size - shared))).select(["a", "b"]))
        yield from links


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hamming distances of each sketch of ``one`` and each of ``two``, folded to the narrower width."""
    words = min(one.shape[1], two.shape[1])
    one, two = (np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1).view(np.uint64).T for x in (one, two))
    far = np.zeros((one.shape[1], two.shape[1]), np.int64)
    for x, y in zip(one, two, strict=True):
        far += np.bitwise_count(x[:, None] ^ y[None])
    return far


def _near(bands: Bands, nearest: int):
    """Pairs of one block of a bucket, or of two, that differ in component and may be linked.

    Each set sends its ``nearest`` ones; ``cut`` tells that others were held back.
    """

    def pairs(table: pa.Table) -> pa.Table:
        order = np.argsort(table["cid"].to_numpy(), kind="stable")
        cid, root, size, side = (table[c].to_numpy()[order] for c in ("cid", "root", "n", "side"))
        lists = table["sketch"].combine_chunks()
        words, width = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        first, width = (np.cumsum(width) - width)[order], width[order]
        across = bool(side[0] >= 0)  # two blocks: pairs across them
        one = np.flatnonzero(side == side[0])
        two = np.flatnonzero(side != side[0]) if across else one

        def alike(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            """Rows by the width of their sketches, which they come with."""
            parts = [(rows[width[rows] == w], w) for w in np.unique(width[rows])]
            parts = [(x, w) for p, w in parts for x in np.array_split(p, len(p) // BLOCK + 1)]
            return [(x, words[first[x][:, None] + np.arange(w)]) for x, w in parts]

        found = [np.zeros((3, 0), np.int64)]
        others = alike(two)
        for some, ours in alike(one):
            for rest, theirs in others:
                low, high = np.minimum(size[some][:, None], size[rest]), np.maximum(size[some][:, None], size[rest])
                near = (100 * low >= bands.percent * high) & (root[some][:, None] != root[rest])
                if not across:
                    near &= some[:, None] < rest
                if near.any():
                    far = _apart(ours, theirs)
                    x, y = np.nonzero(near & (far <= bands.most(low, high)))
                    found.append(np.stack([some[x], rest[y], far[x, y]]))
        x, y, far = np.concatenate(found, axis=1)
        lower, higher = np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y])
        sent = np.zeros(len(x), bool)
        ends, edge = np.concatenate([x, y]), np.tile(np.arange(len(x)), 2)
        order = np.lexsort((edge, far[edge], ends))
        ends, edge = ends[order], edge[order]
        begin = np.maximum.accumulate(np.where(np.diff(ends, prepend=-1) != 0, np.arange(len(ends)), 0))
        sent[edge[np.arange(len(ends)) - begin < nearest]] = True
        many = int(sent.sum())
        key, cut = np.full(many, table["key"][0].as_py()), np.full(many, not sent.all())
        return pa.table(list(map(pa.array, (key, lower[sent], higher[sent], cut))), ["key", "a", "b", "cut"])

    return pairs


def _possible(a: str, b: str, bands: Bands) -> Column:
    """Sizes and the Hamming distance of the sketches, folded to the narrower one's width, are within the bounds."""
    n, m, one, two = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    words = F.least(F.size(one), F.size(two))

    def folded(x: Column) -> Column:
        def word(i: Column) -> Column:
            at = F.sequence(i, F.size(x) - 1, words)
            return F.aggregate(at, F.lit(0).cast("bigint"), lambda all_, j: all_.bitwiseXOR(x[j]))

        return F.when(F.size(x) == words, x).otherwise(F.transform(F.sequence(F.lit(0), words - 1), word))

    bits = F.zip_with(folded(one), folded(two), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    far = F.aggregate(bits, F.lit(0), lambda all_, x: all_ + x)
    sizes = 100 * F.least(n, m) >= bands.percent * F.greatest(n, m)
    return sizes & (far * (100 + bands.percent) <= (n + m) * (100 - bands.percent))


def similar_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``, ``row``, which tells repeated doc_ids apart, ``root``,
    which names the component, and ``text_md5``.

    Words are lower-cased (A-Z); a text of fewer than ``n`` words is one n-gram, and a null text or one
    without words has no set and no link. Rows of equal sets are one class and linked. Null doc_ids count
    as larger than any; a component of null ids alone has a null id. Sets are compared as 64-bit numbers
    of their n-grams, classes by 128 bits of all of them.
    """
    bands = Bands(percent)
    # Texts are dealt by row once; every join with them below finds them in place.
    texts = keep_bucketed(numbered(docs), "row", "jaccard-texts", dealt=True)
    profiles = keep(texts.mapInArrow(lambda b: lean(_profiles(b, n, bands)), PROFILE), "jaccard-profiles")
    classes = keep(
        profiles.filter("n > 0").groupBy("n", "a", "b").agg(F.min("row").alias("cid")), "jaccard-classes"
    )
    alone = classes.filter(F.col("n") >= int(bands.low[0])).select("cid")
    pieces = (
        texts.select("row", "blob")
        .join(alone, F.col("row") == F.col("cid"))
        .select("cid", "blob")
        .mapInArrow(lambda b: lean(_pieces(b, n, bands)), "key bigint, cid bigint")
    )
    in_bucket = Window.partitionBy("key")
    shared = keep(pieces.withColumn("m", F.count(F.lit(1)).over(in_bucket)).filter("m > 1"), "jaccard-buckets")

    # Hubs are chosen by numbers alone; sketches join the different pairs afterwards. Buckets of much the
    # same sets take the same hub, so their pairs are the same.
    sketches = profiles.select(F.col("row").alias("cid"), "n", "sketch")
    members = shared.withColumn("popular", F.sum("m").over(Window.partitionBy("cid")))
    ranked = Window.partitionBy("key").orderBy(F.desc("popular"), "cid")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = [F.nth_value("cid", i + 1).over(whole) for i in range(SMALL - 1)]
    hubs = F.when(F.col("m") > SMALL, F.array(first[0])).otherwise(F.array(*first))
    pairs = (
        members.select("cid", hubs.alias("hubs"))
        .select("cid", F.explode("hubs").alias("hub"))
        .filter(F.col("hub").isNotNull() & (F.col("hub") != F.col("cid")))
        .select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"))
        .distinct()
    )
    sides = [sketches.select(F.col("cid").alias(c), F.struct("n", "sketch").alias("x" + c)) for c in ("a", "b")]
    tried = pairs.join(sides[0], "a").join(sides[1], "b").filter(_possible("xa", "xb", bands)).select("a", "b")
    tried = keep(tried, "jaccard-pairs")
    links = keep(_verify(tried, texts, n, percent), "jaccard-links")
    roots = components(links)

    crowds = keep(_crowds(shared, roots), "jaccard-crowds")
    for nearest in NEAREST:
        near = keep(_unresolved(crowds, roots, sketches, bands, nearest), "jaccard-near")
        rest = keep(near.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
        if not rest.isEmpty():
            links = keep(links.unionByName(_verify(rest, texts, n, percent)), "jaccard-links")
            roots = components(links)
        held = near.filter("cut").select("key").distinct()
        if held.isEmpty():
            break
        tried = tried.unionByName(rest)
        crowds = crowds.join(held, "key", "left_semi")  # the others have sent all

    roots = roots.select(F.col("node").alias("cid"), "root")
    named = classes.join(roots, "cid", "left").select("n", "a", "b", F.coalesce("root", "cid").alias("root"))
    rows = profiles.select("row", "doc_id", "text_md5", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    rows = rows.select("row", "doc_id", "text_md5", "n", F.coalesce("root", "row").alias("root"))
    rows = keep(rows, "jaccard-rows")
    smallest = rows.groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("component_id"))
    return spread_join(rows, smallest, "root", "_root", ["row"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "row", "root", "text_md5"
    )


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar."""
    one = texts.select(F.col("row").alias("a"), "blob")
    two = texts.select(F.col("row").alias("b"), F.col("blob").alias("other"))
    return (
        pairs.join(one, "a").join(two, "b").select("a", "b", "blob", "other")
        .mapInArrow(lambda batches: lean(_verified(batches, n, percent)), "a bigint, b bigint")
    )


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    found = rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    return found.withColumn("root", F.coalesce("root", "cid"))


def _parts(rows: DataFrame, *by: str) -> DataFrame:
    """Per bucket, of rows ``(*by, cid, root)``: its sets ``m``, its largest component ``main`` with ``k`` of them,
    and ``who``, which tells its sets."""
    return (
        rows.groupBy(*by, "root")
        .agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("who"))
        .groupBy(*by)
        .agg(
            F.max(F.struct("k", "root")).alias("main"),
            F.sum("k").alias("m"),
            F.sum(F.col("who").cast("decimal(38,0)")).alias("who"),
        )
        .select(*by, "m", "who", "main.k", F.col("main.root").alias("main"))
    )


def _crowds(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, cid``: buckets that had more than ``SMALL`` sets and are in several components still, merged.

    Buckets of about the same size with the same most-met set become one, unless that would compare more pairs
    of sets than they do; so all sets of a bucket stay together, and few pairs are in many buckets.
    """
    large = _rooted(shared.filter(F.col("m") > SMALL).select("key", "cid"), roots)
    open_ = _parts(large, "key").filter("k < m")
    open_ = open_.groupBy("m", "who").agg(F.min("key").alias("key"), F.min_by("k", "key").alias("k"))
    rows = large.join(open_.select("key", "m", "k"), "key")
    rows = keep(rows.withColumn("popular", F.sum("m").over(Window.partitionBy("cid"))), "jaccard-open")
    buckets = rows.groupBy("key", "m", "k").agg(F.max_by("cid", F.struct("popular", "cid")).alias("hub"))
    alike = [F.col("hub"), F.floor(F.log2("m")).alias("size")]
    buckets = keep(buckets.select("key", "m", "k", *alike), "jaccard-hubs")
    own = buckets.groupBy("hub", "size").agg(F.min("key").alias("one"), F.sum(F.expr("(m - k) * m")).alias("work"))
    met = rows.select("key", "cid", "root").join(buckets.select("key", "hub", "size"), "key")
    union = _parts(met.select("hub", "size", "cid", "root").distinct(), "hub", "size")
    merged = own.join(union, ["hub", "size"]).filter("(m - k) * m <= work").select("hub", "size", "one")
    to = buckets.join(merged, ["hub", "size"], "left").select("key", F.coalesce("one", "key").alias("to"))
    return rows.join(to, "key").select(F.col("to").alias("key"), "cid").distinct()


def _unresolved(crowds: DataFrame, roots: DataFrame, sketches: DataFrame, bands: Bands, nearest: int) -> DataFrame:
    """``key, a, b, cut``: pairs of merged buckets that are in several components still.

    Sets outside a bucket's largest component, mostly few, meet that component's and each other block by block.
    """
    large = _rooted(crowds, roots)
    open_ = (
        _parts(large, "key")
        .filter("k < m")
        .select(
            "key", "main",
            F.ceil(F.col("k") / BLOCK).cast("int").alias("inside"),
            F.ceil((F.col("m") - F.col("k")) / BLOCK).cast("int").alias("outside"),
        )
    )
    main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("cid"), F.when(main, F.col("inside")).otherwise(F.col("outside"))).cast("int")

    def places(last: Column, place) -> Column:
        return F.transform(F.sequence(F.lit(0), last - 1), place)

    def at(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    met = F.when(main, places(F.col("outside"), lambda o: at(F.col("own"), o, F.lit(0)))).otherwise(
        F.concat(
            places(F.col("inside"), lambda o: at(o, F.col("own"), F.lit(1))),
            places(  # numbered below 0: no block of the largest component
                F.col("outside"),
                lambda o: at(
                    -1 - F.least("own", o),
                    F.greatest("own", o),
                    F.when(F.col("own") == o, F.lit(-1)).otherwise(F.col("own")),
                ),
            ),
        )
    )
    placed = (
        large.join(open_, "key")
        .join(sketches, "cid")
        .withColumn("own", own)
        .select("key", "cid", "root", "n", "sketch", F.explode(met).alias("at"))
        .select("key", "cid", "root", "n", "sketch", "at.i", "at.j", "at.side")
    )
    found = "key bigint, a bigint, b bigint, cut boolean"
    return placed.groupBy("key", "i", "j").applyInArrow(_near(bands, nearest), found)
