"""Duplicates: exact groups, near copies and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import jaccard_join
from tablewarden.llm.exact_dedup import exact_groups
from tablewarden.llm.jaccard_join import similar_components
from tablewarden.llm.substring_dedup import Tree, prefix_lengths, removal_digests, repeated_passages

SCHEMA = "doc_id long, text string, row string, name string, _m long"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(3)


EDGES = [
    (1, "a b"), (2, "a\tb"), (2, None), (3, ""), (None, "a  b"), (2, "a b"), (2, "a b"), (None, None),
    (9, "abcdefghijkl" * 9), (8, "abcdefghijkl" * 9), (7, "abcdefghijkm" * 9), (10, " \r\n "), (11, " "),
]


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for norm, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [2, 64])
def test_exact_groups_match_brute_force_even_if_addresses_meet(spark, bits):
    got = exact_groups(frame(spark, EDGES), block_bytes=8, address_bits=bits).collect() if bits == 64 else (
        exact_groups(frame(spark, EDGES[:6]), block_bytes=64, address_bits=bits).collect()
    )
    assert sorted(map(tuple, got), key=str) == exact_brute(EDGES if bits == 64 else EDGES[:6])


def similar_brute(rows, n, percent):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] or ([tuple(words)] if words else [])
        sets.append(set(grams))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_near_copies_match_brute_force(spark, n, percent):
    pick = random.Random(7)
    rows = [(100, None), (101, ""), (102, "a b"), (103, "A b"), (None, "a  B"), (104, "q w e r t y"),
            (104, "q w e r t y u"), (105, " "), (None, "Ä b c d"), (106, "ä b c d")]
    for i in range(90):  # a crowd around the threshold, larger than a bucket tries at once
        words = [f"w{k}" for k in range(60)]
        for _ in range(pick.randint(0, 4)):
            words[pick.randrange(60)] = f"x{pick.randrange(9)}"
        rows.append((i, " ".join(words)))
    got = similar_components(frame(spark, rows), n, percent).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == similar_brute(rows, n, percent)


def around(base, rows, most, pick, shift=0):
    """Copies of a text of ``base`` words, each with up to ``most`` words of its own."""
    out = []
    for i in range(rows):
        words = [f"w{k}" for k in range(base)]
        for _ in range(pick.randint(0, most)):
            words[pick.randrange(base)] = f"x{pick.randrange(10**6)}"
        out.append((shift + i, " ".join(words)))
    return out


def test_near_copies_are_not_tried_against_a_hub_for_each_bucket(spark, monkeypatch):
    rows = around(200, 400, 3, random.Random(11))
    tried, keep = {}, jaccard_join.keep
    monkeypatch.setattr(jaccard_join, "keep", lambda df, label: tried.setdefault(label, keep(df, label)))
    got = similar_components(frame(spark, rows), 5, 80).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == similar_brute(rows, 5, 80)
    assert tried["jaccard-pairs"].count() < 5 * len(rows)


def test_near_copies_sent_in_rounds_match_brute_force(spark, monkeypatch):
    """Blocks of 8 sets; each set sends one candidate of a pair of blocks first."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "NEAREST", (1, 2, 1 << 30))
    rows = around(200, 120, 9, random.Random(5)) + [(200, "w1 w2"), (201, None)]
    got = similar_components(frame(spark, rows), 5, 80).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == similar_brute(rows, 5, 80)


def kept_by_label(monkeypatch):
    kept, keep = {}, jaccard_join.keep
    monkeypatch.setattr(jaccard_join, "keep", lambda df, label: kept.setdefault(label, []).append(keep(df, label)) or kept[label][-1])
    return kept


def test_large_sets_that_share_half_their_words_are_no_candidates(spark, monkeypatch):
    """Sets of 2,996 n-grams and similarity 1/3, which meet in many buckets."""
    kept = kept_by_label(monkeypatch)
    rows = [(i, " ".join(f"w{k}" if k < 1500 else f"x{i}-{k}" for k in range(3000))) for i in range(24)]
    rows.append((24, rows[3][1] + " more"))
    got = similar_components(frame(spark, rows), 5, 80).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == similar_brute(rows, 5, 80)
    assert kept["jaccard-pairs"][0].count() == 1 and sum(x.count() for x in kept["jaccard-near"]) == 0


def test_sets_that_just_miss_are_not_sent_by_every_bucket(spark, monkeypatch):
    """Sets of 398 n-grams that differ in 48, where linked ones may differ in 41: they meet in many buckets."""
    kept = kept_by_label(monkeypatch)
    rows = [(i, " ".join(f"x{i}-{k}" if k % 100 == 8 * i else f"w{k}" for k in range(400))) for i in range(12)]
    got = similar_components(frame(spark, rows), 3, 90).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == similar_brute(rows, 3, 90)
    near = kept["jaccard-near"][0]
    assert 0 < near.count() < 8 * near.select("a", "b").distinct().count()


def test_distances_of_folded_sketches(spark):
    """Sketches of 16 and 8 words compare as if both had 8."""
    pick = np.random.default_rng(3)
    wide, narrow = (pick.integers(-(2**63), 2**63 - 1, (4, w)) for w in (16, 8))
    folded = wide[:, :8] ^ wide[:, 8:]
    want = [[sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) for b in narrow] for a in folded]
    assert jaccard_join._apart(wide, narrow).tolist() == want
    assert jaccard_join._apart(narrow, wide).T.tolist() == want
    bands = jaccard_join.Bands(80)
    sets = [spark.createDataFrame([(1000, x[0].tolist())], "n bigint, sketch array<bigint>") for x in (wide, narrow)]
    both = sets[0].select(F.struct("*").alias("xa")).crossJoin(sets[1].select(F.struct("*").alias("xb")))
    for reached in (want[0][0], want[0][0] - 1):
        sized = both.withColumn("xa", F.col("xa").withField("n", F.lit(reached * 9 // 2)))
        sized = sized.withColumn("xb", F.col("xb").withField("n", F.lit(reached * 9 - reached * 9 // 2)))
        assert sized.filter(jaccard_join._possible("xa", "xb", bands)).count() == (reached == want[0][0])


@pytest.mark.parametrize("side", [[-1] * 6, [0, 0, 1, 1, 1, 1]])
def test_candidates_held_back_are_told(side):
    """Six equal sketches; the first two sets are of one component already, or of one block."""
    columns = {"key": [7] * 6, "cid": [3, 1, 5, 2, 6, 4], "root": [1, 1, 5, 2, 6, 4], "n": [100] * 6, "side": side}
    table = pa.table(columns | {"sketch": pa.array([[9] * jaccard_join.SKETCH_WORDS] * 6, pa.list_(pa.int64()))})
    apart = {(a, b) for a in (1, 2, 3, 4, 5, 6) for b in range(a + 1, 7)} - {(1, 3)}
    possible = {p for p in apart if side[0] < 0 or len({1, 3} & set(p)) == 1}
    few, every = (jaccard_join._near(jaccard_join.Bands(80), most)(table).to_pylist() for most in (1, 9))
    assert {(r["a"], r["b"]) for r in every} == possible and len(every) == len(possible)
    assert not any(r["cut"] for r in every) and {r["key"] for r in every} == {7}
    assert len(few) < len(every) and all(r["cut"] for r in few)
    assert {i for r in few for i in (r["a"], r["b"])} == {1, 2, 3, 4, 5, 6}


def passages_brute(rows, size):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - size + 1):
            window = tuple(words[s : s + size])
            if window in seen:
                gone[s : s + size] = [True] * size
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [1, 1 << 20])
def test_repeated_passages_match_brute_force(spark, group):
    rows = [(1, "a b c d e f g"), (2, "x b c d e f y a b c d e f"), (3, None), (4, ""), (None, "a b c d e f g"),
            (5, "z " * 40), (6, "b c d"), (7, "b c d e"), (8, "A b c d e"), (8, "A b c d e")]
    got = removal_digests(repeated_passages(frame(spark, rows), words=4, short=2, group_suffixes=group))
    assert sorted(map(tuple, got.collect()), key=str) == passages_brute(rows, 4)


@pytest.mark.parametrize("group", [1, 40, 1 << 20])
def test_repeated_passages_of_random_texts(spark, group):
    pick = random.Random(3)
    rows = []
    for i in range(60):  # few words, so that windows of six repeat now and then, and often after one word
        words = [pick.choice("abcd") for _ in range(pick.randrange(40))]
        rows.append((pick.randrange(50), " ".join(["x"] * pick.randrange(9) + words)))
    kept = {}
    rows = [r for r in rows if kept.setdefault(r[0], r) is r]
    got = removal_digests(repeated_passages(frame(spark, rows), words=6, short=3, group_suffixes=group))
    assert sorted(map(tuple, got.collect()), key=str) == passages_brute(rows, 6)


def test_suffix_tree_depths():
    pick = np.random.default_rng(1)
    letters = pick.integers(0, 3, (6, 200)).astype(np.uint8)
    window = np.array([hash(tuple(c)) % (1 << 60) for c in letters.T.tolist()], np.uint64)
    window[7] += np.uint64(1)  # other words with the same letters
    place = np.arange(200)
    tree = Tree(letters, window, (place,))
    words = [tuple(c) for c in letters.T.tolist()]
    assert [words[i] for i in tree.order] == sorted(words)
    for k in range(1, 200):
        a, b = tree.order[k - 1], tree.order[k]
        shared = next((i for i in range(6) if words[a][i] != words[b][i]), 6)
        assert tree.depth[k] == (5 if shared == 6 and window[a] != window[b] else shared)
    seen, again = set(), []
    for i in place:
        again += [i] * (window[i] in seen)
        seen.add(window[i])
    assert sorted(tree.below(6)) == again
    assert prefix_lengths(20) == [4, 8, 12, 16, 20]


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert exact_groups(none).count() == 0
    assert similar_components(none).count() == 0
    assert repeated_passages(none).count() == 0
