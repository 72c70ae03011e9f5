"""Quality rules, Merkle manifest and clustering against brute force, on hand-made rows and via SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, duck_rows, spark_rows

from tablewarden.llm import centroids, merkle, perplexity, queries
from tablewarden.llm.oracle import ORACLE_SQL
from tablewarden.llm.words import mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos long, tree string, tongue string"


def documents(spark, rows, parts=3):
    """``(doc_id, text, lang, source, n_chars)`` and columns named as the operators name their own."""
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS).repartition(parts)


@pytest.mark.parametrize(
    "name",
    ["op3_jaccard_join", "op7_chat_formatting", "op10_substring_dedup", "op12_merkle_manifest", "op13_centroid_clustering"],
)
def test_query_matches_reference_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == duck_rows(connect(sf), ORACLE_SQL[name])


# ---- Merkle manifest -----------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_brute(doc_id, text, lang, source, n_chars):
    spelled = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return h(*spelled)


def climb_brute(level, index, changed):
    """The node at ``index`` exchanged: all siblings on its way, and the root then."""
    proof = []
    while len(level) > 1:
        pair = level[index - index % 2 : index - index % 2 + 2]
        proof += [x for i, x in enumerate(pair) if i != index % 2]
        pair[index % 2] = changed
        changed = h(*pair)
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        index //= 2
    return proof, changed


def root_brute(level):
    while len(level) > 1:
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def manifest_brute(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_brute(*r)))
    subroots = [root_brute([leaf_brute(*r) for r in trees[t]]) for t in order]
    root, out = root_brute(subroots), []
    for k, t in enumerate(order):
        level = [leaf_brute(*r) for r in trees[t]]
        for i, r in enumerate(trees[t]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            other = leaf_brute(*r[:4], r[4] + 1) if hit and r[4] is not None else level[i]
            proof, top = climb_brute(level, i, other)
            more, folded = climb_brute(subroots, k, top)
            out.append((r[0], level[i], subroots[k], root, h(*proof, *more), folded, folded == root))
    return sorted(out, key=str)


EDGES = [
    (None, None, None, None, None), (None, "", "en", "s", 0), (5, "ü", None, "s", 1), (5, "ü", None, "s", 1),
    (7, "x", "", None, (1 << 63) - 1), (7, "x" * 50_000, "de", "s", 50_000), (-3, "a:b", "Z", "", -1),
]


@pytest.mark.parametrize("bits", [1, 2, 10])
@pytest.mark.parametrize("count", [1, 7, 75])
def test_manifest_matches_brute_force(spark, bits, count):
    pick = random.Random(count)
    rows = (EDGES + [(pick.randrange(60), f"t{i}", pick.choice(["en", "en", "fr", "é"]), "s", i) for i in range(count)])[:count]
    got = merkle.manifest(documents(spark, rows), bits=bits).drop("copies").collect()
    assert sorted(map(tuple, got), key=str) == manifest_brute(rows)


def test_manifest_across_blocks_and_versions_own_only_ancestors(spark):
    rows = [(i, f"t{i}", "en" if i % 400 else "de", "s", i) for i in range(1300)]
    got = merkle.manifest(documents(spark, rows)).collect()
    assert sorted(map(lambda r: tuple(r)[:7], got), key=str) == manifest_brute(rows)
    for r in got:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7:
            assert r["copies"] is None
        else:  # 11 levels for the 1,296 texts, two for the four, one above both
            assert len(r["copies"]) == (12 if r["doc_id"] % 400 else 3)
            assert r["copies"][-1].hex() == r["folded_root"] != r["root"]


# ---- clustering ------------------------------------------------------------------------------------


def clusters_brute(rows, dims, k, rounds):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**50 else 1024 * int(x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in named[:k]]

    def far(v, c):
        return sum((a - b) ** 2 for a, b in zip(v, c, strict=True))

    def assign():
        return [min(range(len(middle)), key=lambda j: (far(v, middle[j]), j)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(middle)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                middle[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at, most = assign(), (1 << 63) - 1
    gap = [min(far(v, middle[a]), most) for (_, v), a in zip(kept, at, strict=True)]
    each = Counter()
    for a, d in zip(at, gap, strict=True):
        each[a] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(
        [(i, a, d, min(each[a], most), min(sum(gap), most), digest[a]) for (i, _), a, d in zip(kept, at, gap, strict=True)],
        key=str,
    )


VECTORS = "vec_id long, embedding array<double>, cluster string, distance string, vector long, pivots long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("wide", [0.0, 1e30])
def test_clusters_match_brute_force(spark, wide):
    pick = random.Random(5)
    rows = [(i, [pick.gauss(i % 3, 0.4) for _ in range(4)]) for i in range(120)]
    rows += [(200, [0.5] * 4)] * 5 + [(None, [0.1] * 4), (201, None), (202, [0.1] * 3), (203, [0.1, None, 0.2, 0.3]),
             (204, [0.1, math.nan, 0.2, 0.3]), (205, [0.1, math.inf, 0.2, 0.3]), (206, [0.0] * 4), (207, [])]
    if wide:
        rows += [(300, [wide, -wide, 0.0, 1.0]), (301, [wide, -wide, 0.25, 1.0])]
    found = centroids.cluster(vectors(spark, rows), dims=4, k=5, rounds=4)
    got = centroids.with_inertia(found).collect()
    assert sorted(map(tuple, got), key=str) == clusters_brute(rows, 4, 5, 4)
    assert len(found.measured) == 4 and all(0 < m <= 1 for m in found.measured)


def test_fewer_vectors_than_centroids_and_pruning_keeps_ties(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])]
    got = centroids.with_inertia(centroids.cluster(vectors(spark, rows), dims=2, k=8, rounds=2)).collect()
    assert sorted(map(tuple, got), key=str) == clusters_brute(rows, 2, 8, 2)
    x = np.array([[0, 0], [10, 0], [5, 0], [5, 1]])
    middle = np.array([[0, 0], [10, 0], [5, 0], [5, 0]])
    pivots = np.array([[0, 0], [3, 4]])
    at, gap, measured = centroids.nearest(
        x, centroids.pivot_distances(x, pivots), middle, centroids.pivot_distances(middle, pivots)
    )
    assert at.tolist() == [0, 1, 2, 2] and gap.tolist() == [0, 0, 0, 1] and measured < 16


# ---- quality rules -----------------------------------------------------------------------------------


def base_brute(text):
    raw = text or ""
    words = raw.encode().split()
    plain = [w.decode() for w in words]
    lines = [line for line in raw.split("\n") if line.encode().split()]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    return (
        len(words), sum(map(len, plain)), sum(raw.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)
    )


def bytes_of(text):
    return b"".join(b" " + w for w in (text or "").encode().split())[1:] + (
        b" " if (text or "").encode()[-1:].isspace() and (text or "").encode().split() else b""
    )


class KneserNey:
    """Modified Kneser-Ney by dictionaries, order 5, over the byte streams of some texts."""

    def __init__(self, texts):
        self.count = [Counter() for _ in range(6)]
        for s in texts:
            s = b"    " + s
            for i in range(4, len(s)):
                self.count[5][s[i - 4 : i + 1]] += 1
        for o in (4, 3, 2, 1):
            for gram in self.count[o + 1]:
                self.count[o][gram[1:]] += 1
        self.off, self.of = [None] * 6, [None] * 6
        for o in range(1, 6):
            t = Counter(self.count[o].values())
            y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.0
            d, last = [], 0.0
            for i in (1, 2, 3):
                last = min(max(i - (i + 1) * y * t[i + 1] / t[i], 0.0), i) if t[i] else last
                d.append(last)
            self.off[o], self.of[o] = d, defaultdict(list)
            for gram, n in self.count[o].items():
                self.of[o][gram[:-1]].append(n)

    def p(self, gram):
        o, n = len(gram), self.count[len(gram)][gram]
        d, beside = self.off[o], self.of[o][gram[:-1]]
        taken = sum(d[min(m, 3) - 1] for m in beside)
        below = 1 / 256 if o == 1 else self.p(gram[1:])
        return (n - d[min(n, 3) - 1] + taken * below) / sum(beside)


def texts_for_rules():
    pick = random.Random(3)
    parts = ["ka", "lo", "mi", "ter", "uns", "é", "pra"]
    word = lambda: "".join(pick.choice(parts) for _ in range(pick.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(30)), pick.choice(["en", "fr"]), "s", 1) for i in range(60)]
    line = " ".join(word() for _ in range(9))
    rows += [
        (100, None, "en", "s", 1), (101, "", None, "s", 1), (102, " \n\t", "en", "s", 1), (None, "a b c", "en", "s", 1),
        (103, f"{line}\n{line}\n\n \n{line} ", "fr", "s", 1), (104, "x " * 60, "en", "s", 1), (105, rows[0][1], "en", "s", 1),
        (105, rows[0][1], "en", "s", 1), (106, "#&|" * 40 + " q" * 30, "en", "s", 1), (107, " ß x y", None, "s", 1),
        (108, " ".join(chr(0x4E00 + pick.randrange(900)) * 3 for _ in range(40)), "en", "s", 1),
        (109, "  lead\r\nand  trail \n" * 3, "", "s", 1), (110, " ".join(word() for _ in range(20_000)), "fr", "s", 1),
    ]
    return rows


def test_quality_rules_match_brute_force(spark):
    rows = texts_for_rules()
    got = perplexity.verdicts(documents(spark, rows), least=20).collect()
    models = {t: KneserNey([bytes_of(r[1]) for r in rows if r[2] == t]) for t in {r[2] for r in rows}}
    expected, scored = [], defaultdict(list)
    for doc_id, text, lang, *_ in rows:
        base, s, lp = base_brute(text), bytes_of(text), None
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        if s:
            padded = b"    " + s
            lp = -sum(math.log(models[lang].p(padded[i - 4 : i + 1])) for i in range(4, len(padded))) / len(s)
        if not failed:
            scored[lang].append(math.floor(lp * 1000))
        expected.append([doc_id, *base, failed, lp, lang])
    limits = {}
    for lang, found in scored.items():
        if len(found) >= 20:
            found.sort()
            q1, q3 = (found[-(-i * len(found) // 4) - 1] for i in (1, 3))
            wide = max(q3 - q1, 20)
            limits[lang] = ((q1 - 6 * wide) / 1000, (q3 + 3 * wide) / 1000)
    for e in expected:
        low, high = limits.get(e[8], (-math.inf, math.inf))
        e.append(not e[6] and low <= e[7] <= high)
    key = lambda e: str((e[0], e[1], e[2], e[3], e[4], e[5]))
    expected.sort(key=key)
    found = sorted(([*tuple(r)[:7], r["log_perplexity"], r["kept"]] for r in got), key=key)
    assert [e[:7] for e in expected] == [f[:7] for f in found]
    assert [e[9] for e in expected] == [f[8] for f in found]
    for e, f in zip(expected, found, strict=True):
        assert (e[7] is None) == (f[7] is None) and (e[7] is None or abs(e[7] - f[7]) < 1e-5)
    assert not all(e[9] for e in expected if not e[6])  # some text is rejected by its band alone


def test_lookup_and_windows_do_not_depend_on_cuts(monkeypatch):
    data, offsets = perplexity.text_bytes(pa.array([" ab  c\n", "", None, "x", "\t\t", "long " * 50]))
    out, sizes = perplexity.stream(data, offsets)
    assert sizes.tolist() == [5, 0, 0, 1, 0, 250]
    whole = perplexity.different_grams(out, sizes)
    monkeypatch.setattr(perplexity, "WINDOW", 7)
    parts = perplexity.different_grams(out, sizes)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and whole[1].sum() == 256
    hashes = np.sort(mix(whole[0]))
    assert (perplexity.Lookup(hashes).places(hashes[::-1]) == np.arange(len(hashes))[::-1]).all()


def test_slices_are_never_shuffled_again(spark):
    plan = perplexity.scores(documents(spark, texts_for_rules()))._jdf.queryExecution().executedPlan().toString()
    cogroup = plan[plan.index("FlatMapCoGroupsInArrow") :]
    assert "Bucketed: true" in cogroup.split("Exchange")[0]


def test_empty_tables(spark):
    none = documents(spark, EDGES).limit(0)
    assert merkle.manifest(none).count() == 0
    assert perplexity.verdicts(none).count() == 0
    assert centroids.with_inertia(centroids.cluster(vectors(spark, [(1, [0.1])]), dims=64)).count() == 0
