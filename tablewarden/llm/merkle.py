"""A Merkle manifest of a table as a persistent tree, changed by path copying.

Every row is a leaf. The leaves of a language, ascending by doc_id, form a tree whose nodes hash two
children each (the last of a level may have one); the roots of all languages, in the languages' order,
form one more tree above.

Leaves are ranked by a range partitioning and cut into aligned blocks of 1024. A block is ten whole
levels of its tree, so a task can build it alone; the block roots are the leaves of the next round, and
so on, each round 1024 times smaller, until one node is left. Every block then learns its way to the
root: per level the sibling and its side.

A tampered leaf makes a new version of the tree. The version shares every untouched node and owns only
copies of the leaf's ancestors: first those inside the leaf's block, then, along the block's way up,
those of the upper rounds. Versions never meet in one place, a block carries at most its own 1024.

Order and ties: null doc_ids come first, rows of one doc_id go by their leaf digest; rows equal in all
five fields are leaves of their own and may change places. A null language is a language of its own
and comes first. A null field hashes as ``-``. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.store import keep

BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_BY = 7


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(changed: dict[str, Column] | None = None) -> Column:
    """The binary digest of a row's leaf, some fields replaced."""
    fields = [(changed or {}).get(name, F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def is_tampered(doc_id: Column) -> Column:
    """True where 7 divides the crc32 of the id; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED_BY == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree`` (the language, null first), ``doc_id``, ``digest`` and ``tampered`` of every row.

    ``tampered`` is the digest with n_chars one higher (a null count stays), null for rows left alone.
    """
    higher = F.col("n_chars").cast("decimal(20,0)") + F.lit(1)  # the largest long has a successor too
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_digest().alias("digest"),
        F.when(is_tampered(F.col("doc_id")), leaf_digest({"n_chars": higher})).alias("tampered"),
    )


def ranked(rows: DataFrame, tree: str, order: list[str], label: str) -> DataFrame:
    """Add ``pos`` from 0 and the ``size`` of the tree, by one range partitioning and a few totals.

    The row number is part of the range, so a much repeated key is spread as well. What is totalled has
    a row per partition and tree it holds.
    """
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), label + "-rows")
    by = [tree, *order, "_row"]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    )
    placed = keep(placed.drop("_row"), label + "-placed")
    runs = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        tree,
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("size"),
    )
    return placed.join(runs, [tree, "_part"]).select(
        *[c for c in placed.columns if c not in ("_part", "_at")],
        (F.col("_at") + F.col("_shift")).alias("pos"),
        "size",
    )


def parent(*children: bytes) -> bytes:
    """The hash of the children's digests as lowercase hex text."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def block_levels(digests: list[bytes], first: int, size: int, bits: int = BITS) -> list[list[bytes]]:
    """All levels of a block whose first leaf is at ``first`` of a tree with ``size`` leaves.

    The block of a larger tree has exactly ``bits`` levels above its leaves; that of a tree which it
    fills alone ends with the tree's only node.
    """
    levels, alone = [digests], first == 0 and size <= 1 << bits
    for _ in range(bits):
        now = levels[-1]
        if alone and len(now) == 1:
            break
        levels.append([parent(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return levels


def way_up(levels: list[list[bytes]], index: int) -> list[bytes]:
    """Per level of the block: ``L`` or ``R`` and the sibling on that side, or nothing for an only child."""
    way = []
    for level in levels[:-1]:
        if index & 1:
            way.append(b"L" + level[index - 1])
        elif index + 1 < len(level):
            way.append(b"R" + level[index + 1])
        else:
            way.append(b"")
        index >>= 1
    return way


def copied(digest: bytes, way: list[bytes]) -> list[bytes]:
    """The new ancestors of a changed node along its way: all that its version does not share."""
    copies = []
    for step in way:
        if step[:1] == b"L":
            digest = parent(step[1:], digest)
        elif step:
            digest = parent(digest, step[1:])
        else:
            digest = parent(digest)
        copies.append(digest)
    return copies


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos").combine_chunks()


def _fold_block(table: pa.Table, bits: int) -> pa.Table:
    """A block's root, and the way of each of its nodes up to that root."""
    table = _sorted(table)
    digests, first = table["digest"].to_pylist(), table["pos"][0].as_py()
    size = table["size"][0].as_py()
    levels = block_levels(digests, first, size, bits)
    return pa.table(
        {
            "tree": table["tree"],
            "pos": table["pos"],
            "way": pa.array([way_up(levels, i) for i in range(len(digests))], pa.list_(pa.binary())),
            "above": pa.array([first >> bits] * len(digests), pa.int64()),
            "top": pa.array([levels[-1][0]] * len(digests), pa.binary()),
            "rounds": pa.array([-(-size >> bits)] * len(digests), pa.int64()),
        }
    )


FOLDED = "tree string, pos bigint, way array<binary>, above bigint, top binary, rounds bigint"


def ways(nodes: DataFrame, bits: int = BITS, label: str = "merkle") -> DataFrame:
    """``tree, pos, way, root``: the whole way of each node ``(tree, pos, digest, size)`` to its tree's root.

    Rounds of blocks go up until each tree is one node, then the ways come down again, joined by block.
    """
    going, done = [], nodes
    while True:
        grouped = done.withColumn("_block", F.shiftright("pos", bits)).groupBy("tree", "_block")
        folded = keep(grouped.applyInArrow(lambda t: _fold_block(t, bits), FOLDED), label + "-blocks")
        going.append(folded)
        if folded.filter("rounds > 1").isEmpty():
            break
        # Trees that are one node already stay so: a lone node of a tree of one has no levels above.
        done = folded.groupBy("tree", F.col("above").alias("pos")).agg(
            F.first("top").alias("digest"), F.first("rounds").alias("size")
        )
    found = going[-1].select("tree", "pos", "way", F.col("top").alias("root"))
    for folded in reversed(going[:-1]):
        upper = found.select("tree", F.col("pos").alias("above"), F.col("way").alias("_more"), "root")
        found = folded.join(upper, ["tree", "above"]).select(
            "tree", "pos", F.concat("way", "_more").alias("way"), "root"
        )
    return found


MANIFEST = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
    "verified boolean, copies array<binary>"
)


def _proved(table: pa.Table, above: pa.Table, bits: int) -> pa.Table:
    """The rows of one block of leaves, each proved, and its version's copied ancestors if tampered."""
    table = _sorted(table)
    digests, first = table["digest"].to_pylist(), table["pos"][0].as_py()
    levels = block_levels(digests, first, table["size"][0].as_py(), bits)
    upper = above["way"][0].as_py()
    subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
    out = {n: [] for n in ("leaf", "proof_sha256", "folded_root", "verified", "copies")}
    for i, (digest, other) in enumerate(zip(digests, table["tampered"].to_pylist(), strict=True)):
        way = way_up(levels, i) + upper
        copies = copied(digest if other is None else other, way)
        end = copies[-1] if copies else (digest if other is None else other)
        out["leaf"].append(digest.hex())
        out["proof_sha256"].append(hashlib.sha256(b"".join(s[1:].hex().encode() for s in way)).hexdigest())
        out["folded_root"].append(end.hex())
        out["verified"].append(end == root)
        out["copies"].append(None if other is None else copies)
    same = pa.array([root.hex()] * len(digests))
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "leaf": pa.array(out["leaf"], pa.string()),
            "subroot": pa.array([subroot.hex()] * len(digests)),
            "root": same,
            "proof_sha256": pa.array(out["proof_sha256"], pa.string()),
            "folded_root": pa.array(out["folded_root"], pa.string()),
            "verified": pa.array(out["verified"], pa.bool_()),
            "copies": pa.array(out["copies"], pa.list_(pa.binary())),
        }
    )


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copies``.

    ``copies`` are the nodes that a tampered row's version owns, from its leaf's parent to its root; all
    others it shares with the untampered tree. It is null for untampered rows, whose ``folded_root`` is
    folded from their own leaf.
    """
    placed = keep(ranked(leaves(docs), "tree", ["doc_id", "digest"], "merkle"), "merkle-leaves")
    grouped = placed.select("tree", "pos", "digest", "size").withColumn("_block", F.shiftright("pos", bits))
    # The leaves' own ways are found again where they are used: only block roots go up.
    tops = keep(
        grouped.groupBy("tree", "_block").applyInArrow(
            lambda t: _top(t, bits), "tree string, pos bigint, digest binary, size bigint"
        ),
        "merkle-tops",
    )
    trees = keep(ways(tops, bits), "merkle-ways")
    subroots = trees.filter("pos = 0").select("tree", F.col("root").alias("digest"))
    forest = ranked(subroots.withColumn("all", F.lit("")), "all", ["tree"], "merkle-forest")
    forest = keep(forest, "merkle-subroots")
    above = ways(forest.select(F.col("all").alias("tree"), "pos", "digest", "size"), bits, "merkle-forest")
    above = above.withColumnRenamed("way", "_over").drop("tree")
    named = forest.select("tree", "pos", F.col("digest").alias("subroot")).join(above, "pos").drop("pos")
    full = trees.drop("root").join(named, "tree").select(
        "tree", F.col("pos").alias("_block"), F.concat("way", "_over").alias("way"), "subroot", "root"
    )
    left = placed.withColumn("_block", F.shiftright("pos", bits)).groupBy("tree", "_block")
    return left.cogroup(full.groupBy("tree", "_block")).applyInArrow(
        lambda t, a: _proved(t, a, bits), MANIFEST
    )


def _top(table: pa.Table, bits: int) -> pa.Table:
    """The root of one block of leaves, as a leaf of the next round."""
    table = _sorted(table)
    first, size = table["pos"][0].as_py(), table["size"][0].as_py()
    top = block_levels(table["digest"].to_pylist(), first, size, bits)[-1][0]
    return pa.table(
        {
            "tree": table["tree"].slice(0, 1),
            "pos": pa.array([first >> bits], pa.int64()),
            "digest": pa.array([top], pa.binary()),
            "size": pa.array([-(-size >> bits)], pa.int64()),
        }
    )
