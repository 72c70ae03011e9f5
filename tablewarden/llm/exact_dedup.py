"""Exact duplicates by deterministic block naming.

A normalized text is cut into fixed-size blocks. Equal blocks get one integer name from a sort of the
different blocks; then adjacent names are paired, equal pairs get one new name, and so on until a
document is one name. Two documents end with the same name after the same number of rounds exactly
if they are equal: no step compares digests in place of content.

Each block is addressed by 128 bits so that its content crosses the network once, and that the
addresses of different blocks differ is checked, not assumed: if two ever agree, the next seed is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.store import keep

BLOCK_BYTES = 2048
SPACES = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _blocks(content: Column, block_bytes: int) -> Column:
    """Blocks of a binary column; an empty text is one empty block."""
    last = F.greatest(F.floor((F.octet_length(content) - 1) / block_bytes), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(content, i * block_bytes + 1, F.lit(block_bytes))
    )


def _address(block: Column, seed: int, bits: int) -> Column:
    parts = [F.xxhash64(F.lit(seed), block), F.xxhash64(block, F.lit(seed + 1))]
    if bits < 64:
        parts = [F.pmod(p, F.lit(1 << bits)) for p in parts]
    return F.struct(parts[0].alias("a"), parts[1].alias("b"))


def _named(keys: DataFrame, by: list[str], label: str) -> DataFrame:
    """Different keys, sorted and numbered; the table is written so that names stay."""
    keep_columns = [c for c in by if c != "block"]
    numbered = keys.sortWithinPartitions(*by).select(
        *keep_columns, F.monotonically_increasing_id().alias("name")
    )
    return keep(numbered, label)


def identities(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, address_bits: int = 64, seed: int = 17
) -> DataFrame:
    """One row per document: ``row``, ``doc_id``, ``text_sha256``, ``rounds``, ``name``.

    Two rows have the same ``(rounds, name)`` exactly if their normalized texts are equal. ``row`` tells
    repeated doc_ids apart. A null text counts as empty. Only ``doc_id`` and ``text`` are read, so
    other columns may have any name. ``address_bits`` is for tests that force equal addresses.
    """
    content = docs.select("doc_id", normalized(F.col("text")).cast("binary").alias("content"))
    for _ in range(64):
        rows = keep(
            content.select(
                F.monotonically_increasing_id().alias("row"),
                "doc_id",
                F.sha2("content", 256).alias("text_sha256"),
                F.transform(
                    _blocks(F.col("content"), block_bytes),
                    lambda block: _address(block, seed, address_bits),
                ).alias("addresses"),
            ),
            "dedup-rows",
        )
        block = content.select(F.explode(_blocks(F.col("content"), block_bytes)).alias("block"))
        different = block.select(_address(F.col("block"), seed, address_bits).alias("k"), "block")
        different = different.select("k.a", "k.b", "block").distinct()
        names = _named(different, ["a", "b", "block"], "dedup-names")
        if names.groupBy("a", "b").count().filter("count > 1").isEmpty():
            break
        seed += 2
    else:
        raise ValueError(f"no seed tells the blocks apart in {address_bits} bits")

    longest = rows.agg(F.max(F.size("addresses"))).first()[0] or 0
    level = (
        rows.select("row", F.size("addresses").alias("n"), F.posexplode("addresses").alias("pos", "k"))
        .select("row", "n", "pos", "k.a", "k.b")
        .join(names, ["a", "b"])
        .select("row", "n", "pos", "name")
    )
    done, rounds = [], 0
    while True:
        if longest > 1:
            level = keep(level, "dedup-level")
        done.append(level.filter("n = 1").select("row", F.lit(rounds).alias("rounds"), "name"))
        if longest <= 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = (
            level.filter("n > 1")
            .groupBy("row", "n", F.shiftright("pos", 1).alias("at"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        names = _named(pairs.select("left", "right").distinct(), ["left", "right"], "dedup-names")
        level = pairs.join(names, ["left", "right"]).select(
            "row", F.shiftright(F.col("n") + 1, 1).alias("n"), F.col("at").alias("pos"), "name"
        )
        longest, rounds = (longest + 1) // 2, rounds + 1
    all_done = done[0]
    for more in done[1:]:
        all_done = all_done.unionByName(more)
    return rows.select("row", "doc_id", "text_sha256").join(all_done, "row")


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The smallest doc_id of a group stays; a null doc_id comes last, and of rows that repeat one doc_id
    exactly one stays. An empty table gives no rows.
    """
    named = keep(identities(docs, **options), "dedup-identities")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = named.groupBy("rounds", "name").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    return named.join(groups, ["rounds", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )
