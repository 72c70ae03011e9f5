"""Equi-joins that stay balanced when one key holds a large share of the rows.

A plain inner join of two relations is left to Spark: adaptive execution splits
a skewed partition of either side. Two cases are not covered by it and are built
here: the optional side of an outer join, and a lookup side that was grouped by
the key before, because then the join has no shuffle of its own to split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Copies of the lookup side in spread_join. Few are enough: what matters most is
# that the join shuffles anew, so adaptive execution can split further.
SALTS = 4


def spread_join(
    rows: DataFrame,
    lookup: DataFrame,
    rows_key: str,
    lookup_key: str,
    spread_by: list[str],
    how: str = "inner",
) -> DataFrame:
    """Join many rows to a grouped lookup side (at most one row per key).

    Rows of one key go to several partitions by a hash of ``spread_by``; the
    lookup side is copied to each of them. ``how`` may be inner, left, left_semi
    or left_anti. The two keys must have different names.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    meets = (F.col(rows_key) == F.col(lookup_key)) & (F.col("_salt") == F.col("_copy"))
    return salted.join(copies, meets, how).drop("_salt", "_copy")


def hashable(df: DataFrame) -> list[str]:
    """Columns whose values can be hashed to spread rows."""
    return [
        f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]


# Heavy keys looked for on a side of an outer join, and items the sketch tracks for that.
HEAVY_KEYS, TRACKED = 256, 2048
# Salts per task that a heavy key needs: several, so that they fall evenly on the tasks.
SALTS_PER_TASK = 4


def heavy_keys(df: DataFrame, key: str) -> dict:
    """Keys that hold more than a task's share of the rows, each with how many salts it needs.

    One pass over the key column with a frequent-items sketch; what comes back has at most
    ``HEAVY_KEYS`` entries. The None entry stands for rows without a key.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = df.agg(
        F.expr(f"approx_top_k(`{key}`, {HEAVY_KEYS}, {TRACKED})").alias("top"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(key).isNull()).alias("without"),
    ).first()
    counts = {item["item"]: item["count"] for item in seen["top"] or [] if item["item"] is not None}
    counts[None] = seen["without"]
    return {k: -(-SALTS_PER_TASK * n * tasks // seen["rows"]) for k, n in counts.items() if n * tasks > seen["rows"]}


def _salted(df: DataFrame, key: str, copied: dict, dealt: dict, names: tuple[str, str]) -> DataFrame:
    """Rows with a salt: copied to every salt of a key heavy on the other side, dealt over those of a key
    heavy on this one; ``names`` are the salt and the flag of copies."""
    salt, flag = names
    schema = T.StructType([T.StructField("_heavy", df.schema[key].dataType), T.StructField("_copies", T.IntegerType()),
                           T.StructField("_deals", T.IntegerType())])
    keys = [k for k in {**copied, **dealt} if k is not None]
    table = df.sparkSession.createDataFrame([(k, copied.get(k), dealt.get(k)) for k in keys], schema)
    spread = F.pmod(F.xxhash64(*hashable(df)), F.coalesce("_deals", F.lit(dealt.get(None, 1)))).cast("int")
    marked = df.join(F.broadcast(table), F.col(key) == F.col("_heavy"), "left")  # at most 2 x HEAVY_KEYS rows
    one = F.when(F.col("_deals").isNotNull() | F.col(key).isNull(), spread).otherwise(F.lit(0))
    salts = F.when(F.col("_copies").isNotNull(), F.sequence(F.lit(0), F.col("_copies") - 1)).otherwise(F.array(one))
    return marked.select(*df.columns, F.col("_copies").isNotNull().alias(flag), F.explode(salts).alias(salt))


def outer_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str
) -> DataFrame:
    """``left``, ``right`` or ``full`` join; all column names must differ.

    Spark cannot split the optional side of an outer join, nor either side of a full one. The heavy keys
    of such a side are found by a sketch; their rows are dealt over several tasks and the other side's rows of these keys are
    copied to each. A copy that meets nothing is dropped, since its key has rows elsewhere. Everything
    else is one plain outer join.
    """
    if how not in ("left", "right", "full"):
        raise ValueError(f"not an outer join: {how}")
    on_right = heavy_keys(right, right_key) if how in ("left", "full") else {}
    on_left = heavy_keys(left, left_key) if how in ("right", "full") else {}
    on_left = {k: n for k, n in on_left.items() if k is None or k not in on_right}
    if not on_right and not on_left:
        return left.join(right, F.col(left_key) == F.col(right_key), how)
    to_right = {k: n for k, n in on_right.items() if k is not None}
    to_left = {k: n for k, n in on_left.items() if k is not None}
    a = _salted(left, left_key, to_right, on_left, ("_left_salt", "_left_copy")).withColumn("_left", F.lit(True))
    b = _salted(right, right_key, to_left, on_right, ("_right_salt", "_right_copy")).withColumn("_right", F.lit(True))
    meets = (F.col(left_key) == F.col(right_key)) & (F.col("_left_salt") == F.col("_right_salt"))
    alone = (F.col("_right").isNull() & F.col("_left_copy")) | (F.col("_left").isNull() & F.col("_right_copy"))
    joined = a.join(b, meets, how).filter(~F.coalesce(alone, F.lit(False)))
    return joined.select(*left.columns, *right.columns)


def count_matches(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, alias: str = "count"
) -> DataFrame:
    """``COUNT(*)`` of an inner equi-join, without forming the joined rows.

    Each side is counted per key first, so what meets is one row per key.
    """
    per_left = left.groupBy(F.col(left_key).alias("_lk")).agg(F.count("*").alias("_ln"))
    per_right = right.groupBy(F.col(right_key).alias("_rk")).agg(F.count("*").alias("_rn"))
    return per_left.join(per_right, F.col("_lk") == F.col("_rk")).agg(
        F.coalesce(F.sum(F.col("_ln") * F.col("_rn")), F.lit(0)).cast("bigint").alias(alias)
    )
