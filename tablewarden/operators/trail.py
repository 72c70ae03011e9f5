"""Reading a written trail: tagged records in one pass, order over all files, and secrets that got in.

Lines come from ``sources.trail.read_trail`` with their place: append, file, split and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.json import json_object
from tablewarden.operators.audit import AUDIT_FIELDS, AUDIT_SCHEMA, line_pattern
from tablewarden.operators.sequence import neighbours_in_order
from tablewarden.session import scratch_path

RECORD, REJECT = "record", "reject"


def trail_entries(lines: DataFrame) -> DataFrame:
    """Every line as a typed record, ``kind`` record, or as a reject with NULL fields.

    One projection over one scan. A line spelled as the writer spells it is recognized by its pattern
    and read as it stands; only another is parsed strictly, and its fields are taken from that parse.
    """
    keep = [c for c in lines.columns if c != "value"]
    value = F.col("value")
    tagged = lines.withColumn("_written", F.coalesce(value.rlike(line_pattern()), F.lit(False)))
    parsed = tagged.select(
        *keep,
        "_written",
        F.when(F.col("_written"), F.from_json(value, AUDIT_SCHEMA)).alias("_record"),
        F.when(~F.col("_written"), json_object(value)).alias("_object"),
    )
    fields = [
        F.when(F.col("_written"), F.col(f"_record.{name}"))
        .otherwise(F.try_variant_get("_object", f"$.{name}", kind))
        .alias(name)
        for name, kind in AUDIT_FIELDS
    ]
    kind = F.when(F.col("_written") | F.col("_object").isNotNull(), F.lit(RECORD)).otherwise(F.lit(REJECT))
    return parsed.select(*keep, kind.alias("kind"), *fields)


def _moved(before: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("request_id") <= before["request_id"], F.lit("REQUEST_ID_NOT_RISING")),
            F.when(F.col("timestamp") < before["timestamp"], F.lit("TIME_FALLS")),
        )
    )


def trail_order(lines: DataFrame) -> DataFrame:
    """Records of a trail whose id does not rise or whose time falls, over all its files, and ids in use twice.

    The order is by append, part file, split and line. Lines are shuffled once, by split, where each
    meets the one before it. Only the border rows of the splits are compared further, first inside an
    append, then one row per append. Ids that rise throughout occur once; only if some do not is
    there a second look, which counts ids. Rejected lines have no id and are passed over.
    """
    place = ["append", "file", "split_start", "line"]
    records = trail_entries(lines).filter(F.col("kind") == RECORD)
    value = F.struct("request_id", "timestamp")
    split = Window.partitionBy("file", "split_start").orderBy("line")
    paired = records.select(
        *place,
        "request_id",
        "timestamp",
        F.lag(value).over(split).alias("_before"),
        F.lead("line").over(split).isNull().alias("_last"),
    )
    seen = paired.withColumn("violations", _moved(F.col("_before")))
    notable = seen.filter(F.col("_before").isNull() | F.col("_last") | (F.size("violations") > 0))
    path = scratch_path(lines.sparkSession, "trail-borders")
    notable.write.parquet(path)
    notable = lines.sparkSession.read.parquet(path)

    # One row per split: its first and last record.
    border = F.struct("line", "request_id", "timestamp")
    splits = notable.groupBy("append", "file", "split_start").agg(
        F.min(F.when(F.col("_before").isNull(), border)).alias("first"),
        F.max(F.when(F.col("_last"), border)).alias("last"),
    )
    part = F.regexp_extract("file", r"part-([0-9]+)[^/]*$", 1).try_cast("bigint")
    inside = Window.partitionBy("append").orderBy(part, "file", "split_start")
    chained = splits.withColumn("_inner", F.lag("last").over(inside)).withColumn(
        "_number", F.row_number().over(inside)
    )
    ends = splits.groupBy("append").agg(
        F.max_by("last", F.struct(part.alias("p"), "file", "split_start")).alias("last")
    )
    # Appends are numbered without large gaps; files that no append wrote come first.
    before = neighbours_in_order(ends.withColumn("_position", F.col("append") + 1), "_position", ["last"])
    carried = before.select("append", F.col("prev_last").alias("_outer"))
    firsts = chained.join(carried, "append").select(
        "append",
        "file",
        "split_start",
        F.col("first.line").alias("line"),
        F.col("first.request_id").alias("request_id"),
        F.col("first.timestamp").alias("timestamp"),
        F.when(F.col("_number") == 1, F.col("_outer")).otherwise(F.col("_inner")).alias("_before"),
    )
    crossing = firsts.withColumn("violations", _moved(F.col("_before")))

    def rows(df: DataFrame) -> DataFrame:
        return df.select(
            *place,
            "request_id",
            F.col("_before.request_id").alias("prev_request_id"),
            F.explode_outer("violations").alias("violation"),
        ).filter("violation IS NOT NULL")

    found = rows(notable).unionByName(rows(crossing))
    path = scratch_path(lines.sparkSession, "trail-violations")
    found.write.parquet(path)
    found = lines.sparkSession.read.parquet(path)
    if found.filter("violation = 'REQUEST_ID_NOT_RISING'").isEmpty():
        return found
    twice = records.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blank = [F.lit(None).cast(dict(found.dtypes)[c]).alias(c) for c in place]
    return found.unionByName(
        twice.select(
            *blank,
            "request_id",
            F.lit(None).cast("bigint").alias("prev_request_id"),
            F.lit("DUPLICATE_REQUEST_ID").alias("violation"),
        )
    )


# ---- leaks -------------------------------------------------------------------------------------

GRAM = 6
STRIDES = (8, 4, 2)
ROW_GROUP_BYTES = 8 << 20  # small, so that many tasks can read what few wrote
BROADCAST_ROWS = 500_000


def _grams(text: Column, size: int, stride: int = 1) -> Column:
    """The runs of ``size`` characters of a text that start at every ``stride``-th, in time linear in its length."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}})).{{1,{stride}}}"), F.lit(1))


def leak_index(lines: DataFrame, canaries: DataFrame, gram: int = GRAM) -> DataFrame:
    """``gram, size, stride, canary``: every canary under the grams of its window that the fewest lines have.

    A window is ``stride`` consecutive grams. A line is cut at every ``stride``-th character, so wherever a
    canary stands in it, one gram of each of its windows is cut out. A canary takes the largest stride
    that leaves it two windows; one shorter than ``gram`` characters is its own gram. The counts combine
    before their shuffle.
    """
    spark = lines.sparkSession
    texts = canaries.select(F.col("canary").cast("string").alias("canary")).filter("canary <> ''").distinct()
    size = F.least(F.char_length("canary"), F.lit(gram)).cast("int")
    starts = F.char_length("canary") - F.col("size") + 1
    stride = F.coalesce(*[F.when(starts >= 2 * s, F.lit(s)) for s in STRIDES], F.lit(1))
    choices = [F.when(F.col("size") == i, _grams(F.col("canary"), i)) for i in range(1, gram + 1)]
    spread = (
        texts.withColumn("size", size)
        .withColumn("stride", stride)
        .withColumn("windows", F.floor(starts / F.col("stride")).cast("int"))
        .select("canary", "size", "stride", "windows", F.posexplode(F.coalesce(*choices)).alias("at", "gram"))
        .withColumn("window", F.floor(F.col("at") / F.col("stride")).cast("int"))
        .filter("window < windows")
        .select("canary", "size", "stride", "window", "gram")
    )
    path = scratch_path(spark, "canary-grams")
    spread.write.parquet(path)
    spread = spark.read.parquet(path)
    key = ["gram", "size", "stride"]
    frequency = _line_grams(lines.select("value"), spread, gram).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "canary-rated")
    spread.join(frequency, key, "left").write.parquet(path)
    rated = spark.read.parquet(path)
    window = rated.groupBy("canary", "window").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rank = F.struct("n", "window")
    # A canary with a window of which no line has a gram cannot be found in any.
    best = window.groupBy("canary").agg(F.min(rank).alias("best")).filter("best.n > 0")
    best = best.select("canary", F.col("best.window").alias("window"))
    return rated.filter("n > 0").join(best, ["canary", "window"]).select(*key, "canary").distinct()


def _line_grams(lines: DataFrame, index: DataFrame, gram: int) -> DataFrame:
    """Lines with each of their grams, of those sizes and strides only that some canary has."""
    kinds = index.select("size", "stride").distinct().collect()  # a few numbers

    def cut(i: int, s: int) -> Column:
        return F.transform(
            F.array_distinct(_grams(F.col("value"), i, s)),
            lambda g: F.struct(g.alias("gram"), F.lit(i).alias("size"), F.lit(s).alias("stride")),
        )

    listed = [cut(i, s) for i, s in sorted((r["size"], r["stride"]) for r in kinds)]
    if not listed:
        nothing = [F.lit("").alias("gram"), F.lit(0).alias("size"), F.lit(0).alias("stride")]
        return lines.limit(0).select("*", *nothing)
    return lines.select("*", F.explode(F.concat(*listed)).alias("_g")).select("*", "_g.*").drop("_g")


def audit_leak_join(
    lines: DataFrame, canaries: DataFrame, position: str = "position", gram: int = GRAM
) -> DataFrame:
    """``position, canary`` of every line that contains a canary of the table.

    Of each line only the grams under which canaries are listed lead to a comparison, so the time hardly
    depends on how many canaries there are. The lines are written once. An index of at most ``BROADCAST_ROWS``
    is taken to the lines; with a larger one only grams and line numbers are shuffled, and texts once. NULL and
    empty canaries are in no line, repeated ones count once.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "leak-lines")
    numbered = lines.select(F.monotonically_increasing_id().alias("_line"), F.col(position).alias("_position"), "value")
    numbered.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    texts = spark.read.parquet(path)
    path = scratch_path(spark, "canary-index")
    leak_index(texts, canaries, gram).write.parquet(path)
    index = spark.read.parquet(path)
    key = ["gram", "size", "stride"]
    if index.count() <= BROADCAST_ROWS:
        met = _line_grams(texts, index, gram).join(F.broadcast(index), key)
    else:
        grams = _line_grams(texts.select("_line", "value"), index, gram).select("_line", *key)
        met = texts.join(grams.join(index, key).select("_line", "canary"), "_line")
    # A line may have several grams of a canary, and of one that it does not contain.
    hits = met.filter(F.contains("value", "canary")).select("_line", "_position", "canary").distinct()
    return hits.select(F.col("_position").alias(position), "canary")
