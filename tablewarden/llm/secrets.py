"""Secrets by patterns and by character Markov models, in DataFrame functions only.

Two first-order models over the characters of base64 text are counted from labelled tokens: random
strings, and ordinary tokens. Ordinary ones are identifiers, paths, dates, numbers and ruled lines made
by rule, and the different tokens of all documents outside the matches of the patterns. Tokens of documents weigh
at most as much as the made ones, however many there are. A long token is a secret if the log-likelihood
ratio of the two models, summed over its pairs of characters, passes a threshold. The models count all
tokens; the threshold is set on all long ones, above all made ordinary ones, where each half of the tokens
is scored by models of the other half. Documents may hold secrets that no pattern
finds, so their tokens raise it only while that spares a larger share of them than it loses of random
strings of the least length, and while nearly all of these (``FOUND_AT_LEAST``) are still found.

Null texts are empty and have no spans; rows that repeat are scanned each. An empty table gives no rows,
and models can be fitted without documents. Work grows with the text and, but for copies of references
to spans, with the number of matches. Columns starting with ``_secret_`` and one named ``spans`` are
replaced; any other column is passed on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.store import keep

# The base patterns, their kinds in order, and the least length of a match (of the value
# for "assign").
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_VALUE = 8

# The models' characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
LONG = 20
LONG_TOKEN = rf"[A-Za-z0-9+/_=-]{{{LONG},}}"
TOKEN = r"[A-Za-z0-9+/_=-]{8,}"
LEAST_THRESHOLD = 8.0
MADE_TOKENS = 20_000
FOUND_AT_LEAST = 0.99
SCORES = 1_000
BLOCK = 512  # numbers that one step of a running sum carries
PIECE = 1024  # characters of a text that are looked through for one place

# Words that identifiers of the labelled sample are made of.
PARTS = (
    "account action address array average batch begin block buffer cache channel check client close "
    "column commit config connection content context count create current data date default delete "
    "document element encode entry error event field file filter first format function group handle "
    "header height index input install instance integer interface item label language last length level "
    "line list load local manager match message method model module name network next node number object "
    "offset option output package page parameter parent parse path pattern position previous process "
    "property query random range read record reference remote request resource response result return "
    "sample schedule schema search section select sequence server service session setting source start "
    "state status storage stream string sum table target task template text thread time token total trace "
    "transform type update upper user validate value vector version width window write"
).split()


def labelled_samples(spark: SparkSession, docs: DataFrame | None = None, each: int = MADE_TOKENS) -> DataFrame:
    """``(token, label, made, held_out)``: random strings in base64, hex and capitals (1), and ordinary ones (0).

    Made tokens are derived from row numbers by SHA-256 and the words above, so every run has the same.
    Those of ``docs`` are all their different tokens outside the matches of the patterns; they are written once.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.base64(F.unhex(digest))
    shape = F.col("id") % 3
    token = (
        F.when(shape == 0, F.regexp_replace(raw, "=", ""))
        .when(shape == 1, F.substring(digest, 1, 40))
        .otherwise(F.regexp_replace(F.upper(raw), "[^A-Z0-9]", ""))
    )
    words = F.array(*map(F.lit, PARTS))

    def number(salt: int, below: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(below))

    def word(salt: int) -> Column:
        return F.element_at(words, (number(salt, len(PARTS)) + 1).cast("int"))

    def digits(salt: int, width: int) -> Column:
        return F.lpad(number(salt, 10**width).cast("string"), width, "0")

    mark = F.element_at(F.array(*map(F.lit, "-_=+/0x")), (number(9, 7) + 1).cast("int"))
    forms = [
        F.concat_ws("_", word(1), word(2), word(3)),
        F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), digits(4, 2)),
        F.concat(word(1), word(2), F.lit("-"), word(3), word(4)),
        F.concat_ws("/", word(1), word(2), word(3), word(4), word(5)),
        F.concat_ws("-", digits(1, 4), digits(2, 2), digits(3, 2), digits(4, 2), digits(5, 2), digits(6, 6)),
        F.concat_ws("-", digits(1, 8), digits(2, 4), F.lit("0000"), digits(3, 4), F.lpad(digits(4, 3), 12, "0")),
        F.upper(F.concat_ws("_", word(1), word(2), word(3), word(4))),
        F.repeat(mark, (number(8, 40) + 20).cast("int")),
        F.concat(digits(1, 9), digits(2, 9), digits(3, 9)),
    ]
    name = F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    ids = spark.range(each)
    samples = ids.select(token.alias("token"), F.lit(1).alias("label")).unionByName(
        ids.select(name.alias("token"), F.lit(0).alias("label"))
    ).withColumn("made", F.lit(True))
    if docs is not None:
        rest = F.col("text").cast("string")
        for pattern in (ASSIGN, ACCESS, HEX):
            rest = F.regexp_replace(rest, pattern, " ")
        found = docs.select(F.explode(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0))).alias("token"))
        plain = keep(found.distinct(), "secret-tokens")
        samples = samples.unionByName(plain.select("token", F.lit(0).alias("label"), F.lit(False).alias("made")))
    return samples.withColumn("held_out", F.pmod(F.xxhash64("token", "label"), F.lit(2)) == 1)


@dataclass(frozen=True)
class Model:
    """Log ratio of every pair of characters, row by row, and the score from which a token is a secret."""

    ratio: list[float]
    threshold: float


def fit(samples: DataFrame) -> Model:
    """Count the pairs of all tokens, and set the threshold on each half by the counts of the other.

    The table's size is that of the alphabet squared.
    """
    last = F.length("token") - 1
    chars = F.split("token", "")
    pair = F.zip_with(F.slice(chars, F.lit(1), last), F.slice(chars, F.lit(2), last), lambda a, b: F.concat(a, b))
    pairs = samples.filter(F.length("token") > 1).select("label", "made", "held_out", F.explode(pair).alias("pair"))
    # At most 6 * size * size rows.
    rows = pairs.groupBy("label", "made", "held_out", "pair").count().collect()
    ratio, *halves = (_ratio([r for r in rows if r["held_out"] in of]) for of in ((False, True), (False,), (True,)))
    return Model(ratio, _threshold(samples, *halves))


def _ratio(rows: list) -> list[float]:
    """Log ratio of every pair of characters by their counts."""
    size = len(ALPHABET)
    made, found = [[0.0] * (size * size) for _ in range(2)], [0.0] * (size * size)
    for row in rows:
        a, b = ALPHABET.find(row["pair"][0]), ALPHABET.find(row["pair"][1])
        if a >= 0 and b >= 0:
            (made[row["label"]] if row["made"] else found)[a * size + b] += row["count"]
    weight = min(1.0, sum(made[0]) / max(sum(found), 1.0))
    counts = [[1.0 + m + weight * f for m, f in zip(made[0], found, strict=True)], [1.0 + m for m in made[1]]]
    ratio = []
    for a in range(size):
        rows = [c[a * size : (a + 1) * size] for c in counts]
        sums = [sum(r) for r in rows]
        ratio += [math.log(p / sums[1]) - math.log(q / sums[0]) for q, p in zip(*rows, strict=True)]
    return ratio


def _threshold(samples: DataFrame, ratio: list[float], other: list[float] | None = None) -> float:
    """The score from which a token is a secret, by all long tokens.

    ``ratio`` scores the held-out half and ``other`` the rest; without ``other``, ``ratio`` scores all.
    Random strings are cut to the least length. Scores are counted by their whole parts; beyond ``SCORES``
    they count as that.
    """
    long = samples.filter(F.col("token").rlike(f"^{LONG_TOKEN}$"))
    token = F.when(F.col("label") == 1, F.substring("token", 1, LONG)).otherwise(F.col("token"))
    score = _score(token, ratio)
    if other is not None:
        score = F.when(F.col("held_out"), score).otherwise(_score(token, other))
    scored = long.select("label", "made", score.alias("score"))
    part = F.least(F.greatest(F.floor("score"), F.lit(-SCORES)), F.lit(SCORES)).cast("int").alias("part")
    bins = scored.groupBy("label", "made", part).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("m")).collect()
    highest = max((r["m"] for r in bins if r["made"] and r["label"] == 0), default=0.0)
    best = least = max(LEAST_THRESHOLD, highest + 1.0)
    secret, found = ([r for r in bins if (r["label"], r["made"]) == k] for k in ((1, True), (0, False)))

    def share(rows: list, t: float) -> float:
        """Of these tokens, those with a score of ``t`` or more."""
        return sum(r["n"] for r in rows if r["part"] >= t) / max(sum(r["n"] for r in rows), 1)

    gain = share(secret, math.ceil(least)) - share(found, math.floor(least))
    for t in range(math.ceil(least), SCORES + 1):
        if share(secret, t) < FOUND_AT_LEAST:
            break
        if share(secret, t) - share(found, t) > gain:
            best, gain = float(t), share(secret, t) - share(found, t)
    return best


def _score(token: Column, ratio: list[float]) -> Column:
    """Summed log-likelihood ratio of a token over ALPHABET, in one pass over its characters."""
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # folded into a constant
    state = "struct<before:int,total:double>"

    def step(s: Column, c: Column) -> Column:
        code = F.instr(F.lit(ALPHABET), c)
        at = (s["before"] - 1) * len(ALPHABET) + code
        more = F.when(s["before"] > 0, F.element_at(table, at)).otherwise(0.0)
        return F.struct(code.alias("before"), (s["total"] + more).alias("total")).cast(state)

    begin = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("total")).cast(state)
    return F.aggregate(F.split(token, ""), begin, step, lambda s: s["total"])


SPAN = "struct<start:int,kind:int,end:int>"
TOKENS = "array<struct<start:int,kind:int,end:int,token:string>>"


def _running(values: Column) -> Column:
    """What comes before each number, summed; in blocks, so no step copies more than a block."""
    empty = F.array().cast("array<int>")

    def carried(items: Column, size) -> Column:
        return F.aggregate(
            items,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda s, v: F.struct((s["at"] + size(v)).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        )

    last = F.greatest(F.floor((F.size(values) - 1) / BLOCK), F.lit(0)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda b: carried(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), lambda v: v)
    )
    return F.aggregate(
        F.array(blocks),  # named once, used twice
        empty,
        lambda _, all_: F.flatten(
            F.zip_with(
                all_, carried(all_, lambda b: b["at"])["out"], lambda b, base: F.transform(b["out"], lambda x: x + base)
            )
        ),
    )


def _found(df: DataFrame, name: str, pattern: str, kind: str, group: int = 0, least: int = 0) -> DataFrame:
    """Add column ``name``: spans of all leftmost matches whose ``group`` has ``least`` characters, and the
    matches' texts.

    A text is its matches with what lies between them, so places are running sums of lengths.
    """
    some = F.size("_secret_m") > 0
    none = F.array().cast("array<int>")
    df = df.withColumn("_secret_m", F.regexp_extract_all("_secret_text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_secret_len", F.when(some, F.transform("_secret_m", F.length)).otherwise(none))
    cut = F.split("_secret_text", pattern, -1)
    df = df.withColumn("_secret_gap", F.when(some, F.slice(F.transform(cut, F.length), F.lit(1), F.size("_secret_m"))).otherwise(none))
    both = F.zip_with("_secret_gap", "_secret_len", lambda g, n: g + n)
    df = df.withColumn("_secret_step", both).withColumn("_secret_before", _running(F.col("_secret_step")))
    value = F.col("_secret_m") if not group else F.regexp_extract_all("_secret_text", F.lit(pattern), F.lit(group))
    df = df.withColumn("_secret_value", F.when(some, F.transform(value, F.length)).otherwise(none))
    zipped = F.arrays_zip(
        F.col("_secret_before").alias("b"), F.col("_secret_gap").alias("g"), F.col("_secret_len").alias("n"),
        F.col("_secret_value").alias("v"), F.col("_secret_m").alias("m"),
    )
    spans = F.transform(
        F.filter(zipped, lambda z: z["v"] >= least),
        lambda z: F.struct(
            (z["b"] + z["g"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
            (z["b"] + z["g"] + z["n"]).alias("end"), z["m"].alias("token"),
        ),
    )
    spans = F.when(some, spans.cast(TOKENS)).otherwise(F.array().cast(TOKENS))
    return df.withColumn(name, spans).drop(*[f"_secret_{c}" for c in ("m", "len", "gap", "step", "before", "value")])


def _untouched(spans: Column) -> Column:
    """Of spans in order of start, the long tokens that no pattern's span touches; one pass.

    Long tokens do not overlap each other, so only the latest one can reach into the next span.
    """
    kind = "struct<start:int,kind:int,end:int,token:string>"
    nothing = F.lit(None).cast(kind)
    begin = F.struct(F.lit(0).alias("reach"), nothing.alias("held"), F.array().cast(TOKENS).alias("out"))

    def flushed(s: Column) -> Column:
        return F.when(s["held"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["held"]))

    def step(s: Column, x: Column) -> Column:
        long = x["kind"] == KINDS.index("random")
        cut = s["held"].isNotNull() & (x["start"] < s["held"]["end"])
        held = F.when(long, F.when(x["start"] >= s["reach"], x)).otherwise(F.when(~cut, s["held"]))
        return F.struct(
            F.when(long, s["reach"]).otherwise(F.greatest(s["reach"], x["end"])).alias("reach"),
            held.cast(kind).alias("held"),
            F.when(long, flushed(s)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(spans, begin, step, flushed)


def secret_spans(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``spans``: ``array<struct<start, kind, end>>`` over the whole text, in code points.

    ``kind`` counts KINDS; spans are ordered by start, then kind. The models add only spans that touch no
    pattern's span.
    """
    df = docs.withColumn("_secret_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = _found(df, "_secret_assign", ASSIGN, "assign", group=1, least=ASSIGN_VALUE)
    df = _found(df, "_secret_access", ACCESS, "access")
    df = _found(df, "_secret_hex", HEX, "hex")
    df = _found(df, "_secret_long", f"(?<![A-Za-z0-9+/_=-]){LONG_TOKEN}", "random")
    df = df.withColumn("_secret_base", F.concat("_secret_assign", "_secret_access", "_secret_hex"))
    alone = _untouched(F.sort_array(F.concat("_secret_base", "_secret_long")))
    random = F.filter(alone, lambda r: _score(r["token"], model.ratio) >= model.threshold)
    random = F.when(F.size("_secret_long") > 0, random).otherwise(F.array().cast(TOKENS))
    bare = F.transform(F.sort_array(F.concat("_secret_base", random)), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    df = df.withColumn("spans", bare.cast(f"array<{SPAN}>"))
    return df.drop(*[f"_secret_{c}" for c in ("text", "assign", "access", "hex", "long", "base")])


def _spelled(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def span_digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of rows with ``spans``."""
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))

    def count(kind: str) -> Column:
        of_kind = F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))
        return F.size(of_kind).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_spelled(base), 256).alias("base_sha256"),
        _spelled(F.col("spans")).alias("spans"),
    )


def redacted(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Rows with ``spans`` lose that column, and each run of overlapping spans becomes ``mark``.

    A text is cut into pieces of equal length first, so no place is looked for from the start.
    """
    kind = "struct<start:int,end:int>"

    def joined(done: Column, s: Column) -> Column:
        last = F.element_at(done, F.size(done))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")).cast(kind)
        fresh = F.struct(s["start"].alias("start"), s["end"].alias("end")).cast(kind)
        return F.when(F.size(done) == 0, F.array(fresh)).otherwise(
            F.when(s["start"] >= last["end"], F.array_append(done, fresh)).otherwise(
                F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), longer)
            )
        )

    df = found.withColumn("_secret_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("_secret_runs", F.aggregate("spans", F.array().cast(f"array<{kind}>"), joined))
    df = df.withColumn(
        "_secret_pieces",
        F.when(F.size("spans") > 0, F.regexp_extract_all("_secret_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))),
    )
    starts = F.concat(F.array(F.lit(0)), F.transform("_secret_runs", lambda r: r["end"]))
    ends = F.concat(F.transform("_secret_runs", lambda r: r["start"]), F.array(F.length("_secret_text")))

    def between(start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        parts = F.transform(
            F.sequence(first, last),
            lambda b: F.substring(
                F.get("_secret_pieces", b),
                F.greatest(start - b * PIECE, F.lit(0)) + 1,
                F.least(end - b * PIECE, F.lit(PIECE)) - F.greatest(start - b * PIECE, F.lit(0)),
            ),
        )
        return F.when(end > start, F.array_join(parts, "")).otherwise(F.lit(""))

    clean = F.array_join(F.zip_with(starts, ends, between), mark)
    df = df.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    return df.drop("spans", "_secret_text", "_secret_runs", "_secret_pieces")
