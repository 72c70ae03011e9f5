"""Reading a written trail: tags, order over all files, leaks, and what may not become a line."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.operators import audit, sequence
from tablewarden.operators.projection import ENTRY_TYPE, with_list_refusal
from tablewarden.operators.trail import audit_leak_join, trail_entries, trail_order
from tablewarden.plans.release import OUTCOME_SCHEMA
from tablewarden.sources import trail_summary
from tablewarden.sources.commit_log import append_record
from tablewarden.sources.trail import APPENDS, append_audit, append_folder, append_lines, read_trail


def records(spark, pairs):
    """Parsing failures with these ids and times."""
    rows = [(i, t, vocab.PARSING_FAILURE) for i, t in pairs]
    known = spark.createDataFrame(rows, "request_id long, timestamp_ms long, outcome string")
    names = [part.rsplit(" ", 1) for part in OUTCOME_SCHEMA.split(", ")]
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in names if name not in known.columns]
    return audit.audit_build(known.select("*", *blank))


@pytest.fixture()
def many_files(spark, monkeypatch):
    monkeypatch.setattr(sequence, "ROWS_PER_RANGE", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def violations(spark, path):
    found = trail_order(read_trail(spark, path)).collect()
    return sorted([(r.append, r.request_id, r.prev_request_id, r.violation) for r in found], key=str)


def test_order_holds_over_appends_and_files(spark, tmp_path, many_files):
    path = str(tmp_path / "t")
    append_audit(records(spark, [(i, i) for i in range(40)]).repartition(4), path)
    append_audit(records(spark, [(40, 40)]), path)
    append_audit(records(spark, [(41, 41), (42, 41)]), path)
    assert read_trail(spark, path).select("file").distinct().count() > 4
    assert violations(spark, path) == []


def test_falling_ids_of_two_appends_and_duplicates_are_found(spark, tmp_path):
    path = str(tmp_path / "t")
    append_audit(records(spark, [(5, 50)]), path)
    append_audit(records(spark, [(3, 30), (5, 60), (6, 10)]), path)
    append_audit(records(spark, []), path)
    append_audit(records(spark, [(9, 5), (10, 6)]), path)
    assert violations(spark, path) == sorted(
        [
            (1, 3, 5, "REQUEST_ID_NOT_RISING"), (1, 3, 5, "TIME_FALLS"), (1, 6, 5, "TIME_FALLS"),
            (3, 9, 6, "TIME_FALLS"), (None, 5, None, "DUPLICATE_REQUEST_ID"),
        ], key=str,
    )


def test_an_append_with_a_key_is_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for time in (1, 2):
        append_audit(records(spark, [(1, time)]), path, "request-1")
    append_audit(records(spark, [(2, 2)]), path, "request-2")
    assert [r.request_id for r in audit.parse_trail(read_trail(spark, path)).orderBy("request_id").collect()] == [1, 2]
    assert violations(spark, path) == []


def test_order_over_files_against_brute_force(spark, tmp_path, many_files):
    pick, path, whole = random.Random(2), str(tmp_path / "t"), []
    for n in range(6):
        pairs = sorted({(pick.randrange(60), pick.randrange(90)) for _ in range(12)})
        append_audit(records(spark, pairs).repartition(3), path)
        stored = audit.parse_trail(read_trail(spark, path).filter(F.col("append") == n)).orderBy(
            F.regexp_extract("file", "part-([0-9]+)", 1), "line"
        )
        whole += [(n, r.request_id, r.timestamp) for r in stored.collect()]
    expected = []
    for (_, a, s), (n, b, t) in itertools.pairwise(whole):
        expected += [(n, b, a, "REQUEST_ID_NOT_RISING")] * (b <= a) + [(n, b, a, "TIME_FALLS")] * (t < s)
    ids = [i for _, i, _ in whole]
    expected += [(None, i, None, "DUPLICATE_REQUEST_ID") for i in set(ids) if ids.count(i) > 1]
    assert violations(spark, path) == sorted(expected, key=str)


def test_lines_are_scanned_once_and_shuffled_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    append_audit(records(spark, [(i, i) for i in range(9)]), path)
    lines = read_trail(spark, path)
    tagged = trail_entries(lines)._jdf.queryExecution().executedPlan().toString()
    assert tagged.count("FileScan") == 1 and "Exchange" not in tagged
    plans = []
    from tablewarden.operators import trail

    def planned(spark_, label):
        plans.append(label)
        return str(tmp_path / f"scratch-{label}")

    monkeypatch.setattr(trail, "scratch_path", planned)
    found = trail_order(lines)
    assert plans == ["trail-borders", "trail-violations"]
    assert "append-" not in found._jdf.queryExecution().optimizedPlan().toString()  # reads the borders only


MALFORMED = ["{bad", "", "[]", "1", '{"outcome":"SUCCESS"} x', '{"a":1}{"b":2}', "null", '"text"']


def test_entries_are_tagged_in_one_pass(spark, tmp_path):
    good = audit.audit_lines(records(spark, [(7, 7)])).select("value")
    odd = ['{ "outcome" : "SUCCESS", "row_count": 3, "request_id": 4 }', '{"request_id":8,"outcome":5}', "{}"]
    lines = good.union(spark.createDataFrame([(v,) for v in MALFORMED + odd + [None]], "value string"))
    got = [(r.kind, r.request_id, r.outcome, r.row_count) for r in trail_entries(lines).collect()]
    assert sorted(got, key=str) == sorted(
        [("reject", None, None, None)] * (len(MALFORMED) + 1)
        + [("record", 7, vocab.PARSING_FAILURE, None), ("record", 4, "SUCCESS", 3), ("record", 8, "5", None),
           ("record", None, None, None)], key=str,
    )


@pytest.mark.parametrize("limit", [0, 10_000])
def test_leaks_equal_brute_force(spark, limit, monkeypatch):
    from tablewarden.operators import trail

    monkeypatch.setattr(trail, "BROADCAST_ROWS", limit)
    pick = random.Random(11)
    word = lambda n: "".join(pick.choice("abé\n.") for _ in range(n))
    lines = [(i, word(pick.randrange(40))) for i in range(150)] + [(200, None), (201, ""), (7, "twice secret-77 secret-77")]
    canaries = [word(pick.randint(1, 9)) for _ in range(120)] + ["secret-77", "secret-77", "", None, "nowhere-to-be-found", ".*"]
    df = spark.createDataFrame(lines, "position long, value string").repartition(3)
    table = spark.createDataFrame([(c,) for c in canaries], "canary string")
    got = sorted((r.position, r.canary) for r in audit_leak_join(df, table).collect())
    wanted = {c for c in canaries if c}
    assert got == sorted((i, c) for i, v in lines if v for c in wanted if c in v)
    assert audit_leak_join(df, table.limit(0)).count() == 0 and audit_leak_join(df.limit(0), table).count() == 0


@pytest.mark.parametrize("limit", [0, 10_000])
def test_leaks_of_long_canaries_at_any_place(spark, limit, monkeypatch):
    from tablewarden.operators import trail

    monkeypatch.setattr(trail, "BROADCAST_ROWS", limit)
    pick = random.Random(12)
    word = lambda n: "".join(pick.choice("abé\n𝄞.") for _ in range(n))
    canaries = [word(n) for n in range(1, 45)] + ["\U0001d11e" * 9, "same start " * 3, "same start " * 3 + "x"]
    lines = [(i, word(i % 19) + c * 2 + word(i % 5)) for i, c in enumerate(canaries * 3)] + [(3, None), (3, "same start " * 4)]
    df = spark.createDataFrame(lines, "position long, value string").repartition(3)
    table = spark.createDataFrame([(c,) for c in canaries], "canary string")
    got = sorted((r.position, r.canary) for r in audit_leak_join(df, table).collect())
    assert got == sorted((i, c) for i, v in lines if v for c in canaries if c in v)


def test_leak_index_cuts_few_grams_of_a_line(spark):
    from tablewarden.operators import trail

    pick = random.Random(13)
    word = lambda n: "".join(pick.choice("0123456789abcdef") for _ in range(n))
    canaries = [word(32) for _ in range(20)]
    lines = spark.createDataFrame([(word(400) + canaries[0] + word(368),)], "value string")
    index = trail.leak_index(lines, spark.createDataFrame([(c,) for c in canaries], "canary string"))
    assert {(r.canary, r.size, r.stride) for r in index.collect()} == {(canaries[0], 6, 8)}
    assert trail._line_grams(lines, index, trail.GRAM).count() <= 100  # not 795


def test_nothing_incomplete_becomes_a_line(spark):
    kinds = [part.rsplit(" ", 1) for part in OUTCOME_SCHEMA.split(", ")]
    full = {
        "request_id": 1, "timestamp_ms": 1, "outcome": vocab.SUCCESS, "statement_type": "SELECT", "statement_count": 1,
        "reason": vocab.AUDITABLE_REASONS[0], "category": vocab.EXECUTION_FAILURE, "row_count": 1, "column_count": 1,
        "affected_rows": 1, "pii_email_columns": 0, "pii_phone_columns": 0, "pii_credit_card_columns": 0, "tables": ["t"],
    }
    rows = []
    for outcome, kind in itertools.product([*vocab.OUTCOMES, "X", None], ["SELECT", "INSERT", "DROP", None]):
        base = full | {"outcome": outcome, "statement_type": kind}
        rows += [base, base | {"tables": [None]}, base | {"tables": ["a b"]}]
        rows += [base | {name: None} for name, _ in kinds] + [base | {"timestamp_ms": t} for t in (-(1 << 62), 1 << 62)]
        rows += [base | {name: -1} for name, k in kinds if k == "bigint"]
    df = spark.createDataFrame([tuple(r[n] for n, _ in kinds) for r in rows], OUTCOME_SCHEMA).coalesce(2)
    lines = audit.audit_lines(audit.audit_build(df)).withColumn("position", F.monotonically_increasing_id())
    assert lines.count() > 300 and audit.audit_validate(lines).collect() == []
    left_out = audit.audit_unrecordable(df)
    assert left_out.count() + lines.count() == len(rows)
    assert left_out.filter("request_id >= 0 AND timestamp_ms BETWEEN 0 AND 9").count() == 0


def test_a_summary_reads_new_appends_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    summary = lambda: sorted(map(tuple, trail_summary.outcome_summary(spark, path).collect()), key=str)
    assert summary() == []
    append_audit(records(spark, [(1, 1), (2, 2)]), path)
    assert summary() == [("record", vocab.PARSING_FAILURE, 2)]
    open_number = append_record(spark, f"{path}/{APPENDS}", {})  # an append that has not written yet
    append_audit(records(spark, [(3, 3)]), path)
    append_lines(spark.createDataFrame([("{bad",), ('{"outcome":"SUCCESS"}',)], "value string"), path)
    assert trail_summary.refresh(spark, path) == 2 and trail_summary.refresh(spark, path) == 0
    expected = [("record", vocab.PARSING_FAILURE, 3), ("record", vocab.SUCCESS, 1), ("reject", None, 1)]
    assert summary() == expected
    # What is summarized is not read again.
    spark.createDataFrame([("x",)], "value string").write.mode("overwrite").text(append_folder(path, 0))
    assert summary() == expected
    records_line = audit.audit_lines(records(spark, [(4, 4)])).select("value")
    records_line.write.text(append_folder(path, open_number))
    assert trail_summary.refresh(spark, path) == 1
    assert summary()[0] == ("record", vocab.PARSING_FAILURE, 4)


C, S, N = ("COLUMN", "email"), ("STAR", None), ("FUNCTION", "Count", ["*"])
LISTS = [
    ([C], False, None), ([S], True, None), ([C, C], True, None), ([C, S], False, "MASKING_REFUSED"),
    ([N], False, None), ([N, N], False, None), ([N], True, "MASKING_REFUSED"), ([N, C], False, "QUERY_FAILED"),
    ([C, N], True, "MASKING_REFUSED"), ([S, N], False, "QUERY_FAILED"), ([], False, "MASKING_REFUSED"),
    ([("FUNCTION", "COUNT", ["1"])], False, "MASKING_REFUSED"), ([("FUNCTION", "count", ["*"], True)], False, "MASKING_REFUSED"),
    ([("FUNCTION", "MAX", ["email"]), C], False, "QUERY_FAILED"), ([("FUNCTION", "UPPER", ["email"]), C], False, "MASKING_REFUSED"),
    ([N, ("FUNCTION", "COUNT", ["*"], False, True)], False, "QUERY_FAILED"), ([N, ("LITERAL", "1")], False, "MASKING_REFUSED"),
    ([("FUNCTION", "SUM", ["x"], False, True), C], False, "MASKING_REFUSED"), ([N, C], None, "MASKING_REFUSED"),
    (None, False, "MASKING_REFUSED"), ([(None, None)], False, "MASKING_REFUSED"), ([("COLUMN", "email", None, False, None)], False, None),
]


def test_select_lists_are_judged_by_their_entries(spark):
    wide = lambda e: (*e, *([], False, False)[len(e) - 2 :])
    rows = [(i, e and [wide(x) for x in e] if e is not None else None, g) for i, (e, g, _) in enumerate(LISTS)]
    df = spark.createDataFrame(rows, f"i int, entries array<{ENTRY_TYPE}>, has_group_by boolean")
    got = [r.refusal for r in with_list_refusal(df).orderBy("i").collect()]
    assert got == [expected for _, _, expected in LISTS]
