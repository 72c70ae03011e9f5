"""Audit before release, in batch and in streams; streams agree with batch."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tablewarden.operators.audit import parse_trail
from tablewarden.operators.projection import Col, Computed, Star
from tablewarden.operators.triage import triage
from tablewarden.plans.guarded import guard, guarded_read
from tablewarden.plans import release
from tablewarden.plans.lineage import as_table
from tablewarden.plans.release import audit_refusal, guarded_release, release_after_audit
from tablewarden.refusals import InternalFailure, MaskingRefused, PolicyRejected, QueryFailed, Refusal
from tablewarden import vocab
from tablewarden.sources import commit_log, releases, requests
from tablewarden.sources.trail import read_trail
from tablewarden.streaming import jobs


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(
        [(1, "ann@example.com"), (2, None), (3, "")], "id int, email string"
    )


def trail(spark, path):
    return parse_trail(read_trail(spark, path)).orderBy("request_id").collect()


def test_release_is_audited_then_visible(spark, customers, tmp_path):
    store, path = str(tmp_path / "store"), str(tmp_path / "trail")
    result = guard(customers, [Star()], tables=["customers"])
    release_after_audit(result, store, path, release_id="r1", request_id=1, timestamp_ms=0)
    got = sorted(tuple(r) for r in releases.read_release(spark, store, "r1").collect() if r.email)
    assert got == [(1, "a***@example.com")]
    (record,) = trail(spark, path)
    assert (record.outcome, record.row_count, record.column_count) == ("SUCCESS", 3, 2)
    assert (record.pii_email_columns, record.pii_phone_columns) == (1, 0)
    assert record.referenced_tables == ["customers"]


def never(*_):
    raise OSError("no trail today")


def test_failed_audit_withholds_the_data(spark, customers, tmp_path):
    store = str(tmp_path / "store")
    release_after_audit(
        guard(customers, [Star()]), store, str(tmp_path / "ok"), release_id="r0", request_id=1, timestamp_ms=0
    )
    unknown = "nosuchscheme://trail"  # no file system is registered for it
    for failing in ({"audit_path": unknown}, {"audit_path": str(tmp_path / "other"), "append": never}):
        with pytest.raises((InternalFailure, Py4JJavaError)):
            release_after_audit(
                guard(customers, [Star()]), store, release_id="r1", request_id=2, timestamp_ms=0, **failing
            )
    with pytest.raises(LookupError):
        releases.read_release(spark, store, "r1")
    assert [r.release_id for r in releases.releases(spark, store).collect()] == ["r0"]


def test_a_second_attempt_leaves_the_published_rows_alone(spark, customers, tmp_path):
    store, path = str(tmp_path / "store"), str(tmp_path / "trail")
    release_after_audit(guard(customers, [Star()]), store, path, release_id="r", request_id=1, timestamp_ms=0)
    with pytest.raises(InternalFailure):
        release_after_audit(
            guard(customers.limit(1), [Star()]), store, path,
            release_id="r", request_id=2, timestamp_ms=0, append=never,
        )
    assert releases.read_release(spark, store, "r").count() == 3


STEPS = ["stage", "log_entry", "append", "publish"]


@pytest.mark.parametrize("broken", STEPS)
@pytest.mark.parametrize("late", [False, True])
def test_a_crash_at_any_step_leaves_old_or_new_and_one_line(spark, customers, tmp_path, monkeypatch, broken, late):
    """The process dies before or after a step; the same call then finishes the request."""
    store, path = str(tmp_path / "store"), str(tmp_path / "trail")

    def ask(frame, request_id):
        return release.release_after_audit(
            guard(frame, [Star()]), store, path, release_id="r", request_id=request_id, timestamp_ms=0,
            append=release.append_audit,
        )

    ask(customers, 1)
    place = release if broken == "append" else release.releases
    name = "append_audit" if broken == "append" else broken
    real = getattr(place, name)

    def dying(*args, **options):
        if late:
            real(*args, **options)
        raise KeyboardInterrupt  # not an error that the code handles

    monkeypatch.setattr(place, name, dying)
    with pytest.raises(KeyboardInterrupt):
        ask(customers.limit(2), 2)
    published = broken == "publish" and late
    assert releases.read_release(spark, store, "r").count() == (2 if published else 3)
    monkeypatch.setattr(place, name, real)
    assert ask(customers.limit(2), 2)["row_count"] == 2
    assert ask(customers.limit(2), 2)["row_count"] == 2
    assert releases.read_release(spark, store, "r").count() == 2
    assert [(r.request_id, r.row_count) for r in trail(spark, path)] == [(1, 3), (2, 2)]


def test_a_refused_request_stays_refused(spark, customers, tmp_path):
    store, path = str(tmp_path / "store"), str(tmp_path / "trail")
    options = {"release_id": "r", "request_id": 7, "timestamp_ms": 0}
    for spec, error in (([Computed(F.upper("email"))], MaskingRefused), ([Star(), Col("id")], PolicyRejected)):
        with pytest.raises(error):
            guarded_release(customers, spec, store, path, **options)
    with pytest.raises(InternalFailure):
        guarded_release(customers, [Star()], store, path, **options)
    assert [(r.request_id, r.outcome) for r in trail(spark, path)] == [(7, "MASKING_REFUSED")]
    with pytest.raises(LookupError):
        releases.read_release(spark, store, "r")


def test_every_request_leaves_one_line_in_one_place(spark, customers, tmp_path):
    store, path = str(tmp_path / "store"), str(tmp_path / "trail")
    named = as_table(customers, "customers")
    asked = [[Star()], [Col("nope")], [Star(), Col("id")], [Computed(F.upper("email"))], [Col("email")]]
    for i, spec in enumerate(asked):
        try:
            guarded_release(named, spec, store, path, release_id=f"r{i}", request_id=i, timestamp_ms=i)
        except Refusal:
            pass
    found = [(r.request_id, r.outcome, r.referenced_tables) for r in trail(spark, path)]
    outcomes = ["SUCCESS", "DATABASE_FAILURE", "POLICY_REJECTED", "MASKING_REFUSED", "SUCCESS"]
    assert found == [(i, outcome, ["customers"]) for i, outcome in enumerate(outcomes)]


def test_records_are_created_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert commit_log.last_number(spark, folder) == -1
    assert [commit_log.append_record(spark, folder, {"v": i}) for i in range(3)] == [0, 1, 2]
    path = f"{folder}/x.json"
    assert commit_log.create_once(spark, path, {"v": 1}) and not commit_log.create_once(spark, path, {"v": 2})
    assert commit_log.read_record(spark, path) == {"v": 1}
    assert commit_log.read_record(spark, f"{folder}/none.json") is None


def test_numbers_go_on_over_full_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "PER_FOLDER", 2)
    folder = str(tmp_path / "log")
    assert [commit_log.append_record(spark, folder, {}) for _ in range(5)] == [0, 1, 2, 3, 4]
    assert [r["number"] for r in commit_log.newest_records(spark, folder)] == [4, 3, 2, 1, 0]


def test_duplicate_names_are_released_as_positional_rows(spark, customers, tmp_path):
    store, path = str(tmp_path / "store"), str(tmp_path / "trail")
    twice = guard(customers, [Col("email"), Col("email")])
    entry = release_after_audit(twice, store, path, release_id="d", request_id=1, timestamp_ms=0)
    assert entry["columns"] == ["email", "email"] and entry["row_count"] == 3
    got = {r.row for r in releases.read_release(spark, store, "d").collect()}
    assert got == {'["a***@example.com","a***@example.com"]', "[null,null]", '["",""]'}


def test_a_query_that_fails_while_running_is_audited_as_such(spark, customers, tmp_path):
    store, path = str(tmp_path / "store"), str(tmp_path / "trail")
    broken = customers.filter(F.raise_error(F.lit("boom")).isNull())
    with pytest.raises(QueryFailed):
        release_after_audit(
            guard(broken, [Star()], tables=["customers"]), store, path, release_id="b", request_id=5, timestamp_ms=0
        )
    (record,) = trail(spark, path)
    assert (record.outcome, record.category) == ("DATABASE_FAILURE", "EXECUTION_FAILURE")


def test_refusals_are_audited_and_a_broken_trail_does_not_replace_them(spark, customers, tmp_path):
    path = str(tmp_path / "trail")
    refusals = []
    for spec in ([Star(), Col("id")], [Col("nope")], [Computed(F.upper("email"))]):
        try:
            guarded_read(customers, spec)
        except (PolicyRejected, QueryFailed, MaskingRefused) as refusal:
            refusals.append(refusal)
    refusals.append(InternalFailure("x"))
    for i, refusal in enumerate(refusals):
        assert audit_refusal(spark, refusal, path, request_id=i + 1, timestamp_ms=0, tables=["customers"])
    got = [(r.outcome, r.reason, r.category, r.column_count, r.referenced_tables) for r in trail(spark, path)]
    assert got == [
        ("POLICY_REJECTED", "UNATTRIBUTABLE_PROJECTION", None, None, ["customers"]),
        ("DATABASE_FAILURE", None, "EXECUTION_FAILURE", None, ["customers"]),
        ("MASKING_REFUSED", None, None, 1, ["customers"]),
        ("INTERNAL_FAILURE", None, None, None, None),
    ]
    assert not audit_refusal(
        spark, refusals[0], path, request_id=9, timestamp_ms=0, append=never
    )


def _batches(spark, path):
    for lo in (0, 5):
        rows = [(i, f"u{i}@example.com") for i in range(lo, lo + 5)]
        spark.createDataFrame(rows, "id int, email string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("id int, email string").option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_mask_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    jobs.stream_mask(_batches(spark, source), [Star()], out, str(tmp_path / "c")).awaitTermination()
    expected = guarded_read(spark.read.parquet(source), [Star()])
    assert sorted(spark.read.parquet(out).collect()) == sorted(expected.collect())
    with pytest.raises(MaskingRefused):
        jobs.stream_mask(_batches(spark, source), [Computed(F.upper("email"))], out, str(tmp_path / "c2"))


def test_replayed_stream_batches_add_nothing(spark, tmp_path):
    store, path = str(tmp_path / "store"), str(tmp_path / "trail")
    source = str(tmp_path / "in")
    _batches(spark, source)

    for checkpoint in ("c1", "c2"):
        stream = spark.readStream.schema("id int, email string").option("maxFilesPerTrigger", 1).parquet(source)
        jobs.stream_release_after_audit(
            stream, [Star()], store, path, str(tmp_path / checkpoint), timestamp_ms=lambda _: 0
        ).awaitTermination()
    assert [(r.request_id, r.row_count) for r in trail(spark, path)] == [(1, 5), (2, 5)]
    got = releases.read_all(spark, store)
    assert sorted(r.id for r in got.collect()) == list(range(10))
    assert got.filter("email LIKE 'u***@%'").count() == 10


def test_a_refused_batch_leaves_its_record_and_the_stream_goes_on(spark, tmp_path):
    store, path, source = (str(tmp_path / n) for n in ("store", "trail", "in"))
    stream = _batches(spark, source).filter(F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).isNull())
    jobs.stream_release_after_audit(
        stream, [Star()], store, path, str(tmp_path / "c"), timestamp_ms=lambda i: i, tables=["people"]
    ).awaitTermination()
    found = [(r.request_id, r.outcome, r.row_count, r.referenced_tables) for r in trail(spark, path)]
    assert sorted(f[1:] for f in found) == [
        ("DATABASE_FAILURE", None, ["people"]), ("SUCCESS", 5, ["people"])
    ]
    assert [f[0] for f in found] == [1, 2] and releases.read_all(spark, store).count() == 5


def test_reading_all_releases_collects_no_folders_and_skips_unpublished(spark, tmp_path):
    store = str(tmp_path / "store")
    for i in range(4):
        df = spark.createDataFrame([(i, 2)], "a int, b int")
        entry = releases.stage(df, store, f"r{i}")
        if i % 2:
            releases.publish(spark, store, entry)
    releases.stage(spark.createDataFrame([("x", "y")], "a string, b string"), store, "other-schema")
    got = releases.read_all(spark, store)
    assert sorted(r.a for r in got.collect()) == [1, 3]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    releases.publish(spark, store, releases.stage(spark.createDataFrame([(9, 9)], "a int, b int"), store, "r1"))
    assert sorted(r.a for r in releases.read_all(spark, store).collect()) == [3, 9]
    releases.publish(spark, store, releases.stage(spark.createDataFrame([("x",)], "a string"), store, "s"))
    with pytest.raises(ValueError, match="several schemas"):
        releases.read_all(spark, store)
    for bad in ("", "../x", "_x", "a/b", ".x"):
        with pytest.raises(ValueError, match="release id"):
            releases.stage(df, store, bad)


def test_reading_all_releases_never_leaves_one_out(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    releases.publish(spark, store, releases.stage(df, store, "plain"))
    assert releases.read_all(spark, store).count() == 1
    assert releases.read_release(spark, store, "plain").count() == 1
    releases.publish(spark, store, releases.stage(df.select("a", "a"), store, "twice"))
    with pytest.raises(ValueError, match="twice"):
        releases.read_all(spark, store)
    with pytest.raises(LookupError):
        releases.read_release(spark, store, "none")


def test_a_failure_of_any_kind_is_refused_and_recorded(spark, tmp_path, monkeypatch):
    def broken(*_):
        raise OSError("disk")

    monkeypatch.setattr(release.releases, "stage", broken)
    result = guard(spark.createDataFrame([(1,)], "a int"), [Col("a")])
    trail = str(tmp_path / "trail")
    with pytest.raises(InternalFailure):
        release.release_after_audit(
            result, str(tmp_path / "s"), trail, release_id="r", request_id=1, timestamp_ms=0
        )
    lines = spark.read.option("recursiveFileLookup", "true").text(trail).collect()
    assert [r.value for r in lines if "INTERNAL_FAILURE" in r.value]


def test_request_stream_is_triaged_like_the_batch(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = [
        (1, "application/json", '{"sql": "select 1"}'), (2, "text/plain", '{"sql": "select 1"}'),
        (3, "application/json; charset=utf-8", "[1]"), (4, "application/json", '{"sql": 7}'), (5, None, None),
        (6, "application/json", '{"sql": "' + "x" * (vocab.MAX_SQL_BYTES + 1) + '"}'), (7, "application/json", '{"sql": ""}'),
    ]
    make = lambda part: spark.createDataFrame(part, requests.REQUEST_SCHEMA)
    requests.write_requests(make(rows[:4]), log)
    checkpoint = str(tmp_path / "checkpoint")
    jobs.stream_triage(requests.stream_requests(spark, log), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    requests.write_requests(make(rows[4:]), log)
    for _ in range(2):  # the second run finds nothing new
        jobs.stream_triage(requests.stream_requests(spark, log), out, checkpoint).awaitTermination()
    got = {r.request_no: (r.sql, r.transport_code) for r in spark.read.parquet(out).collect()}
    assert len(got) == 7 == spark.read.parquet(out).count()
    assert got == {r.request_no: (r.sql, r.transport_code) for r in triage(requests.read_requests(spark, log)).collect()}
    assert [got[i][1] for i in range(1, 8)] == [
        None, "invalid_content_type", "invalid_json", "invalid_request", "invalid_content_type", "sql_too_large", None,
    ]
