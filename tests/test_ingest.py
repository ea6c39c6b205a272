"""The ingest job: amended rows, batches run again after a failure between tables, moved months, watermark and throttle."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from ledgerloom.operators import settings
from ledgerloom.functions.storage import VersionedTable
from ledgerloom.streaming import ingest

DAY = 86400
BASE = 1767225600  # 2026-01-01


def _tx(i, day, amount="-1.50", pending=False, text="SHOP"):
    return {"id": i, "posted": BASE + day * DAY, "amount": amount, "description": text, "pending": pending}


def _envelope(*accounts, errors=(), household=1, at="2026-02-10 10:00:00", backfill=False):
    body = {"errors": list(errors), "accounts": [{"id": a, "name": n, "balance": b, "org": {"name": o}, "transactions": t} for a, n, o, b, t in accounts]}
    return (household, f"url{household}", datetime.fromisoformat(at), backfill, json.dumps(body))


def _batch(spark, *envelopes):
    return spark.createDataFrame(list(envelopes), ingest.ENVELOPES)


def _transactions(job):
    return sorted((r.external_id, str(r.date), float(r.amount), r.pending) for r in job.table("transactions").collect())


def test_pending_becomes_posted_and_users_columns_stay(spark, tmp_path):
    job = ingest.Ingest(spark, str(tmp_path / "ledger"), buckets=4)
    job.batch(_batch(spark, _envelope(("A", "Visa card", "Bank", "-20.00", [_tx("t1", 30, pending=True), _tx("t2", 5), _tx("t2", 6, "-9")]))), 0)
    assert _transactions(job) == [("sfin:t1", "2026-01-31", 1.5, True), ("sfin:t2", "2026-01-06", 1.5, False)]
    (account,) = job.table("accounts").collect()
    assert (account.type, account.hidden, float(account.current_balance)) == ("credit", True, 20.0)
    # The user's edits, which no pull may touch.
    from pyspark.sql import functions as F

    edited = [r.asDict() | {"user_category": "Mine"} for r in job.table("transactions").collect()]
    spark.createDataFrame(edited, job.schema("transactions")).write.mode("overwrite").partitionBy("part").parquet(f"{job.folder}/transactions")
    shown = [r.asDict() | {"hidden": False, "type": "depository", "nickname": "Nick"} for r in job.table("accounts").collect()]
    spark.createDataFrame(shown, job.schema("accounts")).write.mode("overwrite").partitionBy("part").parquet(f"{job.folder}/accounts")
    # Posted a day later, in another month, for another amount; a second bank; and no balance this time.
    job.batch(_batch(spark, _envelope(("A", "Visa card", "Bank", "", [_tx("t1", 31, "-2.50")]), ("B", "Savings", "Other", "7", []), at="2026-02-11 10:00:00")), 1)
    assert _transactions(job) == [("sfin:t1", "2026-02-01", 2.5, False), ("sfin:t2", "2026-01-06", 1.5, False)]
    assert {r.user_category for r in job.table("transactions").collect()} == {"Mine"}
    by = {r.external_id: r for r in job.table("accounts").collect()}
    assert (by["sfin:A"].hidden, by["sfin:A"].type, by["sfin:A"].nickname, float(by["sfin:A"].current_balance)) == (False, "depository", "Nick", 20.0)
    assert by["sfin:B"].subtype == "savings" and by["sfin:B"].hidden
    assert sorted((str(r.captured_on), float(r.balance)) for r in job.table("snapshots").collect()) == [("2026-02-10", 20.0), ("2026-02-11", 7.0)]
    assert job.table("institutions").where(~F.col("disabled")).count() == 2


@pytest.mark.parametrize("broken", ["snapshots"])
def test_a_batch_that_failed_between_tables_is_run_again(spark, tmp_path, monkeypatch, broken):
    first = _batch(spark, _envelope(("A", "Checking", "Bank", "5", [_tx("t1", 30)])))
    second = _batch(spark, _envelope(("A", "Checking", "Bank", "6", [_tx("t1", 33, "-7"), _tx("t3", 34)]), at="2026-02-12 10:00:00"))
    whole = ingest.Ingest(spark, str(tmp_path / "whole"), buckets=2)
    job = ingest.Ingest(spark, str(tmp_path / "broken"), buckets=2)
    for j in (whole, job):
        j.batch(first, 0)
    whole.batch(second, 1)
    publish = ingest.Ingest.publish

    def failing(self, table, plan):
        if table == broken:
            raise OSError("lost")
        publish(self, table, plan)

    monkeypatch.setattr(ingest.Ingest, "publish", failing)
    with pytest.raises(OSError, match="lost"):
        job.batch(second, 1)
    monkeypatch.setattr(ingest.Ingest, "publish", publish)
    job.batch(second, 1)
    job.batch(second, 1)
    for table in ingest.TABLES:
        rows = [sorted(map(str, j.table(table).select(*sorted(j.table(table).columns)).collect())) for j in (whole, job)]
        assert rows[0] == rows[1], table
    assert len(job.table("snapshots").collect()) == 2 and _transactions(job) == [("sfin:t1", "2026-02-03", 7.0, False), ("sfin:t3", "2026-02-04", 1.5, False)]


def test_counts_watermark_and_throttle(spark, tmp_path):
    job = ingest.Ingest(spark, str(tmp_path / "ledger"), buckets=2)
    job.batch(_batch(spark, _envelope(("A", "Checking", "Bank", "5", [_tx("t1", 1), _tx("t2", 2)])), _envelope(household=2, errors=["Requested date range exceeds recommended range."]), _envelope(("A", "x", "Bank", "1", []), household=3, errors=["credentials expired"])), 0)
    counts = job.files.read("_batches/0")["tables"]["transactions"]
    assert (counts["inserted"], counts["changed"], counts["rows"]) == (2, 0, 2)
    by = {r.household_id: r for r in job.access.read()[1].collect()}
    assert by[1].last_pulled_at == datetime(2026, 2, 10, 10) and by[1].last_error is None
    assert by[2].last_pulled_at is None and "recommended" in by[2].last_error  # nothing but a note: the pull failed
    assert by[3].last_pulled_at is None and by[3].last_error == "credentials expired"
    job.batch(_batch(spark, _envelope(("A", "Checking", "Bank", "5", [_tx("t1", 1, "-3"), _tx("t2", 2)]), at="2026-02-11 10:00:00", errors=["date range capped"]), _envelope(errors=["bank unavailable"], backfill=True, at="2026-02-11 10:00:00")), 1)
    counts = job.files.read("_batches/1")["tables"]["transactions"]
    assert (counts["inserted"], counts["changed"]) == (0, 1)
    assert {r.household_id: r.last_pulled_at for r in job.access.read()[1].collect()}[1] is None  # its history is to be asked for again

    assert ingest.begin(job, "2026-02-11 10:05:00").count() == 3
    assert ingest.begin(job, "2026-02-11 10:30:00").count() == 0
    assert ingest.begin(job, "2026-02-11 10:30:00", force=True).count() == 3
    assert ingest.begin(job, "2026-02-11 11:31:00").count() == 3


def test_the_second_writer_of_a_version_loses_and_merges_again(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "settings"), "household_id int, key string, value string")
    edit = lambda op, item: spark.createDataFrame([(1, "ignored", 1, op, item)], "household_id int, key string, seq int, op string, item string")
    assert table.commit(0, spark.createDataFrame([(1, "ignored", '["a"]'), (1, "other", "x")], table.schema))
    version, seen = table.read()
    assert table.commit(version, settings.merged(seen, edit("add", "b")))
    assert not table.commit(version, settings.merged(seen, edit("add", "c")))  # the other device has read the same version
    rows = table.update(lambda now: settings.merged(now, edit("add", "c")))
    assert {r.key: r.value for r in rows.collect()} == {"ignored": '["a","b","c"]', "other": "x"}

    def fails(_):
        raise ValueError("read failed")

    with pytest.raises(ValueError, match="read failed"):
        table.update(fails)
    assert table.read()[0] == 3


def test_stream_of_envelopes(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def arrive(name, *envelopes):
        lines = [json.dumps({"household_id": h, "access_url": u, "pulled_at": at.isoformat(), "backfill": b, "json": j}) for h, u, at, b, j in envelopes]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    job = ingest.Ingest(spark, str(tmp_path / "ledger"), buckets=2)
    run = lambda: ingest.start(ingest.read_envelopes(spark, str(tmp_path / "in")), job, str(tmp_path / "state")).awaitTermination()
    arrive("a.json", _envelope(("A", "Checking", "Bank", "5", [_tx("t1", 1, pending=True)])))
    run()
    arrive("b.json", _envelope(("A", "Checking", "Bank", "5", [_tx("t1", 2, "-4")]), at="2026-02-12 10:00:00"), (9, "u9", datetime(2026, 2, 12), None, "broken"))
    run()
    run()
    assert _transactions(job) == [("sfin:t1", "2026-01-03", 4.0, False)]
    assert {r.household_id: r.last_error for r in job.access.read()[1].collect()} == {1: None, 9: "unreadable answer"}
