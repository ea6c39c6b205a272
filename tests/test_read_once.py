"""Statement files and printed statements are read once, whatever is asked of their rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.plans import statements
from ledgerloom.sources import feed, statement_csv, statement_runs


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_of_a_file_are_split_once_and_meet_no_join(spark):
    files = spark.createDataFrame([(1, "Bank\n\nDate,Memo,Debit,Credit\n1/2/2026,\"a, b\",5,\n,,,\n1/3/2026,c,,7"), (2, "no header\n1,2"), (3, None), (4, "date,memo,amount\r\r2026-01-01,x,1\r")], "file int, text string")
    found = statement_csv.statement_cells(files, ["file"])
    assert [tuple(r) for r in found.orderBy("file", "row").collect()] == [(1, 3, "1/2/2026", "a, b", "5", "", None), (1, 5, "1/3/2026", "c", "", "7", None), (4, 2, "2026-01-01", "x", None, None, "1")]
    plan = _plan(found)
    assert "Join" not in plan and plan.count("(?:\\r\\n|\\r|\\n|\\z)") == 1


def test_lines_are_those_of_a_walk_and_pages_may_cross_batches(spark):
    rnd = random.Random(5)
    rows = [(f, p, float(k), round(rnd.choice([0.0, 100.0, 103.0, 106.0, 110.0]) + rnd.choice([0.0, 0.0, 1.3, 3.0, 2.6]), 1), "t") for f in (None, "a", "b") for p in (1, 2, 3) for k in range(rnd.choice([1, 2, 9, 40]))]
    want = {}
    for f, p in {r[:2] for r in rows}:
        line, mean, n = -1, 0.0, 0
        for r in sorted((r for r in rows if r[:2] == (f, p)), key=lambda r: (r[3], r[2])):
            if n and abs(r[3] - mean) <= statement_runs.Y_TOLERANCE:
                n += 1
                mean = (mean * (n - 1) + r[3]) / n
            else:
                line, mean, n = line + 1, r[3], 1
            want[r[:4]] = line
    runs = spark.createDataFrame(rows, "file string, page int, x double, y double, text string").withColumn("w", F.lit(5.0)).withColumn("h", F.lit(9.0))
    for most in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            got = statement_runs.lined(runs, ["file"]).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(r.file, r.page, r.x, r.y): r.line for r in got} == want and len(got) == len(rows)


def test_the_period_of_a_file_is_found_in_one_pass(spark):
    runs = [
        (1, 1, 20.0, "Statement Dec 25 - Jan 23, 2026"), (1, 1, 40.0, "05/01/2023"), (2, 1, 20.0, "hello"), (2, 2, 20.0, "3/4/2024"), (2, 2, 40.0, "Mar 8, 2024 and 2024-03-02"), (3, 1, 20.0, "paid 1/2/1999"),
        (3, 2, 20.0, "1/2/2001 1/3/2001"), (4, 1, 20.0, "none"), (5, 1, 20.0, None), (5, 3, 20.0, "from 1/5/2020 to 2/4/2020"), (5, 4, 20.0, "from 1/5/2021 to 2/4/2021"),
    ]
    placed = statement_runs.lined(spark.createDataFrame(runs, "file int, page int, y double, text string").withColumn("x", F.lit(1.0)).withColumn("w", F.lit(5.0)).withColumn("h", F.lit(9.0)), ["file"])
    found = statement_runs.year_windows(placed, ["file"])
    assert [(r.file, str(r.first), str(r.last), r.source) for r in found.orderBy("file").collect()] == [
        (1, "2025-11-10", "2026-03-09", "period"), (2, "2023-11-05", "2024-04-18", "printed"), (3, "1998-09-04", "1999-02-16", "printed"), (5, "2019-11-21", "2020-03-20", "period")
    ]
    assert "Join" not in _plan(found) and _plan(found).count("MapInArrow") == 1


def test_an_envelope_is_parsed_once_for_its_transactions(spark):
    text = '{"accounts":[{"id":"a","transactions":[{"id":"t","posted":86400,"amount":"5"},{"id":"","posted":1,"amount":"1"}]},null,{"id":"b"}]}'
    raw = spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "household_id int, json string")
    found = feed.feed_transactions(feed.parsed(raw))
    assert [(r.household_id, r.account, r.external_id, float(r.amount)) for r in found.collect()] == [(1, "a", "t", -5.0)]
    assert _plan(found).count("from_json") == 1


def test_items_are_printed_in_one_pass_with_the_text_of_each_page(spark):
    runs = statements._runs(spark, "/root/testdata/sf0.001")
    assert _plan(runs).count("Window [") == 1
    file = [*statements.KEYS]
    pages = runs.groupBy(*file, "page").agg(F.count_if(F.col("text").startswith("Additional")).alias("feet"), F.count_if(F.col("y") == 60).alias("names"), F.count_if(F.col("text").startswith("Statement for")).alias("titles"))
    assert pages.count() > 0
    assert pages.where((F.col("feet") != 1) | ((F.col("names") > 0) != (F.col("household_id") % 8 != 7)) | (F.col("titles") != (F.col("page") == 1).cast("int"))).isEmpty()
