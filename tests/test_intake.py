"""Statement files, positioned text, feed messages and rows by hand: golden cases."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from ledgerloom.operators import chats, importing, manual, matching, rules
from ledgerloom.sources import feed, statement_csv, statement_runs

D = dt.date
KEYS = ["file"]


def _files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file int, text string")


def test_csv_records_and_fields(spark):
    cases = {
        'a,b\n"c, d","e ""f"" g"\n': [["a", "b"], ["c, d", 'e "f" g']],
        '﻿x,y\r\n1,"two\nlines"\r3,4': [["x", "y"], ["1", "two\nlines"], ["3", "4"]],
        '55" TV,9\n"q"z,': [['55" TV', "9"], ["qz", ""]],
        'a,"never closed\nb,c': [["a", "never closed\nb,c"]],
        ",\n\n , \nz": [["z"]],
        '""""': [['"']],
        "": [],
        None: [],
    }
    rows = statement_csv.rows(_files(spark, *cases), KEYS).orderBy("file", "row").collect()
    for k, want in enumerate(cases.values()):
        assert [r.cells for r in rows if r.file == k] == want, k


def test_header_detection_and_roles(spark):
    files = _files(
        spark,
        "Bank\nDate range,all\n\nPosting Date,Description,Amount\n1/2/26,Shop,-5.00\n\n2026-01-03,Two\n",
        "Date,Memo,Debit,Credit\n1/2/26,x,5,\n1/3/26,y,,7\n",
        "Transaction Date,Transaction,Amount,Withdrawal\n1/2/26,z,4,\n",
        "no,header,here\n1,2,3\n",
        None,
    )
    got = [tuple(r) for r in statement_csv.statement_cells(files, KEYS).orderBy("file", "row").collect()]
    assert got == [(0, 4, "1/2/26", "Shop", None, None, "-5.00"), (0, 6, "2026-01-03", "Two", None, None, ""), (1, 1, "1/2/26", "x", "5", "", None), (1, 2, "1/3/26", "y", "", "7", None), (2, 1, "1/2/26", "z", None, None, "4")]
    built = importing.built(statement_csv.statement_cells(files.withColumn("household_id", F.lit(1)).withColumn("account_id", F.col("file").cast("long")), ["household_id", "account_id"]))
    assert {(r.account_id, str(r.amount), r.reason) for r in built.collect()} == {(0, "5.00", None), (0, "0.00", "zero amount"), (1, "5.00", None), (1, "-7.00", None), (2, "-4.00", None)}
    kinds = spark.createDataFrame([("a.PDF", None, 0), ("b.csv", "application/pdf", 1), ("c.txt", "text/plain", 2)], "name string, mime string, position int").withColumn("kind", statement_csv.file_kind(F.col("name"), F.col("mime"))).withColumn("b", F.lit(1))
    assert [r.kind for r in kinds.collect()] == ["pdf", "pdf", "csv"]
    assert statement_csv.batch_plan(kinds, ["b"]).first().ok is False and statement_csv.batch_plan(kinds.where("kind = 'pdf'"), ["b"]).first().files == "a.PDF, b.csv"


def test_external_ids_are_those_of_the_wire_format(spark):
    texts = ["", "a", "foobar", "é漢🙂", None, "2026-01-02|5.00|SHOP"]

    def plain(text):
        value = 0xCBF29CE484222325
        data = (text or "").encode("utf-16-le")
        for k in range(0, len(data), 2):
            value = ((value ^ (data[k] | data[k + 1] << 8)) * 0x100000001B3) % 2**64
        return f"{value:016x}"

    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", importing.fnv1a64("t").alias("h")).orderBy("k").collect()
    assert [r.h for r in got] == [plain(t) for t in texts] and plain("a") == "af63dc4c8601ec8c"


def _run(page, x, y, text, w=20.0):
    return (1, page, float(x), float(y), float(w), 9.0, text)


def test_lines_cells_and_years_of_positioned_text(spark):
    runs = [
        _run(1, 40, 10, "Statement period Dec 25 - Jan 23, 2026"), _run(1, 40, 30, "Revised 05/01/2023"), _run(1, 40, 50, "Dec 28"), _run(1, 90, 52, "Corner"), _run(1, 120, 48.5, "Shop"), _run(1, 540, 51, "$1,234.56"),
        _run(1, 40, 64, "5 Jan"), _run(1, 90, 64, "Two"), _run(1, 540, 64, "−45.00"), _run(2, 40, 10, "2026"),
    ]
    df = spark.createDataFrame(runs, "file int, page int, x double, y double, w double, h double, text string")
    placed = statement_runs.lined(df, KEYS)
    lines = statement_runs.lines(placed, KEYS).orderBy("page", "line").collect()
    assert [r.text for r in lines] == ["Statement period Dec 25 - Jan 23, 2026", "Revised 05/01/2023", "Dec 28 Corner Shop $1,234.56", "5 Jan Two −45.00", "2026"]
    cells = {(r.line, r.cell): r.text for r in statement_runs.line_cells(placed, KEYS, [0.13, 0.8], 600.0).where("page = 1 and line >= 2").collect()}
    assert cells == {(2, 0): "Dec 28", (2, 1): "Corner Shop", (2, 2): "$1,234.56", (3, 0): "5 Jan", (3, 1): "Two", (3, 2): "−45.00"}
    window = statement_runs.year_windows(placed, KEYS).first()
    assert (window.first, window.last, window.source) == (D(2025, 11, 10), D(2026, 3, 9), "period")
    said = ["Dec 28", "5 January", "Sept. 3, 2024", "3/4/26", "2026-02-30", "Feb 29", "hello", ""]
    dates = spark.createDataFrame([(s,) for s in said], "s string").select(statement_runs.flexible_date(F.col("s"), F.lit(window.first), F.lit(window.last)).alias("d")).collect()
    assert [r.d for r in dates] == [D(2025, 12, 28), D(2026, 1, 5), D(2024, 9, 3), D(2026, 3, 4), None, D(2024, 2, 29), None, None]
    without = statement_runs.year_windows(statement_runs.lined(df.where("y > 20"), KEYS), KEYS).first()
    assert (without.first, without.last, without.source) == (D(2023, 1, 1), D(2023, 6, 15), "printed")


def test_shapes_of_money_dates_and_headings(spark):
    money = {"$1,234.56": True, "- $69.31": True, "(45.00)": True, "2026": False, "−5.00": True, "12.5": False, "": False, "1,000": True}
    got = spark.createDataFrame([(k,) for k in money], "s string").select(statement_runs.looks_like_money(F.col("s")).alias("m")).collect()
    assert [r.m for r in got] == list(money.values())
    heads = {"Deposits and other additions": "in", "Payments and other credits": "in", "Checks": "out", "Fees 3": None, "x" * 81 + " fees": None, "Hello": None}
    got = spark.createDataFrame([(k,) for k in heads], "s string").select(statement_runs.section(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == list(heads.values())


def test_feed_messages_by_words_code_and_bank(spark):
    entries = [
        ({"code": "DATE_RANGE_EXCEEDED", "msg": "Please reconnect - credentials expired", "conn_id": "c"}, "error"), ({"code": "date-range.capped", "msg": "odd", "conn_id": "c"}, "capped"),
        ({"code": "DATE_RANGE_RECOMMENDED", "msg": ""}, "advisory"), ({"msg": "The date range requested exceeds the limit and was capped", "account_id": "a"}, "error"), ({"message": "Requested date range exceeds recommended range. It may be capped"}, "advisory"),
        ({"msg": "date range limit is 90 days"}, "capped"), ({"msg": "hello", "code": "X"}, "error"), ({"code": ""}, None),
    ]
    body = json.dumps({"errlist": [e for e, _ in entries], "errors": ["requested range maximum <b>90</b>\u0007 days", ""]})
    got = feed.feed_messages(feed.parsed(spark.createDataFrame([(1, body), (2, "broken"), (3, None)], "household_id int, json string"))).collect()
    assert sorted(r.kind for r in got) == sorted([k for _, k in entries if k] + ["capped"])
    assert "requested range maximum 90 days" in {r.message for r in got} and "hello (X)" in {r.message for r in got}


def test_pairs_and_rules_stay_in_their_household(spark):
    from decimal import Decimal

    row = lambda h, i, account, amount: (h, i, account, D(2026, 7, 1), Decimal(amount), "depository", False, None, "SHOP ONE", "", None)
    schema = "household_id int, id long, account_id long, date date, amount decimal(14,2), account_type string, excluded boolean, user_type string, description string, mapped_category string, user_category string"
    rows = spark.createDataFrame([row(1, 1, 1, "50"), row(1, 2, 2, "-50"), row(2, 1, 1, "50"), row(2, 2, 2, "-60")], schema)
    assert {(r.household_id, r.id) for r in matching.mark_internal(rows).where("internal").collect()} == {(1, 1), (1, 2)}
    taught = spark.createDataFrame([(1, "SHOP", "A", None), (1, "SHOP ONE", "A", Decimal("50.00")), (2, "SHOP", "B", None)], "household_id int, merchant_key string, category string, amount decimal(14,2)")
    assert {(r.household_id, r.id): r.mapped_category for r in rules.classify(rows, taught).collect()} == {(1, 1): "A", (1, 2): "A", (2, 1): "B", (2, 2): "B"}
    counts = {(r.household_id, r.merchant_key): r.matched for r in rules.rule_matches(rows, taught).collect()}
    assert counts == {(1, "SHOP ONE"): 1, (1, "SHOP"): 1, (2, "SHOP"): 2}


def test_rows_by_hand(spark):
    made = manual.account_rows(spark.createDataFrame([(1, " Car ", "loan", "100.005"), (1, None, "boat", "5"), (1, "Visa", "credit", "-3"), (1, "", "savings", None)], "household_id int, name string, kind string, balance string")).collect()
    assert [(r.name, r.type, r.subtype, r.current_balance and float(r.current_balance), r.problem) for r in made] == [
        ("Car", "loan", "loan", 100.01, None), ("Imported account", "depository", "checking", None, None), ("Visa", "credit", "credit card", None, "a debt is entered as a positive amount"), ("Imported account", "depository", "savings", None, None),
    ]
    held = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "household_id int, entity_id int, name string")
    edits = spark.createDataFrame([(1, 1, 1, "update", "x"), (1, 1, 2, "update", "y"), (1, 2, 1, "delete", None), (1, 3, 1, "add", "n"), (1, 4, 1, "update", "z")], "household_id int, entity_id int, position int, action string, name string")
    assert {tuple(r) for r in manual.edit_rows(held, edits, "entity_id", ["name"]).collect()} == {(1, 1, "y"), (1, 3, "n"), (2, 1, "c")}
    day = lambda *a: spark.range(1).select(manual.overlap_from(*(F.lit(x).cast(t) for x, t in zip(a, ("date", "date", "boolean", "date", "boolean")))).alias("d")).first().d
    assert [day("2026-01-05", "2026-01-01", True, "2026-08-01", True), day(None, "2026-04-01", True, "2026-08-01", False), day(None, None, True, "2026-08-31", True), day(None, None, True, "2026-08-31", False), day("2026-01-05", None, False, "2026-08-31", True)] == [D(2026, 1, 5), D(2026, 1, 3), D(2026, 8, 1), None, None]


def test_chats_keep_their_end(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(40)] + [(2, 0, "system", "s"), (2, 1, "assistant", "a"), (3, 0, "user", "u" * 9000), (3, 1, "assistant", "b" * 47000), (3, 2, "user", None), (4, 0, "assistant", "only")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = {}
    for r in chats.trimmed(df).collect():
        got.setdefault(r.conv_id, []).append((r.turn, len(r.text)))
    assert sorted(got) == [1, 3] and min(got[1])[0] == 12 and len(got[1]) == 28 and sorted(got[3]) == [(0, 8000), (1, 8000)]
    titles = spark.createDataFrame([("  a\n b ",), ("w" * 61,), ("",), (None,)], "s string").select(chats.title(F.col("s")).alias("t")).collect()
    assert [r.t for r in titles] == ["a b", "w" * 57 + "…", "Chat", "Chat"]
    shelf = spark.createDataFrame([(1, k, 40_000) for k in range(12)], "owner int, position int, chars int")
    assert sorted(r.position for r in chats.shelf(shelf, ["owner"]).collect()) == [5, 6, 7, 8, 9, 10, 11]


def test_backlog_settles_in_one_call_and_duplicates_are_gated(spark):
    from decimal import Decimal

    from ledgerloom.operators import recurring

    kind = "household_id int, id long, recurring_key string, account_id long, due_date date, description string, amount decimal(14,2), cadence string, status string, matched_tx_id long"
    bill = lambda i, key, due, cadence="weekly", status="pending", tx=None: (1, i, key, 5, due, "GYM CLUB", Decimal(20), cadence, status, tx)
    paid = lambda i, day: (1, i, 5, day, Decimal(20), "Gym Club 123", None)
    rows = spark.createDataFrame([paid(10, D(2026, 3, 2)), paid(11, D(2026, 3, 9)), paid(12, D(2026, 3, 15)), paid(13, D(2026, 3, 22)), paid(14, D(2025, 11, 1))], "household_id int, id long, account_id long, date date, amount decimal(14,2), description string, merchant_name string")
    done = recurring.settle_all(spark.createDataFrame([bill(1, "gym", D(2026, 3, 1))], kind), rows, "2026-03-25")
    assert sorted((r.due_date, r.status, r.matched_tx_id) for r in done.collect()) == [(D(2026, 3, 1), "matched", 10), (D(2026, 3, 8), "matched", 11), (D(2026, 3, 15), "matched", 12), (D(2026, 3, 22), "matched", 13), (D(2026, 3, 29), "pending", None)]
    # A claimed transaction is out, what is pending already isn't put in again, and a single bill doesn't go on.
    held = [bill(1, "gym", D(2026, 3, 1)), bill(2, "gym", D(2026, 3, 8), status="matched", tx=11), bill(3, "gym", D(2026, 4, 20)), bill(4, None, D(2026, 3, 15), "once"), bill(5, None, None)]
    done = recurring.settle_all(spark.createDataFrame(held, kind), rows, "2026-03-25")
    assert sorted((r.origin, str(r.due_date), r.status, r.matched_tx_id) for r in done.collect()) == [(1, "2026-03-01", "matched", 10), (1, "2026-03-08", "pending", None), (2, "2026-03-08", "matched", 11), (3, "2026-04-20", "pending", None), (4, "2026-03-15", "matched", 12), (5, "None", "pending", None)]


def test_accounts_are_told_apart_by_household(spark):
    """Account 7 of two households."""
    from decimal import Decimal

    from ledgerloom.operators import balances, importing
    from ledgerloom.sources.ledger import Ledger

    accounts = spark.createDataFrame(
        [(h, 7, "n", kind, "x", False, Decimal(b), Decimal(m), None) for h, kind, b, m in ((1, "credit", 100, 25), (2, "loan", 400, 50))],
        "household_id int, account_id long, name string, type string, subtype string, hidden boolean, current_balance decimal(14,2), minimum_payment decimal(14,2), entity_id long",
    ).selectExpr("*", "12.0D as apr", "12.0D as interest_rate", "cast(null as decimal(14,2)) as credit_limit", "cast(null as decimal(14,2)) as original_balance", "date'2026-01-01' as created_on")
    rows = spark.createDataFrame([(h, h, 7, D(2026, 1, d)) for h, d in ((1, 5), (2, 9))], "household_id int, id long, account_id long, date date")
    assert sorted((r.household_id, r.account_type) for r in Ledger({"accounts": accounts, "transactions": rows}).between("2026-01-01", "2026-01-31").collect()) == [(1, "credit"), (2, "loan")]
    alone = {h: balances.payoff(accounts.where(f"household_id = {h}")).first() for h in (1, 2)}
    assert {r.household_id: r for r in balances.payoff(accounts).collect()} == alone
    snaps = spark.createDataFrame([(1, 7, D(2026, 1, 1), Decimal(5)), (2, 7, D(2026, 1, 2), Decimal(9))], "household_id int, account_id long, captured_on date, balance decimal(14,2)")
    assert sorted((r.household_id, r.total) for r in balances.net_worth(snaps, accounts).collect()) == [(1, -5.0), (2, -9.0)]
    pulled = spark.createDataFrame([(1, 7, Decimal(100)), (2, 7, Decimal(1))], "household_id int, account_id long, balance decimal(14,2)")
    assert [(r.household_id, r.account_id) for r in importing.changed_snapshots(accounts, pulled, "2026-01-03").collect()] == [(2, 7)]
    assert sorted((r.household_id, r.served_from.day) for r in importing.coverage_gaps(accounts, rows).collect()) == [(1, 5)]
