"""The whole report on a small ledger, line by line."""

from __future__ import annotations

import datetime

from ledgerloom.operators import report
from ledgerloom.sources.ledger import TRANSACTION, Ledger, conform

ACCOUNT = "household_id int, account_id long, name string, nickname string, mask string, type string, subtype string, institution string, current_balance double, hidden boolean, entity_id long"
ROW = "household_id int, id long, account_id long, date date, amount double, merchant_name string, description string, mapped_category string, user_category string, user_description string, user_type string, excluded boolean"


def day(text):
    return datetime.date.fromisoformat(text)


def ledger(spark, rows, assignments=None, settings=None):
    accounts = [
        (1, 1, "Everyday", None, "1234", "depository", "checking", "North Bank", 1200.5, False),
        (1, 2, "Nest egg", "Rainy day", "99", "depository", "savings", "", 10.0, None),
        (1, 3, "Plastic", "", "", "credit", None, "North Bank", 55.25, False),
        (1, 4, "House", None, None, "loan", "mortgage", None, 0.0, False),
        (1, 5, "Old", None, None, "depository", "checking", None, 5.0, True),
        (2, 1, "Lone", None, None, "depository", "checking", None, None, False),
    ]
    made = [(*r[:4], *r[4:], *([None] * (12 - len(r)))) for r in rows]
    tables = {"accounts": spark.createDataFrame([(*a, None) for a in accounts], ACCOUNT), "transactions": conform(spark.createDataFrame(made, ROW), TRANSACTION)}
    if assignments is not None:
        tables["assignments"] = spark.createDataFrame(assignments, "household_id int, category string, month date, assigned double")
        tables["envelope_settings"] = spark.createDataFrame(settings, "household_id int, category string, target double, target_kind string, target_date date, rollover boolean")
    return Ledger(tables)


ROWS = [
    (1, 1, 1, day("2026-05-05"), 9.0, "Too old", "", "Food"),
    (1, 2, 1, day("2026-05-20"), 12.5, "Corner Shop", "", "Food"),
    # A pair within a month is no spending; one over a month's end counts on each side.
    (1, 3, 1, day("2026-06-10"), 300.0, "", "TO SAVINGS", "Odd"),
    (1, 4, 2, day("2026-06-11"), -300.0, "", "FROM CHECKING", "Odd"),
    (1, 5, 1, day("2026-06-30"), 70.0, None, "MOVE OUT", "Odd"),
    (1, 6, 2, day("2026-07-01"), -70.0, None, "MOVE IN", "Odd"),
    # A refund outweighs the purchases of its category.
    (1, 7, 3, day("2026-07-02"), 20.0, "River Gear", "", "Gear"),
    (1, 8, 3, day("2026-07-03"), -45.5, "River Gear", "", "Gear"),
    *[(1, 20 + k, 3, day("2026-06-01") + datetime.timedelta(days=7 * k), 8.0 if k < 6 else 9.0, "Veg Box #7", "", "Food") for k in range(7)],
    (1, 40, 3, day("2026-07-04"), 99.0, "Left out", "", "Food", None, None, None, True),
    (1, 41, 4, day("2026-07-04"), 99.0, "Loan", "", "Food"),
    (1, 42, 5, day("2026-07-04"), 99.0, "Hidden", "", "Food"),
    (1, 43, 1, day("2026-07-13"), 5.0, "Corner Shop", "", "Food", "Treats", "My note"),
]
PLAN = [(1, "Food", day("2026-06-01"), 100.0), (1, "Food", day("2026-07-01"), 50.0), (1, "Trip", day("2026-05-01"), 0.0), (1, "Food", day("2026-08-01"), 999.0)]
LIMITS = [(1, "Food", 60.0, "monthly", None, True), (1, "Trip", 900.0, "by_date", day("2026-12-15"), None), (1, "Rent", None, None, None, True)]


def test_whole_report(spark):
    lines = report.context(ledger(spark, ROWS, PLAN, LIMITS), "2026-08-10")
    got = {r.household_id: r.text.split("\n") for r in report.text(lines).collect()}
    head = ["Due dates are relative to the newest transaction (2026-07-13)."]
    want = [
        *report.ACCOUNTS,
        "- Plastic (North Bank, credit): balance $-55.25",
        "- Everyday ··1234 (North Bank, checking): balance $1200.50",
        "- Rainy day (Unknown bank, savings): balance $10.00",
        "- House (Unknown bank, mortgage): balance $0.00",
        *report.MONTHS,
        report.PARTIAL.format(since="2026-05-12", month="2026-05"),
        "- 2026-05 Food: $12.50 (partial month: 2026-05-12 onward only)",
        "- 2026-06 Food: $40.00",
        "- 2026-06 Odd: $70.00",
        "- 2026-07 Food: $17.00",
        "- 2026-07 Gear: $-25.50",
        "- 2026-07 Treats: $5.00",
        *report.RECURRING,
        *head,
        "- Veg Box #7: ~$8.00/wk (Food, every ~7 days, last 2026-07-13, next ~2026-07-20) — price increased: was $8.00, now $9.00",
        "",
        "## Budget envelopes (2026-08)",
        report.ENVELOPES,
        "- Food: assigned $999.00, carried $93.00, spent $0.00, available $1092.00, target $60.00/mo",
        "- Rent: assigned $0.00, carried $0.00, spent $0.00, available $0.00",
        "- Trip: assigned $0.00, carried $0.00, spent $0.00, available $0.00, target $900.00 by 2026-12",
        "Totals: assigned $999.00, carried $93.00, spent $0.00, available $1092.00",
        *report.ROWS,
        "2026-07-13 | Everyday ··1234 | My note | Treats | $5.00",
        "2026-07-13 | Plastic | Veg Box #7 | Food | $9.00",
        "2026-07-06 | Plastic | Veg Box #7 | Food | $8.00",
        "2026-07-03 | Plastic | River Gear | Gear | $-45.50",
        "2026-07-02 | Plastic | River Gear | Gear | $20.00",
        "2026-07-01 | Rainy day | MOVE IN | Odd | $-70.00",
        "2026-06-30 | Everyday ··1234 | MOVE OUT | Odd | $70.00",
        "2026-06-29 | Plastic | Veg Box #7 | Food | $8.00",
        "2026-06-22 | Plastic | Veg Box #7 | Food | $8.00",
        "2026-06-15 | Plastic | Veg Box #7 | Food | $8.00",
        "2026-06-11 | Rainy day | FROM CHECKING | Transfers and card payments | $-300.00",
        "2026-06-10 | Everyday ··1234 | TO SAVINGS | Transfers and card payments | $300.00 | not counted as spending",
        "2026-06-08 | Plastic | Veg Box #7 | Food | $8.00",
        "2026-06-01 | Plastic | Veg Box #7 | Food | $8.00",
        "2026-05-20 | Everyday ··1234 | Corner Shop | Food | $12.50",
    ]
    assert got[1] == want
    # A household without rows or a budget.
    assert got[2] == [*report.ACCOUNTS, "- Lone (Unknown bank, checking): balance $0.00", *report.MONTHS, report.PARTIAL.format(since="2026-05-12", month="2026-05"), *report.RECURRING, "None detected.", *report.ROWS]


def test_report_reads_the_newest_rows_and_whole_months(spark):
    """Rows beyond the newest are left out before loans are; a window from the first of a month has no partial one; no plan, no envelopes."""
    rows = [(1, k, 4 if k == 29 else 1, day("2026-06-01") + datetime.timedelta(days=k // 2), float(k), f"Shop {k}", "", "Food") for k in range(30)]
    lines = report.context(ledger(spark, rows), "2026-08-30", most=4).collect()
    assert [r.line.split(" | ")[2] for r in sorted(lines, key=lambda r: r["rank"]) if r.section == 6 and r["rank"] > 0] == ["Shop 28", "Shop 27", "Shop 26"]
    assert not [r for r in lines if r.section in (4, 5) or "INCOMPLETE" in r.line or "partial month" in r.line]
    empty = report.text(report.context(ledger(spark, []), "2026-08-30"))
    assert {r.household_id for r in empty.collect()} == {1, 2}
