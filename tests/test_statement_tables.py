"""Printed tables on golden pages: columns found or refused, sections, anchors, wraps and reversals."""

from __future__ import annotations

import pytest

from ledgerloom.sources import statement_runs, statement_tables

KEYS = ["file"]


def _page(lines, page=1, first=100.0, pitch=17.0):
    """Runs of lines: each a list of (x, text), or (y, list)."""
    out, y = [], first
    for line in lines:
        if isinstance(line, tuple):
            y, line = line
        out += [(1, page, float(x), y, 5.0 * len(t), 8.0, t, 600.0) for x, t in line]
        y += pitch
    return out


def _read(spark, runs, layout=None, fits=False, **change):
    df = spark.createDataFrame(runs, "file int, page int, x double, y double, w double, h double, text string, width double")
    placed = statement_runs.lined(df, KEYS)
    if layout is None:
        layout = statement_tables.layouts(placed, KEYS)
    for name, value in change.items():
        layout = layout.withColumn(name, value)
    windows = statement_runs.year_windows(placed, KEYS)
    rows = statement_tables.table_rows(placed, KEYS, layout, windows).orderBy("row").collect()
    return layout.collect(), rows, statement_tables.layout_fits(placed, KEYS, layout, windows).collect() if fits else []


TITLE = (20.0, [(40, "Statement period Dec 25, 2025 - Jan 23, 2026")])


def _row(date, text, money, end=560):
    return [(40, date), (150, text), (end - 5 * len(money), money)]


def test_sections_turn_signs_over_pages_and_totals_end_them(spark):
    head = [(40, "Date"), (150, "Description"), (525, "Amount")]
    one = _page([TITLE, (60.0, [(40, "Deposits and Credits")]), (77.0, head), _row("Dec 28", "PAY", "600.00"), _row("Dec 29", "Reversal", "-50.00")])
    two = _page([(60.0, head), _row("Jan 2", "MORE PAY", "10.00"), [(40, "TOTAL DEPOSITS 560.00")], _row("Jan 3", "Odd heading's row", "7.00"), [(40, "Electronic Withdrawals")], _row("Jan 4", "RENT", "900.00"), (158.0, [(150, "PREAUTHORIZED PAYMENT")]), (171.0, [(300, "Additional Information")])], page=2)
    (layout,), rows, (fit,) = _read(spark, one + two, fits=True)
    assert layout.roles == ["date", "description", "amount"] and layout.amount_mode == "signed" and layout.start_anchor == "Date Description Amount"
    assert [(r.date_cell, r.description_cell, r.amount_cell, r.section) for r in rows] == [
        ("2025-12-28", "PAY", "-600.00", "in"), ("2025-12-29", "Reversal", "50.00", "in"), ("2026-01-02", "MORE PAY", "-10.00", "in"), ("2026-01-03", "Odd heading's row", "7.00", None), ("2026-01-04", "RENT PREAUTHORIZED PAYMENT", "900.00", "out"),
    ]
    assert (fit.rows, fit.anchor_found, fit.suspect) == (5, True, False)


def test_signs_that_agree_with_headings_stay_unless_told(spark):
    from pyspark.sql import functions as F

    lines = [TITLE, [(40, "Trans Date"), (110, "Post Date"), (200, "Details"), (525, "Amount")], [(40, "Payments and Credits")], [(40, "Jan 2"), (110, "01/03/2026"), (200, "THANK YOU"), (520, "-$80.00")], [(40, "Purchases")], [(40, "Jan 3"), (110, "01/05/2026"), (200, "SHOP 1"), (525, "$12.50")]]
    (layout,), rows, _ = _read(spark, _page(lines))
    assert layout.roles == ["date", "date2", "description", "amount"] and layout.date_role == "date2"
    assert [(r.date_cell, r.amount_cell, r.flipped) for r in rows] == [("2026-01-03", "-$80.00", False), ("2026-01-05", "$12.50", False)]
    _, forced, _ = _read(spark, _page(lines), section_signs=F.lit(True))
    assert [r.amount_cell for r in forced] == ["80.00", "$12.50"]
    _, stopped, _ = _read(spark, _page(lines), stop_anchor=F.lit("purchases"))
    assert len(stopped) == 1
    _, none, (fit,) = _read(spark, _page(lines), start_anchor=F.lit("Another table"), fits=True)
    assert none == [] and fit.suspect
    _, other_pages, _ = _read(spark, _page(lines), pages=F.array(F.lit(2)))
    assert other_pages == []


def test_two_money_columns_by_heading_and_reversals(spark):
    lines = [TITLE, [(40, "Date"), (150, "Payee"), (380, "Deposits"), (520, "Charges")], [(40, "Jan 2"), (150, "IN"), (390, "$20.00")], [(40, "Jan 3"), (150, "BACK"), (390, "-$20.00")], [(40, "Jan 4"), (150, "OUT"), (520, "1,000.00")]]
    (layout,), rows, _ = _read(spark, _page(lines))
    assert layout.roles == ["date", "description", "credit", "debit"] and layout.amount_mode == "debitcredit"
    assert [(r.description_cell, r.debit_cell, r.credit_cell, r.amount_cell) for r in rows] == [("IN", "", "20.00", None), ("BACK", "20.00", "", None), ("OUT", "1000.00", "", None)]


@pytest.mark.parametrize(
    "lines",
    [
        [TITLE, [(40, "Jan 2"), (150, "no heading"), (520, "1.00")]],
        [TITLE, [(40, "Date"), (150, "Payee"), (520, "Amount")], [(150, "no rows")]],
        [TITLE, [(40, "Payment Due Date"), (200, "Jul 18, 2026")], [(40, "Jan 2"), (150, "x"), (520, "1.00")]],
        [[(40, "Date"), (62, "Amount")], [(40, "Jan 2"), (68, "1.00")]],
    ],
)
def test_ambiguous_files_are_refused(spark, lines):
    df = spark.createDataFrame(_page(lines), "file int, page int, x double, y double, w double, h double, text string, width double")
    assert statement_tables.layouts(statement_runs.lined(df, KEYS), KEYS).isEmpty()
