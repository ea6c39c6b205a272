"""Edits of budgets against the same edits one after the other, and small cases of lists of categories."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import balances, categories, envelopes, importing, manual, spending

D = datetime.date
MAY = D(2026, 5, 1)


def test_assignments_after_many_edits_as_one_by_one(spark):
    rnd = random.Random(3)
    held = {(1, f"c{k}"): (Decimal(rnd.choice([0, 5, 9])), rnd.choice([None, Decimal(0), Decimal(7)])) for k in range(60)}
    edits = [(1, f"c{rnd.randrange(90)}", MAY, n, rnd.choice(["assign", "override", "fund", "other"]), rnd.choice([None, "", " ", "0", "3", "-2", "1-2", "x", " 4.50 "])) for n in range(300)]
    want = dict(held)
    for h, c, _, _, action, value in edits:
        said, there = (value or "").strip(), want.get((h, c))
        a, t = there or (Decimal(0), None)
        try:
            number = Decimal(said) if said else None
        except ArithmeticError:
            continue
        if action == "override" and number is None or action == "assign" and not number:
            a, t = (a, None) if action == "override" else (Decimal(0), t)
            if there and (a or t is not None):
                want[h, c] = a, t
            else:
                want.pop((h, c), None)
        elif action == "override" and number >= 0:
            want[h, c] = a, number
        elif action in ("assign", "fund"):
            want[h, c] = number or Decimal(0), t
    table = spark.createDataFrame([(h, c, MAY, a, t) for (h, c), (a, t) in held.items()], "household_id int, category string, month date, assigned decimal(12,2), target_override decimal(12,2)")
    got = envelopes.assigned(table, spark.createDataFrame(edits, "household_id int, category string, month date, position int, action string, value string"))
    assert got.dtypes == table.dtypes
    assert {(r.household_id, r.category): (r.assigned, r.target_override) for r in got.collect()} == want


def test_plans_after_many_edits_as_one_by_one(spark):
    rnd = random.Random(4)
    held = {f"c{k}": (rnd.choice([None, Decimal(9)]), rnd.choice(["monthly", "by_date"]), rnd.choice([None, D(2026, 9, 1)]), rnd.choice([True, False])) for k in range(60)}
    edits = [(1, f"c{rnd.randrange(90)}", n, *rnd.choice([("rollover", "true"), ("rollover", "true"), ("rollover", "false"), ("rollover", None), ("monthly", None), ("by_date", "2026-12-01"), ("by_date", None)])) for n in range(300)]
    want = dict(held)
    for _, c, _, action, value in edits:
        there = want.get(c)
        target, kind, date, on = there or (None, "monthly", None, True)
        if action == "rollover" and value == "true":
            if there and target is None and date is None:
                del want[c]
            elif there:
                want[c] = target, kind, date, True
        elif action == "rollover":
            want[c] = target, kind, date, False
        else:
            want[c] = target, action, D.fromisoformat(value) if value else None, on
    table = spark.createDataFrame([(1, c, *v) for c, v in held.items()], "household_id int, category string, target decimal(12,2), target_kind string, target_date date, rollover boolean")
    got = envelopes.planned(table, spark.createDataFrame(edits, "household_id int, category string, position int, action string, value string"))
    assert {r.category: (r.target, r.target_kind, r.target_date, r.rollover) for r in got.collect()} == want


def test_no_edits_change_nothing(spark):
    table = spark.createDataFrame([(1, "a", MAY, Decimal(0), None)], "household_id int, category string, month date, assigned decimal(12,2), target_override decimal(12,2)")
    none = spark.createDataFrame([], "household_id int, category string, month date, position int, action string, value string")
    assert envelopes.assigned(table, none).collect() == table.collect()


def test_first_of_a_pull_and_cleared_fields(spark):
    held = spark.createDataFrame([(1, "old", 1)], "id int, text string, note int")
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, None, 5), (2, "z", 6)], "id int, text string, came int")
    assert {tuple(r) for r in importing.upsert(held, new, ["id"], ["text"], "came").collect()} == {(1, "b", 1), (2, None, None)}
    rows = spark.createDataFrame([(1, 1, "n", "s"), (1, 2, "n", "s")], "household_id int, id int, name string, sort string")
    edits = spark.createDataFrame([(1, 1, 0, "update", "x", None, None), (1, 1, 1, "update", None, None, ["sort"]), (1, 3, 0, "update", "y", None, None)], "household_id int, id int, position int, action string, name string, sort string, cleared array<string>")
    assert {tuple(r) for r in manual.edit_rows(rows, edits, "id", ["name", "sort"]).collect()} == {(1, 1, "n", None), (1, 2, "n", "s")}


def test_categories_stand_by_what_their_group_shows(spark):
    groups = spark.createDataFrame([(1, "Food", 10.0, 1), (1, "Gas", 8.0, 2), (1, "Bus", 7.0, 1), (1, "Odd", 10.0, 1)], "household_id int, category string, amount double, transaction_count long")
    tree = spark.createDataFrame([(1, "Gas", "Travel"), (1, "Bus", "Travel"), (1, "Travel", None), (1, "Odd", "Gone"), (1, "Idle", None)], "household_id int, name string, parent string")
    got = categories.shown(groups, tree.select("household_id", F.col("name").alias("category")), tree).orderBy("group_place", "place").collect()
    assert [(r.category, r.group_place, r.place, r.group_amount) for r in got] == [("Travel", 1, 0, 15.0), ("Bus", 1, 1, 15.0), ("Gas", 1, 2, 15.0), ("Food", 2, 0, 10.0), ("Odd", 3, 0, 10.0), ("Idle", 4, 0, 0.0)]


def test_payoff_takes_cards_and_what_was_chosen(spark):
    names = "household_id int, account_id int, name string, type string, subtype string, hidden boolean, current_balance decimal(14,2), apr double, interest_rate double, minimum_payment decimal(14,2), credit_limit decimal(14,2), original_balance decimal(14,2)"
    debt = lambda k, kind, owed, least: (1, k, "n", kind, "s", False, owed and Decimal(owed), None, 5.0, least and Decimal(least), None, None)
    accounts = spark.createDataFrame([debt(1, "credit", 5, 1), debt(2, "loan", 5, 1), debt(3, "loan", 5, None), debt(4, "credit", None, 1), debt(5, "credit", 5, 1)], names)
    chosen = spark.createDataFrame([(1, 3, True), (1, 5, False)], "household_id int, account_id int, included boolean")
    assert {(r.account_id, r.no_minimum) for r in balances.in_payoff(accounts, chosen).collect()} == {(1, False), (3, True)}


def test_typed_bounds_and_labels(spark):
    said = spark.createDataFrame([("$1,200.50", "2024-02-30"), ("-80", "0202-06-15"), ("abc", "2026-1-2"), ("", None), ("1e3", "2100-01-01"), ("NaN", "2101-01-01")], "a string, d string")
    got = said.select(importing.search_amount(F.col("a")), importing.search_date(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(1200.5, "2024-02-30"), (80.0, None), (None, None), (None, None), (1000.0, "2100-01-01"), (None, None)]
    sums = spark.createDataFrame([(1234.5, 2.0), (3.0, 0.0), (0.0, 4.0), (0.0, 0.0)], "i double, o double")
    assert [r[0] for r in sums.select(spending.other_label(F.col("i"), F.col("o"))).collect()] == ["$1,234.50 in / $2.00 out", "$3.00 in", "$4.00 out", "no amount"]
