"""Golden values and properties of the ledger operators."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money, text
from ledgerloom.operators import balances, envelopes, importing, matching, recurring, rules, tax, verdicts

D = dt.date


def test_matching_is_maximum_on_random_instances():
    random.seed(7)
    for _ in range(200):
        outs = sorted((random.randrange(13), random.choice("abcd"), f"o{k}") for k in range(random.randrange(6)))
        ins = sorted((random.randrange(13), random.choice("abcd"), f"i{k}") for k in range(random.randrange(6)))
        able = [(i, j) for i, o in enumerate(outs) for j, n in enumerate(ins) if abs(o[0] - n[0]) <= 4 and o[1] != n[1]]
        most = next(n for n in range(min(len(outs), len(ins)), -1, -1) if any(len({i for i, _ in c}) == n == len({j for _, j in c}) for c in itertools.combinations(able, n)))
        pairs = matching.match(outs, ins)
        assert len(pairs) == most and set(pairs) <= set(able)


def test_long_chain_needs_no_recursion():
    n = 3000
    outs = [(2 * k, "a", f"{k:05d}") for k in range(n)]
    ins = [(2 * k + 1, "b", f"{k:05d}") for k in range(n)]
    assert len(matching.match(outs, ins)) == n


def _transactions(spark, rows):
    schema = "household_id int, id long, account_id long, date date, amount decimal(14,2), account_type string, excluded boolean, user_type string, description string, merchant_name string, mapped_category string, user_category string, user_description string"
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], schema)


def _row(account, day, amount, kind="depository", excluded=False, user_type=None, description="", merchant="", mapped=None, user=None):
    from decimal import Decimal

    return (account, D(2026, 7, day), Decimal(str(amount)), kind, excluded, user_type, description, merchant, mapped, user, None)


def test_pairs_that_straddle_are_all_marked(spark):
    rows = [_row(1, 4, 200), _row(1, 9, 200), _row(2, 1, -200), _row(2, 6, -200)]
    assert {r.id for r in matching.internal_ids(_transactions(spark, rows)).collect()} == {0, 1, 2, 3}


def test_loans_same_account_window_and_overrides_never_pair(spark):
    rows = [
        _row(1, 1, 50), _row(9, 1, -50, "loan"), _row(1, 2, 60), _row(1, 2, -60), _row(1, 1, 70), _row(2, 9, -70), _row(1, 3, 80, user_type="spending"), _row(2, 3, -80), _row(1, 3, 90, excluded=True), _row(2, 3, -90),
    ]
    assert matching.internal_ids(_transactions(spark, rows)).count() == 0


def test_verdicts(spark):
    cases = [
        (_row(1, 1, 20), True, False), (_row(1, 1, -20), False, True), (_row(3, 1, -20, "credit"), True, False), (_row(3, 1, -20, "credit", description="PAYMENT THANK YOU"), False, False), (_row(1, 1, 20, description="AMEX EPAYMENT"), False, False),
        (_row(3, 1, 20, "credit", description="AMEX EPAYMENT"), True, False), (_row(9, 1, 20, "loan"), False, False), (_row(1, 1, 20, excluded=True), False, False), (_row(1, 1, 20, user_type="junk"), False, False), (_row(1, 1, 20, user_type="inflow"), False, True),
        (_row(1, 1, 0), False, False), (_row(1, 1, 20, user="Transfers and card payments"), False, False),
    ]
    got = verdicts.with_verdicts(_transactions(spark, [c[0] for c in cases])).orderBy("id").collect()
    assert [(r.counted, r.income) for r in got] == [c[1:] for c in cases]
    names = _transactions(spark, [_row(1, 1, 1, merchant="****", description="Shop"), _row(1, 1, 1, merchant="", description="x.x")])
    assert [r[0] for r in names.select(verdicts.display_name()).collect()] == ["Shop", "Card transaction"]


def test_text_and_money_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.normal_merchant(F.lit("TRADER JOE'S #553"))) == "TRADER JOE S"
    assert get(text.normal_merchant(F.lit("AMAZON.COM*MK1AB23"))) == "AMAZON COM MK AB"
    assert get(text.normal_merchant(F.lit("12345 #77"))) == ""
    assert get(text.merchant_key(F.lit("Sq *Coffee 123 bar"))) == "SQ COFFEE BAR"
    for raw, value in (("$1,234.50", 1234.5), ("(45.00)", -45), ("-(3)", None), ("", 0), ("abc", None), ("-5", -5), ("(-5)", 5), ("+7", 7)):
        got = get(money.parse_money(F.lit(raw)))
        assert (got if got is None else float(got)) == value, raw
    for raw, value in (("2026-02-28", D(2026, 2, 28)), ("2/3/26", D(2026, 2, 3)), ("2.3.1999", D(1999, 2, 3)), ("2-30-2026", None), ("x", None), ("1/2/70", D(1970, 1, 2))):
        assert get(money.parse_date(F.lit(raw))) == value, raw
    assert get(money.cents(F.lit(-0.125))) == -0.12 and get(money.cents(F.lit(0.125))) == 0.13
    assert get(text.csv_cell(F.lit('=a"b'))) == "\"'=a\"\"b\""
    assert get(importing.description_similarity(F.lit("ACME BISTRO DOWNTOWN"), F.lit("ACME BISTRO"))) == pytest.approx(2 / 3)
    assert get(importing.fnv1a64(F.lit(""))) == "cbf29ce484222325" and get(importing.fnv1a64(F.lit("a"))) == "af63dc4c8601ec8c"


def _walk(spark, assigned, spent, settings=()):
    a = spark.createDataFrame([(1, c, D.fromisoformat(m), v, None) for c, m, v in assigned], "household_id int, category string, month date, assigned double, target_override double")
    s = spark.createDataFrame([(1, c, D.fromisoformat(m), v) for c, m, v in spent], "household_id int, category string, month date, spent double")
    t = spark.createDataFrame([(1, *r) for r in settings], "household_id int, category string, target double, target_kind string, target_date date, rollover boolean")
    return a, s, t


def test_envelopes_roll_over(spark):
    rows = envelopes.walk(*_walk(spark, [("F", "2026-01-01", 500.0), ("F", "2026-02-01", 500.0)], [("F", "2026-01-01", 400.0), ("F", "2026-02-01", 450.0)]), "2026-02-01").collect()
    assert [(r.rolled_over, r.available) for r in rows] == [(100.0, 150.0)]
    never = envelopes.walk(*_walk(spark, [], [("P", f"2026-{m:02d}-01", 200.0) for m in range(1, 13)]), "2026-12-01").collect()
    assert [(r.rolled_over, r.available) for r in never] == [(0.0, -200.0)]
    off = envelopes.walk(*_walk(spark, [("F", "2026-01-01", 500.0)], [], [("F", None, None, None, False)]), "2026-02-01").collect()
    assert off[0].available == 0.0


def test_by_date_target(spark):
    rows = envelopes.walk(*_walk(spark, [], [], [("T", 2400.0, "by_date", D(2027, 6, 1), True)]), "2026-07-01")
    assert rows.select(envelopes.target_need("2026-07-01")).first()[0] == 200.0


def test_recurring_monthly(spark):
    rows = spark.createDataFrame([(1, k, 5, "StreamFlix.com", "", D.fromisoformat(d), 15.99, "Fun") for k, d in enumerate(["2026-01-05", "2026-02-03", "2026-03-06", "2026-04-04"])], "household_id int, id int, account_id int, merchant_name string, description string, transaction_date date, amount double, category string")
    got = recurring.detect(rows).collect()
    assert [(r.key, r["count"], r.cadence, r.next_date, r.avg_gap_days) for r in got] == [("STREAMFLIX COM", 4, "monthly", D(2026, 5, 3), 30)]
    assert recurring.detect(rows, "2027-01-01").count() == 0


def test_due_dates_clamp_and_stay_clamped(spark):
    e = spark.createDataFrame([(1, 1, D(2026, 1, 31), "monthly"), (1, 2, D(2028, 2, 29), "annual"), (1, 3, D(2026, 1, 1), "once")], "household_id int, id int, due_date date, cadence string")
    assert [r[0] for r in e.orderBy("id").select(recurring.roll_forward(F.col("due_date"), F.col("cadence"))).collect()] == [D(2026, 2, 28), D(2029, 2, 28), None]
    got = recurring.project(e, "2026-04-01").where("id = 1").orderBy("cycle").collect()
    assert [r.due_date for r in got] == [D(2026, 2, 28), D(2026, 3, 28), D(2026, 4, 28)]


def test_net_worth_carries_forward(spark):
    accounts = spark.createDataFrame([(1, 1, "depository"), (1, 2, "credit")], "household_id int, account_id int, type string")
    snaps = spark.createDataFrame([(1, D(2026, 8, 1), 1000.0), (2, D(2026, 8, 1), 400.0), (2, D(2026, 8, 2), 300.0), (1, D(2026, 8, 4), 1100.0)], "account_id int, captured_on date, balance double")
    assert [r.total for r in balances.net_worth(snaps, accounts).orderBy("date").collect()] == [600.0, 700.0, 800.0]
    assert [r.total for r in balances.net_worth(snaps, accounts, since="2026-08-03").orderBy("date").collect()] == [700.0, 800.0]


def test_debt_plans(spark):
    got = spark.range(1).select(balances.amortize(F.lit(1000.0), F.lit(12.0), F.lit(100.0)).alias("a")).first().a
    assert (got.months, round(got.interest, 2), got.stalled) == (11, 58.98, False)
    debts = [{"account_id": "A", "balance": 100.0, "rate": 0.0, "minimum": 50.0}, {"account_id": "B", "balance": 300.0, "rate": 0.0, "minimum": 50.0}]
    months, _, stalled, each = balances.plan(debts, 0.0)
    assert (months, stalled, each["A"][0], each["B"][0]) == (4, False, 2, 4)
    assert balances.plan([{"account_id": "A", "balance": 1000.0, "rate": 0.02, "minimum": 10.0}], 0.0)[2]
    quick, slow = (sorted(debts, key=lambda d: d["rate"], reverse=r) for r in (True, False))
    assert balances.plan(quick, 50.0)[1] <= balances.plan(slow, 50.0)[1]


def test_mileage_and_lines(spark):
    log = spark.createDataFrame([(1, D(2026, 3, 1), 100.0), (1, D(2026, 8, 1), 100.0), (1, D(2023, 5, 1), 40.0)], "household_id int, on_date date, miles double")
    got = tax.mileage_total(log).first()
    assert (got.miles, got.amount, got.unrated_miles) == (200.0, 148.5, 40.0)
    rows = spark.createDataFrame([(1, 1, "U", 100.0, False), (1, 1, "R", 300.0, False), (1, 1, "X", -3600.0, False), (1, 1, "Dining out", 75.0, False), (1, 1, "R", 9000.0, True)], "household_id int, entity_id int, category string, amount double, is_capital boolean").withColumn("excluded", F.lit(False))
    mapping = spark.createDataFrame([("U", "17"), ("R", "14")], "category string, target string")
    lines = {r.line: r.total for r in tax.schedule_lines(rows, mapping).collect()}
    assert len(lines) == 14 and lines[17] == 100.0 and lines[14] == 300.0
    s = tax.schedule_summary(rows, mapping).first()
    assert (s.rents, s.unmapped, s.capital, s.net) == (3600.0, 75.0, 9000.0, 3200.0)


def test_reconcile(spark):
    schema = "household_id int, account_id int, id string, date date, amount double, description string"
    a = spark.createDataFrame([(1, 1, "c1", D(2026, 1, 1), 52.75, "ACME BISTRO DOWNTOWN"), (1, 1, "c2", D(2026, 1, 9), 200.0, "ZED"), (1, 1, "c3", D(2026, 2, 1), 10.0, "K")], schema)
    b = spark.createDataFrame([(1, 1, "p1", D(2026, 1, 1), 45.0, "ACME BISTRO"), (1, 1, "p2", D(2026, 1, 9), 45.0, "ZED"), (1, 1, "p3", D(2026, 2, 3), 10.0, "other")], schema)
    got = {(r.statement_id, r.feed_id, r.outcome, r.difference) for r in importing.reconcile(a, b).collect()}
    assert got == {("c1", "p1", "mismatch", 7.75), ("c2", None, "statement_only", None), (None, "p2", "feed_only", None), ("c3", "p3", "matched", 0.0)}


def _bounded(monkeypatch, module, most):
    """Let groups of more than so many rows fail."""
    apply = module.apply_in_groups

    def bounded(rows, keys, solve, schema):
        def checked(group):
            assert len(group) <= most, len(group)
            return solve(group)

        return apply(rows, keys, checked, schema)

    monkeypatch.setattr(module, "apply_in_groups", bounded)


def test_reconcile_of_a_long_ledger_in_small_groups(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["ALPHA", "BISTRO", "CAFE", "DOWNTOWN", "ENERGY"]
    start = D(2025, 1, 1).toordinal()

    def side(name):
        return [(1, k % 2, f"{name}{k}", D.fromordinal(start + 12 * rnd.randrange(40) + rnd.randrange(7)), rnd.choice([5.0, 5.4, 20.0, 21.0, -3.0]), " ".join(rnd.sample(words, 2))) for k in range(300)]

    left, right = side("s"), side("f")
    want = set()
    for account in (0, 1):
        key = lambda r: (r[3].toordinal(), r[5], r[4], r[2])
        a, b = (sorted((r for r in part if r[1] == account), key=key) for part in (left, right))
        used = set()
        for size in {r[4] for r in a}:
            x, y = ([r for r in part if r[4] == size] for part in (a, b))
            for i, j in matching.match([(r[3].toordinal(), 0, k) for k, r in enumerate(x)], [(r[3].toordinal(), 1, k) for k, r in enumerate(y)], 4):
                want.add((x[i][2], y[j][2], "matched"))
                used |= {x[i][2], y[j][2]}
        spare = [r for r in b if r[2] not in used]
        for x in (r for r in a if r[2] not in used):
            best, found = 0.0, None
            for y in spare:
                gap, one, two = abs(x[4] - y[4]), set(x[5].lower().split()), set(y[5].lower().split())
                alike = len(one & two) / len(one | two)
                if abs((x[3] - y[3]).days) <= 4 and (gap <= importing.CLOSE_ABSOLUTE or gap / max(abs(x[4]), abs(y[4])) <= importing.CLOSE_RATIO) and alike >= importing.LEAST_SIMILARITY and alike > best:
                    best, found = alike, y
            want.add((x[2], found[2], "mismatch") if found else (x[2], None, "statement_only"))
            spare = [y for y in spare if y is not found]
        want |= {(None, y[2], "feed_only") for y in spare}
    _bounded(monkeypatch, importing, 40)
    schema = "household_id int, account_id int, id string, date date, amount double, description string"
    got = importing.reconcile(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    assert len(got) == len(want) and {(r.statement_id, r.feed_id, r.outcome) for r in got} == want and {"matched", "mismatch"} <= {r.outcome for r in got}


@pytest.mark.parametrize("few", [0, 60])
def test_expected_match_of_a_large_household_in_rounds(spark, monkeypatch, few):
    rnd = random.Random(6)
    day = lambda: D.fromordinal(D(2026, 1, 1).toordinal() + rnd.randrange(60))
    expected = spark.createDataFrame([(1 + k // 50, k, None, 20.0, day(), "monthly", "STREAM FLIX", "pending") for k in range(60)], "household_id int, id int, account_id int, amount double, due_date date, cadence string, description string, status string")
    rows = spark.createDataFrame([(1 + k // 70, k, 7, 20.0, day(), "STREAM FLIX", None) for k in range(80)], "household_id int, id int, account_id int, amount double, date date, description string, merchant_name string")
    want, seen = set(), set()
    for p in sorted(recurring.candidates(expected, rows).collect(), key=lambda p: (p.dist, p.due_date, str(p.expected_id), p.tx_date, str(p.tx_id))):
        if not {("e", p.expected_id), ("t", p.tx_id)} & seen:
            seen |= {("e", p.expected_id), ("t", p.tx_id)}
            want.add((p.household_id, p.expected_id, p.tx_id))
    _bounded(monkeypatch, recurring, few)
    monkeypatch.setattr(recurring, "FEW_PAIRS", few)
    got = [tuple(r) for r in recurring.match(expected, rows).collect()]
    assert len(got) == len(want) > 20 and set(got) == want


def test_rules_prefer_amounts_then_length(spark):
    rows = spark.createDataFrame([(1, 1, "COSTCO GAS 123", 40.0), (1, 2, "COSTCO GAS 123", 41.0), (1, 3, "COSTCOX", 1.0), (1, 4, "ONLINE BANKING TRANSFER TO X", 5.0)], "household_id int, id int, description string, amount double")
    taught = spark.createDataFrame([(1, "COSTCO", "Warehouse", None), (1, "COSTCO GAS", "Fuel", None), (1, "COSTCO", "Special", 40.0)], "household_id int, merchant_key string, category string, amount double")
    got = {r.id: r.mapped_category for r in rules.classify(rows, taught).collect()}
    assert got == {1: "Special", 2: "Fuel", 3: "Uncategorized", 4: "Transfers and card payments"}


def test_upsert_keeps_columns_that_were_not_sent(spark):
    held = spark.createDataFrame([(1, "a", 5.0, "mine"), (2, "b", 6.0, None)], "id int, description string, amount double, user_category string")
    new = spark.createDataFrame([(1, "a2", 5.5), (3, "c", 7.0), (3, "d", 7.0)], "id int, description string, amount double")
    got = sorted(tuple(r) for r in importing.upsert(held, new, ["id"], ["description", "amount"]).collect())
    assert got == [(1, "a2", 5.5, "mine"), (2, "b", 6.0, None), (3, "c", 7.0, None)]


def test_feed(spark):
    import json

    from ledgerloom.sources import feed

    body = {"errors": [], "accounts": [{"id": "A", "name": "Visa Signature", "balance": "-12.50", "balance-date": 0, "org": {"domain": "Bank.Example", "name": "Bank"}, "transactions": [
        {"id": "t1", "posted": 1767225600, "amount": "-5.25", "description": "", "payee": "Shop"}, {"id": "t2", "posted": 0, "amount": "1", "description": "no date"}, {"id": "", "posted": 1767225600, "amount": "1"}]}]}
    feeds = feed.parsed(spark.createDataFrame([(1, json.dumps(body)), (2, "not json")], "household_id int, json string"))
    a = feed.feed_accounts(feeds).collect()
    assert [(r.type, float(r.balance), r.balance_on, r.org_key) for r in a] == [("credit", 12.5, None, "bank.example")]
    assert [(r.external_id, float(r.amount), r.date, r.description) for r in feed.feed_transactions(feeds).collect()] == [("t1", 5.25, D(2026, 1, 1), "Shop")]
    said = ["Please reconnect", "The date range requested exceeds the limit and was capped", "requested date range exceeds recommended 60 days", "hello"]
    got = spark.createDataFrame([(s,) for s in said], "m string").select(feed.message_kind(F.col("m"))).collect()
    assert [r[0] for r in got] == ["error", "capped", "advisory", "error"]
