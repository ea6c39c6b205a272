"""Expected bills of which many are alike: what is compared must not grow with their pairs."""

from __future__ import annotations

import datetime
import random

import pytest

from ledgerloom.operators import recurring
from ledgerloom.operators.nearest import nearest

D = datetime.date
BILL = "household_id int, id long, recurring_key string, due_date date, cadence string, status string"


def _joins(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]


def test_added_bills_meet_the_days_of_their_key_and_not_its_bills(spark):
    rnd = random.Random(8)
    day = lambda: None if rnd.random() < 0.05 else D.fromordinal(D(2026, 1, 1).toordinal() + rnd.randrange(60))
    bill = lambda k: (rnd.choice([1, 2]), k, rnd.choice([None, "a", "b", "c"]), day(), rnd.choice([None, "weekly", "monthly", "annual", "once"]))
    held = [(*bill(k), rnd.choice(["pending", "matched", "dismissed", None])) for k in range(240)]
    new = [(*bill(k + 1000), "pending") for k in range(200)]
    covers = lambda n, e: e[5] == "pending" and None not in (n[2], n[3], e[3]) and n[0] == e[0] and n[2] == e[2] and abs((n[3] - e[3]).days) <= recurring.DUPLICATE_DAYS[n[4] or "once"]
    want = {n for n in new if not any(covers(n, e) for e in held)} | set(held)
    expected, rows = spark.createDataFrame(held, BILL), spark.createDataFrame(new + new[:20], BILL)
    got = [tuple(r) for r in recurring.add(expected, rows).collect()]
    assert set(got) == want and 20 < len(want) - len(held) < 180
    found = recurring.duplicates(rows, expected)
    assert sorted(r.id for r in found.collect()) == sorted(n[1] for n in set(new) - want)
    # Rows of one key are joined by its day as well, and so each with one row at most.
    assert len(_joins(found)) == 1 and "(due_date#" in _joins(found)[0] and "datediff" not in _joins(found)[0]


def _greedy(pairs):
    """(order, bill, transaction) one to one."""
    seen, out = set(), set()
    for _, e, t in sorted(pairs, key=lambda p: p[0]):
        if not {("e", e), ("t", t)} & seen:
            seen |= {("e", e), ("t", t)}
            out.add((e, t))
    return out


@pytest.mark.parametrize("seed", range(120))
def test_the_walk_along_days_takes_what_all_pairs_in_order_give(seed):
    rnd = random.Random(seed)
    size, span, ids = rnd.choice([3, 12, 60]), rnd.choice([1, 9, 70, 2500]), rnd.choice([20, 10_000])
    sums = rnd.choice([[20.0], [80.0, 99.99, 100.0, 100.01, 120.0, 125.0], [0.1 * k for k in range(1, 60)]])
    says = rnd.choice([["GYM CLUB"], ["GYM CLUB", "GYM CLUB X1", "CLUB", "GYM POS", "", "ONE TWO THREE", "GYM HALL"]])
    key = lambda: None if ids == 20 and rnd.random() < 0.1 else rnd.randrange(ids)
    rows = [(1, rnd.randrange(span), key(), None, rnd.choice([None, None, "7", "8"]), rnd.choice(sums), rnd.choice([4, 7, 30]), rnd.choice(says)) for _ in range(size)]
    rows += [(1, rnd.randrange(span), None, key(), rnd.choice([None, "7", "8", "9"]), rnd.choice(sums), None, rnd.choice(says)) for _ in range(size + 5)]
    words = lambda s: {w for w in s.split() if len(w) >= 3 and w != "POS"}
    alike = lambda a, b: a == b or bool(words(a) and words(b)) and len(words(a) & words(b)) / len(words(a) | words(b)) >= 0.4
    pairs = [
        ((abs(t[1] - e[1]), e[1], str(e[2]), t[1], str(t[3])), e[2], t[3]) for e in rows[:size] for t in rows[size:]
        if abs(t[1] - e[1]) <= e[6] and (e[4] is None or e[4] == t[4]) and abs(t[5] - e[5]) <= 0.2 * e[5] and alike(e[7], t[7])
    ]
    whole = len({r[2:4] for r in rows}) < len(rows)
    got = [r[1:] for r in nearest(30, 0.2, rnd.choice([0, 50]))((*r, whole) for r in sorted(rows, key=lambda r: r[1]))]
    assert len(got) == len(set(got)) and set(got) == _greedy(pairs)


def test_the_walk_holds_no_day_that_is_past():
    taken = []

    def rows():
        for day in range(3000):
            taken.append(day)
            yield 1, day, day, None, None, 20.0, 30, "GYM CLUB", False
            yield 1, day, None, day, None, 20.0, None, "GYM CLUB" if day % 50 else "ELSE", False

    walk = nearest(30, 0.2, 50)(rows())
    behind = [len(taken) - max(found[1], found[2]) for found in walk]
    assert len(behind) == 3000 - 60 and max(behind) <= 32 + 30 * 30


@pytest.mark.parametrize(("few", "walked"), [(0, 0), (1000, 0), (1000, 1000)])
def test_expected_match_writes_no_pairs(spark, monkeypatch, few, walked):
    rnd = random.Random(9)
    day = lambda: D.fromordinal(D(2026, 1, 1).toordinal() + rnd.randrange(15))
    says = ["STREAM FLIX", "Stream Flix 12", "FLIX", "RENT", "stream club", "42", None]
    bills = [(1 + k % 2, k if k % 2 else k % 280, rnd.choice([None, None, 7, 8]), rnd.choice([18.0, 20.0, 30.0, -20.0]), None if k % 40 == 0 else day(), rnd.choice([None, "weekly", "annual"]), rnd.choice(says)) for k in range(300)]
    paid = [(1 + k % 2, k, rnd.choice([7, 8, 9]), rnd.choice([18.0, 20.0, 30.0]), day(), rnd.choice(says), rnd.choice([None, "", "STREAM FLIX"])) for k in range(250)]  # household 1 has ids twice
    expected = spark.createDataFrame(bills, "household_id int, id int, account_id int, amount double, due_date date, cadence string, description string")
    rows = spark.createDataFrame(paid, "household_id int, id long, account_id int, amount double, date date, description string, merchant_name string")
    pairs = recurring.candidates(expected, rows).collect()
    want = _greedy([((p.dist, p.due_date, str(p.expected_id), p.tx_date, str(p.tx_id)), (p.household_id, p.expected_id), (p.household_id, p.tx_id)) for p in pairs])
    write, written = recurring.held, []

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(recurring, "held", counted)
    monkeypatch.setattr(recurring, "FEW_PAIRS", few)
    monkeypatch.setattr(recurring, "FEW_ROWS", walked, raising=False)
    found = recurring.match(expected, rows)
    assert found.dtypes == [("household_id", "int"), ("expected_id", "int"), ("tx_id", "bigint")]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) > 100 and set(got) == {(e[0], e[1], t[1]) for e, t in want}
    assert len(pairs) > 3 * (len(bills) + len(paid)) and max(written) <= len(bills) + len(paid)
