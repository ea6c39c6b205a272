"""Queries against their SQL where many rows are alike: transfers that several rows can pair with, and statements of more rows than a layout's sample."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest

from ledgerloom.operators import recurring
from ledgerloom.plans import registry

from .test_oracles import _plain

D = datetime.date

#: Households 0 to 2; accounts of all kinds, of which none is hidden or a loan.
CUSTOMERS = "SELECT k AS c_custkey, 'Account ' || k AS c_name, CAST(k % 3 AS INT) AS c_nationkey, 5.0 AS c_acctbal, 'BANK' AS c_mktsegment FROM range(1, 200) r(k) WHERE k % 10 <> 0 AND k % 17 <> 0"
#: The same few sums on near days, in and out; key * 7 % 3 makes runs of one direction.
ORDERS = """SELECT k AS o_orderkey, CAST(a AS BIGINT) AS o_custkey, 'O' AS o_orderstatus, 1000.0 * (1 + k % 5) + 1 AS o_totalprice, TIMESTAMP '{start}' + to_days(CAST(k // {pace} AS INT)) AS o_orderdate, '1-URGENT' AS o_orderpriority
 FROM (SELECT CASE WHEN r // {run} % 2 = 0 THEN r * 3 ELSE r * 3 + 1 + r % 2 END AS k, r FROM range(1, {n}) q(r)) JOIN (SELECT c_custkey AS a, row_number() OVER (ORDER BY c_custkey) - 1 AS slot, count(*) OVER () AS size FROM customer) ON slot = k * 7 % size"""


@pytest.mark.parametrize(
    ("name", "shape"),
    [(n, {"start": "1995-06-01", "pace": 60, "run": 5, "n": 500}) for n in ("D04_internal_transfers", "E04_spending_to_date", "E06_envelope_spending", "E17_teach_queue", "E18_categorized_share", "E19_D14_category_rollup")]
    + [(n, {"start": "1996-06-01", "pace": 60, "run": 5, "n": 500}) for n in ("E11_schedule_lines", "E11_schedule_summary", "E11_unmapped", "E14_deductions", "B13_schedule_csv")]
    + [(n, {"start": "1996-06-01", "pace": 150, "run": 400, "n": 1200}) for n in ("A24_layouts", "A25_table_rows", "A25_J01_printed_import")],
)
def test_query_equals_its_sql_where_many_rows_are_alike(spark, tmp_path, name, shape):
    con = duckdb.connect()
    con.sql(f"CREATE TABLE customer AS {CUSTOMERS}")
    con.sql(f"CREATE TABLE orders AS {ORDERS.format(**shape)}")
    con.sql("CREATE TABLE nation AS SELECT CAST(k AS INT) AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey FROM range(3) r(k)")
    con.sql("CREATE TABLE events AS SELECT 0::BIGINT AS event_id, TIMESTAMP '1995-06-01' AS ts, 0::BIGINT AS user_id, 'x' AS event_type, 1.0 AS value, '' AS props")
    for t in ("customer", "orders", "nation", "events"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    place = [want.columns.index(c) for c in columns]
    assert got and got == sorted(tuple(_plain(r[k]) for k in place) for r in want.fetchall())


def test_candidates_meet_by_account_or_amount_and_none_is_lost(spark):
    rnd = random.Random(3)
    day = lambda: D.fromordinal(D(2026, 1, 1).toordinal() + rnd.randrange(90))
    worth = lambda: rnd.choice([80.0, 99.99, 100.0, 100.01, 120.0, 125.0, 0.01, -100.0, 1e6])
    said = lambda: rnd.choice(["STREAM FLIX", "STREAM FLIX 12", "FLIX", "42", ""])
    bills = [(1, k, rnd.choice([None, 1, 2]), worth(), day(), rnd.choice(["weekly", "monthly", "annual", "once"]), said()) for k in range(150)]
    paid = [(1, k, rnd.choice([1, 2, 3]), worth(), day(), said(), None) for k in range(150)]
    expected = spark.createDataFrame(bills, "household_id int, id int, account_id int, amount double, due_date date, cadence string, description string")
    rows = spark.createDataFrame(paid, "household_id int, id int, account_id int, amount double, date date, description string, merchant_name string")
    words = lambda s: {w for w in s.split() if len(w) >= 3 and not w.isdigit()}
    key = lambda s: " ".join(w for w in s.split() if not w.isdigit())
    alike = lambda a, b: key(a) == key(b) or (words(a) and words(b) and len(words(a) & words(b)) >= 0.4 * len(words(a) | words(b)))
    want = {
        (e[1], t[1]) for e in bills for t in paid
        if e[3] > 0 and e[2] in (None, t[2]) and abs(t[3] - e[3]) <= 0.2 * e[3] and abs((t[4] - e[4]).days) <= recurring.WINDOW_DAYS[e[5]] and alike(e[6], t[5])
    }
    found = recurring.candidates(expected, rows)
    got = [(r.expected_id, r.tx_id) for r in found.collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == want
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and "e_account" in joins[0] and "step" in joins[1]
