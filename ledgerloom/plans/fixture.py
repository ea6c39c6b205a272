"""Ledger tables derived from the star-schema tables, as SQL that Spark and DuckDB read alike.

Names in braces are tables.  Every fortieth order has a second leg: a transfer of the same sum on another account of its household.  Households are the customers' nations, accounts the customers, transactions the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ACCOUNTS = """SELECT CAST(c_nationkey AS INT) AS household_id, c_custkey AS account_id, c_name AS name, c_mktsegment AS institution,
 CASE WHEN c_custkey % 10 = 0 THEN 'loan' WHEN c_custkey % 10 IN (1, 2, 3) THEN 'credit' ELSE 'depository' END AS type,
 CASE WHEN c_custkey % 20 = 0 THEN 'mortgage' WHEN c_custkey % 10 = 0 THEN 'auto loan' WHEN c_custkey % 10 IN (1, 2, 3) THEN 'credit card' WHEN c_custkey % 2 = 0 THEN 'savings' ELSE 'checking' END AS subtype,
 c_custkey % 17 = 0 AS hidden, CAST(abs(c_acctbal) AS DECIMAL(14,2)) AS current_balance, CASE WHEN c_custkey % 3 <> 0 THEN CAST(4 + c_custkey % 19 AS DOUBLE) END AS apr, CAST(5 AS DOUBLE) AS interest_rate,
 CAST(25 + c_custkey % 90 AS DECIMAL(14,2)) AS minimum_payment, CASE WHEN c_custkey % 10 IN (1, 2, 3) THEN CAST(8000 AS DECIMAL(14,2)) END AS credit_limit,
 CAST(9500 AS DECIMAL(14,2)) AS original_balance, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 5 END AS entity_id, CAST(DATE '1995-01-01' + CAST(c_custkey % 400 AS INT) AS DATE) AS created_on FROM {customer}"""

TRANSACTIONS = """SELECT CAST(c_nationkey AS INT) AS household_id, o_orderkey AS id, 'sfin:' || CAST(o_orderkey AS STRING) AS external_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date,
 CAST((CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END) * floor(o_totalprice / 1000) AS DECIMAL(14,2)) AS amount,
 CASE WHEN o_orderkey % 6 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 6 = 1 THEN '****' ELSE 'Vendor #' || CAST(o_orderkey % 40 AS STRING) || ' Store' END AS merchant_name,
 CASE o_orderkey % 12 WHEN 0 THEN 'PAYMENT RECEIVED THANK YOU' WHEN 1 THEN 'CHASE CARD AUTOPAY 0042' WHEN 2 THEN 'ONLINE BANKING TRANSFER TO SAV 77' WHEN 3 THEN 'TRADER JOE''S #553'
  WHEN 4 THEN 'AMAZON.COM*MK1AB23' ELSE 'VENDOR ' || CAST(o_orderkey % 50 AS STRING) || ' MARKET' END AS description,
 CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE substr(o_orderpriority, 3) END AS mapped_category, CASE WHEN o_orderkey % 19 = 0 THEN 'Groceries' WHEN o_orderkey % 101 = 0 THEN 'Transfers and card payments' END AS user_category,
 CASE WHEN o_orderkey % 41 = 0 THEN 'My note ' || CAST(o_orderkey AS STRING) END AS user_description,
 CASE WHEN o_orderkey % 23 = 0 THEN 'spending' WHEN o_orderkey % 29 = 0 THEN 'inflow' WHEN o_orderkey % 31 = 0 THEN 'transfer' WHEN o_orderkey % 211 = 0 THEN 'junk' END AS user_type,
 o_orderkey % 37 = 0 AS excluded, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 3 + 1 END AS entity_id, o_orderkey % 53 = 0 AS is_capital, CASE WHEN o_orderkey % 53 = 0 THEN CAST(o_orderdate AS DATE) END AS placed_in_service,
 CASE WHEN o_orderkey % 53 = 0 THEN CAST(27 AS INT) END AS useful_life_years, CASE o_orderkey % 3 WHEN 0 THEN 'simplefin' WHEN 1 THEN 'csv' END AS source FROM {orders} JOIN {customer} ON o_custkey = c_custkey
 UNION ALL SELECT CAST(c_nationkey AS INT), o_orderkey + 5000000000, 'sfin:' || CAST(o_orderkey + 5000000000 AS STRING), hub, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT) AS DATE),
 CAST((CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE -1 END) * floor(o_totalprice / 1000) AS DECIMAL(14,2)), CAST(NULL AS STRING), 'ONLINE BANKING TRANSFER FROM CHK ' || CAST(o_orderkey % 100 AS STRING), 'Transfers and card payments', CAST(NULL AS STRING),
 CAST(NULL AS STRING), CAST(NULL AS STRING), false, CAST(NULL AS BIGINT), false, CAST(NULL AS DATE), CAST(NULL AS INT), 'simplefin'
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN (SELECT c_nationkey AS nation, min(c_custkey) AS hub FROM {customer} WHERE c_custkey % 10 > 3 AND c_custkey % 17 <> 0 GROUP BY c_nationkey) AS h ON nation = c_nationkey WHERE o_orderkey % 40 = 3 AND o_custkey <> hub"""

#: Sparse balances: the day's largest value of a user's events, on the account of the same number.
SNAPSHOTS = """SELECT user_id + 1 AS account_id, CAST(ts AS DATE) AS captured_on, CAST(max(value) AS DECIMAL(14,2)) AS balance FROM {events} GROUP BY 1, 2"""

#: Monthly assignments by flag and status of line items, in households of the suppliers.
ASSIGNMENTS = """SELECT CAST(l_suppkey AS INT) AS household_id, l_returnflag || l_linestatus AS category, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(floor(l_quantity)) AS DECIMAL(12,2)) AS assigned,
 CAST(CASE WHEN min(l_linenumber) = 1 AND count(*) % 5 = 0 THEN 900 END AS DECIMAL(12,2)) AS target_override FROM {lineitem} WHERE l_linenumber < 4 GROUP BY 1, 2, 3"""
ENVELOPE_SPENDING = """SELECT CAST(l_suppkey AS INT) AS household_id, l_returnflag || l_linestatus AS category, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(floor(l_quantity)) AS DECIMAL(14,2)) AS spent FROM {lineitem} WHERE l_linenumber >= 4 GROUP BY 1, 2, 3"""
SETTINGS = """SELECT DISTINCT CAST(l_suppkey AS INT) AS household_id, l_returnflag || l_linestatus AS category, CAST(CASE WHEN l_suppkey % 10 <> 4 THEN 1200 END AS DECIMAL(12,2)) AS target,
 CASE WHEN l_suppkey % 2 = 0 THEN 'monthly' ELSE 'by_date' END AS target_kind, CAST('1996-12-15' AS DATE) AS target_date, l_returnflag <> 'N' AS rollover FROM {lineitem} WHERE l_returnflag <> 'A' OR l_suppkey % 10 > 2"""

#: Monthly charges on a fixed day of groups of ten customers, with a last one 6 % dearer for every third merchant.
SERIES = """SELECT CAST(o_custkey % 15 + 15 * floor(o_custkey / 600) AS INT) AS household_id, max(o_orderkey) AS id, o_custkey % 60 AS account_id, 'Stream ' || chr(CAST(65 + o_custkey % 15 AS INT)) || chr(CAST(65 + (o_custkey / 1 % 60 - o_custkey % 15) / 15 AS INT)) || ' #' || CAST(max(o_orderkey) % 100 AS STRING) AS merchant_name, CAST('' AS STRING) AS description,
 CAST(date_trunc('month', o_orderdate) AS DATE) AS transaction_date, CAST(10 + o_custkey % 60 + CASE WHEN o_custkey % 60 % 3 = 0 AND max(o_orderdate) >= TIMESTAMP '1998-06-01' THEN 3 ELSE 0 END AS DECIMAL(14,2)) AS amount, 'Media' AS category
 FROM {orders} GROUP BY o_custkey % 15, floor(o_custkey / 600), o_custkey % 60, CAST(date_trunc('month', o_orderdate) AS DATE), 'Stream ' || chr(CAST(65 + o_custkey % 15 AS INT)) || chr(CAST(65 + (o_custkey / 1 % 60 - o_custkey % 15) / 15 AS INT)), date_trunc('month', o_orderdate)"""

MILEAGE = """SELECT CAST(l_suppkey AS INT) AS household_id, CAST(l_shipdate + INTERVAL 28 YEAR AS DATE) AS on_date, CAST(l_quantity AS DECIMAL(7,1)) AS miles FROM {lineitem}"""
EXPECTED = """SELECT CAST(c_nationkey AS INT) AS household_id, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'K' || CAST(o_custkey % 9 AS STRING) END AS recurring_key, CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE o_custkey END AS account_id,
 'VENDOR ' || CAST(o_orderkey % 50 AS STRING) || ' MARKET' AS description, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE substr(o_orderpriority, 3) END AS category, CAST(floor(o_totalprice / 1000) + 1 AS DECIMAL(14,2)) AS amount, CAST(o_orderdate + INTERVAL 2 DAY AS DATE) AS due_date,
 CASE o_orderkey % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'annual' ELSE 'once' END AS cadence, CASE o_orderkey % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'dismissed' ELSE 'pending' END AS status FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
RULES = """SELECT CAST(n_nationkey AS INT) AS household_id, k AS merchant_key, c AS category, CAST(a AS DECIMAL(14,2)) AS amount FROM {nation} JOIN (VALUES ('VENDOR', 'Shopping', NULL), ('VENDOR MARKET', 'Groceries', NULL), ('VENDOR', 'Subscription', 120),
 ('TRADER JOE S', 'Food', NULL), ('AMAZON', 'Online', NULL), ('AMAZON COM', 'Books', NULL), ('PAYMENT', 'Odd', NULL)) AS r(k, c, a) ON n_nationkey >= 0"""
REGISTRY = """SELECT CAST(n_nationkey AS INT) AS household_id, p AS position, n AS name, q AS parent FROM {nation} JOIN (VALUES (1, 'URGENT', 'Work'), (2, 'HIGH', 'Work'), (3, 'Work', NULL), (4, 'MEDIUM', 'Nowhere'), (5, 'Groceries', 'HIGH'), (6, ' LOW ', 'LOW'), (7, 'Uncategorized', 'Work'), (8, 'HIGH', 'LOW')) AS r(p, n, q) ON n_nationkey >= 0"""
#: Statement cells made of the orders: money as text, dates in three styles, some that can't be read.
CELLS = """SELECT CAST(c_nationkey AS INT) AS household_id, o_custkey AS account_id, o_orderkey AS row, CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 0 THEN strftime_mdy WHEN o_orderkey % 3 = 1 THEN iso ELSE ' ' || iso || ' ' END AS date_cell,
 CASE WHEN o_orderkey % 61 = 0 THEN '  ' ELSE 'Shop  ' || CAST(o_orderkey % 30 AS STRING) END AS description_cell,
 CASE WHEN o_orderkey % 70 = 0 THEN 'abc' WHEN o_orderkey % 71 = 0 THEN '0.00' WHEN o_orderkey % 5 = 0 THEN '(' || m || ')' WHEN o_orderkey % 5 = 1 THEN '$' || m ELSE '-' || m END AS amount_cell
 FROM (SELECT o_orderkey, o_custkey, c_nationkey, CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS STRING) || '.5' AS m, CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso,
  CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) AS strftime_mdy FROM {orders} JOIN {customer} ON o_custkey = c_custkey) AS t"""

ALL = {
    "accounts": ACCOUNTS, "transactions": TRANSACTIONS, "snapshots": SNAPSHOTS, "assignments": ASSIGNMENTS, "envelope_spending": ENVELOPE_SPENDING, "settings": SETTINGS, "series": SERIES, "mileage": MILEAGE,
    "expected": EXPECTED, "rules": RULES, "registry": REGISTRY, "cells": CELLS,
}
_SOURCES = ("customer", "orders", "lineitem", "events", "nation")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables in Spark."""
    text = ALL[name]
    used = [t for t in _SOURCES if f"{{{t}}}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def ctes(*names: str) -> str:
    """The derived tables as common table expressions for DuckDB."""
    out = []
    for name in names:
        text = ALL[name]
        for t in _SOURCES:
            text = text.replace(f"{{{t}}}", t)
        out.append(f"{name} AS ({text})")
    return ", ".join(out)
