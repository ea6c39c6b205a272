"""The whole report as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import report
from ..sources.ledger import Ledger
from . import fixture
from .oracles import _DISPLAY, _RECURRING, ctes, rows

TODAY, VIEW, SINCE = "1996-06-20", "1996-06-01", "1996-03-22"

_HUBS = "SELECT c_nationkey AS nation, min(c_custkey) AS hub FROM {customer} WHERE c_custkey % 10 > 3 AND c_custkey % 17 <> 0 GROUP BY c_nationkey"
#: Transactions to the day of the report, and monthly charges on one account of each household; some have become dearer.
fixture.ALL["reported"] = f"""SELECT * FROM ({fixture.TRANSACTIONS}) AS t WHERE date <= DATE '{TODAY}'
 UNION ALL SELECT household_id, id + 9000000000, CAST(NULL AS STRING), hub, transaction_date, CAST(amount + 0.37 + CASE WHEN transaction_date >= DATE '{VIEW}' AND CAST(amount AS INT) % 3 = 0 THEN 2 ELSE 0 END AS DECIMAL(14,2)), merchant_name, description, category,
 CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), false, CAST(NULL AS BIGINT), false, CAST(NULL AS DATE), CAST(NULL AS INT), 'simplefin'
 FROM ({fixture.SERIES}) AS s JOIN ({_HUBS}) AS hubs ON nation = household_id WHERE transaction_date <= DATE '{TODAY}'"""
fixture.ALL["plan_months"] = """SELECT CAST(c_nationkey AS INT) AS household_id, substr(o_orderpriority, 3) AS category, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(floor(o_totalprice / 1500)) AS DECIMAL(12,2)) AS assigned
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND c_nationkey % 5 <> 4 AND o_orderkey % 3 = 0 GROUP BY 1, 2, 3"""
fixture.ALL["plan_limits"] = """SELECT DISTINCT CAST(c_nationkey AS INT) AS household_id, substr(o_orderpriority, 3) AS category, CAST(CASE WHEN c_nationkey % 3 <> 0 THEN 512.5 END AS DECIMAL(12,2)) AS target,
 CASE WHEN c_nationkey % 2 = 0 THEN 'monthly' ELSE 'by_date' END AS target_kind, CAST('1996-12-15' AS DATE) AS target_date, c_nationkey % 4 <> 1 AS rollover FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_nationkey % 5 <> 4 AND o_orderkey % 7 = 0"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"accounts": "accounts", "transactions": "reported", "assignments": "plan_months", "envelope_settings": "plan_limits"}
    return report.context(Ledger({k: fixture.load(spark, sf_dir, v) for k, v in names.items()}), TODAY)


def queries() -> dict:
    return {"M18_A40_whole_report": lambda s, d: report.text(_context(s, d)), "M18_A40_report_lines": _context}


def _texts(section: int, texts: list[str], who: str) -> str:
    """A section's first lines for all households of a table."""
    values = ", ".join(f"({k - len(texts)}, {t})" for k, t in enumerate(texts))
    return f"SELECT household_id, {section} AS section, h.rank, h.line FROM {who} JOIN (VALUES {values}) h(rank, line) ON true"


def _said(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


def _usd(c: str) -> str:
    return f"'$' || CAST(CAST({c} AS DECIMAL(20,2)) AS VARCHAR)"


_SUMS = f"'assigned ' || {_usd('assigned')} || ', carried ' || {_usd('rolled_over')} || ', spent ' || {_usd('spent')} || ', available ' || {_usd('available')}"
_RANK = "row_number() OVER (PARTITION BY household_id ORDER BY {})"
_CHARGED = "SELECT household_id, id, account_id, coalesce(nullif(user_description, ''), merchant_name) AS merchant_name, description, date AS transaction_date, amount, shown AS category FROM v"
#: Recurring charges among the report's own rows, told by its newest row.
_FOUND = _RECURRING.replace("FROM series WHERE amount > 0", f"FROM ({_CHARGED}) WHERE amount > 0 AND category NOT IN ('Transfers and card payments', 'Return')").replace("upper(merchant_name)", "upper(coalesce(nullif(merchant_name, ''), description))")
#: Envelopes by a walk in which every sum is its own subquery, over spending from each household's first budgeted month.
_ENVELOPES = f"""given AS (SELECT * FROM plan_months WHERE month <= DATE '1996-06-30'), who AS (SELECT household_id FROM given UNION SELECT household_id FROM plan_limits),
begun AS (SELECT household_id, coalesce((SELECT min(month) FROM given g WHERE g.household_id = who.household_id AND assigned <> 0), DATE '{VIEW}') AS begins FROM who),
{rows("t.household_id IN (SELECT household_id FROM who) AND t.date >= (SELECT begins FROM begun q WHERE q.household_id = t.household_id) AND t.date <= DATE '1996-06-30'", name="y")},
used AS (SELECT household_id, category, CAST(date_trunc('month', date) AS DATE) AS month, sum(amount) AS spent FROM y WHERE counted GROUP BY 1, 2, 3),
named AS (SELECT household_id, category FROM given UNION SELECT household_id, category FROM plan_limits UNION SELECT household_id, category FROM used WHERE month = DATE '{VIEW}'),
start AS (SELECT n.*, coalesce((SELECT min(month) FROM given g WHERE g.household_id = n.household_id AND g.category = n.category AND assigned <> 0), DATE '{VIEW}') AS begins FROM named n),
carried AS (SELECT s.*, coalesce((SELECT sum(assigned) FROM given g WHERE g.household_id = s.household_id AND g.category = s.category AND month = DATE '{VIEW}'), 0) AS assigned,
 coalesce((SELECT sum(spent) FROM used u WHERE u.household_id = s.household_id AND u.category = s.category AND month = DATE '{VIEW}'), 0) AS spent,
 coalesce((SELECT sum(assigned) FROM given g WHERE g.household_id = s.household_id AND g.category = s.category AND month >= begins AND month < DATE '{VIEW}'), 0)
 - coalesce((SELECT sum(spent) FROM used u WHERE u.household_id = s.household_id AND u.category = s.category AND month >= begins AND month < DATE '{VIEW}'), 0) AS before FROM start s),
walked AS (SELECT household_id, category, assigned, CASE WHEN coalesce(rollover, true) THEN before ELSE 0 END AS rolled_over, spent, assigned + CASE WHEN coalesce(rollover, true) THEN before ELSE 0 END - spent AS available, target, target_kind, target_date
 FROM carried LEFT JOIN plan_limits USING (household_id, category)),
totals AS (SELECT household_id, coalesce(sum(assigned), 0) AS assigned, coalesce(sum(rolled_over), 0) AS rolled_over, coalesce(sum(spent), 0) AS spent, coalesce(sum(available), 0) AS available
 FROM who LEFT JOIN (SELECT * FROM walked WHERE assigned <> 0 OR rolled_over <> 0 OR target IS NOT NULL) USING (household_id) GROUP BY 1)"""
_LABEL = "name"
_LINES = f"""{_texts(1, _said(*report.ACCOUNTS), 'all_households')}
UNION ALL SELECT household_id, 1, {_RANK.format('type, name, account_id')}, '- ' || {_LABEL} || ' (' || institution || ', ' || subtype || '): balance ' || {_usd("CASE WHEN type IN ('credit', 'loan') THEN -current_balance ELSE current_balance END")} FROM accounts WHERE NOT hidden
UNION ALL {_texts(2, _said(*report.MONTHS, report.PARTIAL.format(since=SINCE, month=SINCE[:7])), 'all_households')}
UNION ALL SELECT household_id, 2, {_RANK.format('m, category')}, '- ' || m || ' ' || category || ': ' || {_usd('s')} || CASE WHEN m = '{SINCE[:7]}' THEN ' (partial month: {SINCE} onward only)' ELSE '' END
 FROM (SELECT household_id, strftime(date, '%Y-%m') AS m, category, sum(amount) AS s FROM v WHERE counted GROUP BY 1, 2, 3)
UNION ALL {_texts(3, _said(*report.RECURRING) + ["coalesce('Due dates are relative to the newest transaction (' || newest || ').', 'None detected.')"], '(SELECT h.household_id, newest FROM all_households h LEFT JOIN (SELECT DISTINCT household_id, newest FROM live) USING (household_id))')}
UNION ALL SELECT household_id, 3, {_RANK.format('monthly_amount DESC, key')}, '- ' || name || ': ~' || {_usd('monthly_amount')} || CASE cadence WHEN 'weekly' THEN '/wk' WHEN 'annual' THEN '/yr' ELSE '/mo' END || ' (' || category || ', every ~' || avg_gap_days || ' days, last ' || last_date || ', next ~' || next_date || ')'
 || CASE WHEN price_creep THEN ' — price increased: was ' || {_usd('median_amount')} || ', now ' || {_usd('last_amount')} ELSE '' END
 || CASE WHEN next_date < newest THEN ' — overdue' WHEN datediff('day', newest, next_date) <= CASE cadence WHEN 'weekly' THEN 2 WHEN 'monthly' THEN 7 ELSE 30 END THEN ' — due soon' ELSE '' END FROM live
UNION ALL {_texts(4, _said('', f'## Budget envelopes ({VIEW[:7]})', report.ENVELOPES), 'who')}
UNION ALL SELECT household_id, 4, {_RANK.format('category')}, '- ' || category || ': ' || {_SUMS} || CASE WHEN target IS NULL THEN '' WHEN target_kind = 'by_date' THEN ', target ' || {_usd('target')} || ' by ' || strftime(target_date, '%Y-%m') ELSE ', target ' || {_usd('target')} || '/mo' END FROM walked
UNION ALL SELECT household_id, 5, 1, 'Totals: ' || {_SUMS} FROM totals
UNION ALL {_texts(6, _said(*report.ROWS), 'all_households')}
UNION ALL SELECT v.household_id, 6, row_number() OVER (PARTITION BY v.household_id ORDER BY date DESC, v.id DESC), date || ' | ' || a.{_LABEL} || ' | ' || coalesce(nullif(user_description, ''), nullif(merchant_name, ''), nullif(description, ''), 'Card transaction') || ' | ' || shown || ' | ' || {_usd('amount')}
 || CASE WHEN amount > 0 AND NOT counted THEN ' | not counted as spending' ELSE '' END FROM v JOIN accounts a USING (household_id, account_id)"""
_CAPPED = f"capped AS (SELECT t.id FROM transactions t JOIN accounts a USING (household_id, account_id) WHERE NOT a.hidden AND date >= DATE '{SINCE}' QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY date DESC, t.id DESC) <= {report.NEWEST})"
_ALL = f"""WITH RECURSIVE {ctes('accounts', 'reported', 'plan_months', 'plan_limits')}, transactions AS (SELECT * FROM reported), all_households AS (SELECT DISTINCT household_id FROM accounts), {_CAPPED},
{rows("t.id IN (SELECT id FROM capped) AND NOT t.excluded AND a.type <> 'loan'", name='x', by_month=True)}, v AS (SELECT *, {_DISPLAY} AS shown FROM x),
{_FOUND}, live AS (SELECT * FROM recurs JOIN (SELECT household_id, max(date) AS newest FROM v GROUP BY 1) USING (household_id) WHERE datediff('day', next_date, newest) <= CASE cadence WHEN 'weekly' THEN 14 ELSE 60 END),
{_ENVELOPES}, ln AS ({_LINES})"""

SQL = {
    "M18_A40_report_lines": f"{_ALL} SELECT household_id, section, rank, line FROM ln",
    "M18_A40_whole_report": f"{_ALL} SELECT household_id, string_agg(line, chr(10) ORDER BY section, rank) AS text FROM ln GROUP BY 1",
}
