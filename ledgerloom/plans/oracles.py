"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from ..functions import text as T
from ..operators.tax import BUCKETS, LINES
from .fixture import ctes


def _m(column: str, pattern: str) -> str:
    """RE2 match; null does not match."""
    return f"coalesce(regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}'), false)"


def _paid(c: str) -> str:
    return f"({_m(c, T.STANDALONE_PAYMENT)} OR ({_m(c, T.CARD_ISSUER)} AND {_m(c, T.PAYMENT_WORD)}) OR ({_m(c, T.TRANSFER)} AND {_m(c, T.CARD_WORD)}))"


_PAID = f"({_paid('description')} OR {_paid('merchant_name')})"
_RECEIVED = f"({_m('description', T.CARD_CREDIT_NOT_REFUND)} OR {_m('merchant_name', T.CARD_CREDIT_NOT_REFUND)})"


def rows(where: str, paired: bool = True, name: str = "v", by_month: bool = False) -> str:
    """CTEs that end in ``name``: visible rows of a range with internal and all verdicts; by_month: pairs lie within a month.

    Pairs: the search of ``matching.match``, a step a round, of all stretches at once.  A search (``path`` and ``open`` of a start) takes the
    nearest in it hasn't ``left`` out; one that is free ends it and turns the path, one that is owned goes on from its owner, and none goes back.
    """
    p = name
    month = "CAST(date_trunc('month', date) AS DATE)" if by_month else "0"
    stretch = "household_id, scope, size"
    ranked = "list({c} ORDER BY day, CAST(account_id AS VARCHAR), CAST(id AS VARCHAR)) FILTER (WHERE {side})"
    sides = ", ".join(f"{ranked.format(c=c, side=side)} AS {k}{c}" for k, side in (("o_", "amount > 0"), ("i_", "amount < 0")) for c in ("id", "day", "account_id"))
    able = lambda i, j: f"abs(i_day[{j}] - o_day[{i}]) <= 4 AND i_account_id[{j}] <> o_account_id[{i}]"
    legs = f"""{p}e AS (SELECT household_id, id, account_id, amount, datediff('day', DATE '1970-01-01', date) AS day, abs(amount) AS size, {month} AS scope FROM {p}b
 WHERE NOT coalesce(excluded, false) AND account_type IS DISTINCT FROM 'loan' AND coalesce(user_type, '') = '' AND amount <> 0 AND date IS NOT NULL),
{p}g AS (SELECT *, coalesce(day - lag(day) OVER (PARTITION BY {stretch} ORDER BY day, id) > 4, false) AS new FROM {p}e),
{p}d AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY {stretch} ORDER BY day, id ROWS UNBOUNDED PRECEDING) AS stretch FROM {p}g),
{p}r AS MATERIALIZED (SELECT row_number() OVER () AS g, {sides} FROM {p}d GROUP BY {stretch}, stretch HAVING count(*) FILTER (WHERE amount > 0) > 0 AND count(*) FILTER (WHERE amount < 0) > 0),
{p}k AS (SELECT g, o_day, o_account_id, i_day, i_account_id, list_transform(list_sort(list_transform(range(1, len(o_day) + 1), lambda i: {{'n': len(list_filter(range(1, len(i_day) + 1), lambda j: {able('i', 'j')})), 'i': i}})), lambda s: s.i) AS starts FROM {p}r),
{p}s(g, o_day, o_account_id, i_day, i_account_id, starts, open, path, rest, owner) USING KEY (g) AS (
 SELECT g, o_day, o_account_id, i_day, i_account_id, starts[2:], starts[1:1], CAST([] AS BIGINT[]), range(1, len(i_day) + 1), list_transform(i_day, lambda d: CAST(0 AS BIGINT)) FROM {p}k
 UNION SELECT g, o_day, o_account_id, i_day, i_account_id, CASE WHEN ends THEN starts[2:] ELSE starts END, CASE WHEN ends THEN starts[1:1] WHEN j IS NULL THEN open[:len(open) - 1] ELSE list_append(open, owner[j]) END,
  CASE WHEN ends THEN [] WHEN j IS NULL THEN path[:len(path) - 1] ELSE list_append(path, j) END, CASE WHEN ends THEN range(1, len(i_day) + 1) WHEN j IS NULL THEN rest ELSE list_filter(rest, lambda k: k <> j) END,
  CASE WHEN owner[j] = 0 THEN list_transform(owner, lambda o, k: coalesce(open[list_position(list_append(path, j), k)], o)) ELSE owner END
 FROM (SELECT *, coalesce(owner[j] = 0, len(open) = 1 AND j IS NULL) AS ends FROM (SELECT *, list_min(list_transform(list_filter(rest, lambda k: {able('open[-1]', 'k')}), lambda k: {{'gap': abs(i_day[k] - o_day[open[-1]]), 'j': k}})).j AS j FROM {p}s WHERE len(open) > 0))),
{p}l AS MATERIALIZED (SELECT unnest(list_concat(list_filter(i_id, lambda x, k: owner[k] > 0), list_transform(list_filter(owner, lambda o: o > 0), lambda o: o_id[o]))) AS id FROM {p}s JOIN {p}r USING (g))"""
    if not paired:
        legs = f"{p}l AS (SELECT id FROM {p}b WHERE false)"
    return f"""{p}b AS (SELECT t.*, a.type AS account_type, a.entity_id AS account_entity FROM transactions t JOIN accounts a USING (account_id) WHERE NOT a.hidden AND ({where})),
{legs},
{p}c AS (SELECT *, id IN (SELECT id FROM {p}l) AS internal, coalesce(nullif(user_category, ''), nullif(mapped_category, ''), 'Uncategorized') AS category,
 CASE WHEN coalesce(user_category, '') <> '' THEN user_category = 'Transfers and card payments' WHEN account_type = 'credit' THEN amount < 0 AND {_RECEIVED} ELSE {_PAID} END AS card_payment FROM {p}b),
{p} AS (SELECT *, CASE WHEN excluded OR internal OR account_type = 'loan' OR amount = 0 THEN false WHEN coalesce(user_type, '') <> '' THEN user_type = 'spending'
  WHEN amount < 0 THEN account_type = 'credit' AND NOT card_payment ELSE NOT card_payment END AS counted,
 CASE WHEN excluded OR internal OR account_type = 'loan' OR amount = 0 THEN false WHEN coalesce(user_type, '') <> '' THEN user_type = 'inflow' ELSE account_type = 'depository' AND amount < 0 END AS income,
 CASE WHEN account_type = 'loan' THEN 'loan' WHEN internal THEN CASE WHEN account_type = 'credit' OR {_PAID} THEN 'card_payment' ELSE 'transfer' END
  WHEN amount > 0 OR account_type = 'credit' THEN CASE WHEN card_payment THEN 'card_payment' ELSE 'spending' END ELSE 'inflow' END AS auto_type FROM {p}c)"""


def fnv(key: str) -> str:
    """FNV-1a of an ASCII text as 16 hex digits."""
    steps = f"list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({key}, ''), lambda c: CAST(unicode(c) AS HUGEINT))), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    return f"lower(lpad(hex(CAST({steps} AS UBIGINT)), 16, '0'))"


def _q(select: str, *tables: str, then: str = "") -> str:
    return f"WITH RECURSIVE {ctes(*tables)}{', ' + then if then else ''} {select}"


_LEDGER = ("accounts", "transactions")
_RANGE = "date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'"
_MONTH = "date BETWEEN DATE '1995-06-01' AND DATE '1995-06-30'"
_MAY = "date BETWEEN DATE '1995-05-01' AND DATE '1995-05-31'"
_YEAR = "date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"
_TYPE = "CASE WHEN account_type = 'loan' THEN 'loan' WHEN user_type IN ('spending', 'inflow', 'transfer', 'card_payment') THEN user_type ELSE auto_type END"
_DISPLAY = f"CASE WHEN {_TYPE} IN ('transfer', 'card_payment') THEN 'Transfers and card payments' ELSE category END"
_MASK = "[\\s*·.xX_-]+"
_BANK = f"coalesce(CASE WHEN NOT {_m('merchant_name', '^' + _MASK + '$')} THEN nullif(merchant_name, '') END, CASE WHEN NOT {_m('description', '^' + _MASK + '$')} THEN nullif(description, '') END, 'Card transaction')"
_NAME = f"coalesce(nullif(user_description, ''), {_BANK})"
_KEY = "array_to_string(list_filter(string_split(regexp_replace(upper(coalesce(description, '')), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+')), ' ')"

_GROUPS = "groups AS (SELECT household_id, category, sum(amount) AS s, count(*) AS transaction_count FROM v WHERE counted GROUP BY 1, 2)"
_FLOW = """flow AS (SELECT h.household_id, m.month, coalesce(income, 0) AS income, coalesce(spending, 0) AS spending, coalesce(income_count, 0) AS income_count
 FROM (SELECT DISTINCT household_id FROM v) h CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-06-01', INTERVAL 1 MONTH)) AS DATE) AS month) m
 LEFT JOIN (SELECT household_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(CASE WHEN income THEN -amount END) AS income, sum(CASE WHEN counted THEN amount END) AS spending, count(*) FILTER (WHERE income) AS income_count FROM v GROUP BY 1, 2) s
 ON s.household_id = h.household_id AND s.month = m.month)"""

_DEBTS = """debts AS (SELECT household_id, account_id, name, type, subtype, CAST(coalesce(current_balance, 0) AS DOUBLE) AS balance, CASE WHEN coalesce(apr, interest_rate) > 0 THEN coalesce(apr, interest_rate) / 1200 ELSE 0.0 END AS monthly_rate,
 CAST(minimum_payment AS DOUBLE) AS minimum_payment, CASE WHEN credit_limit > 0 THEN least(CAST(current_balance AS DOUBLE) / CAST(credit_limit AS DOUBLE), 1.0) END AS utilisation,
 CASE WHEN original_balance > 0 AND current_balance <= original_balance THEN least(100.0, greatest(0.0, (CAST(original_balance AS DOUBLE) - greatest(0.0, CAST(current_balance AS DOUBLE))) / CAST(original_balance AS DOUBLE) * 100)) END AS progress,
 type = 'loan' AND contains(lower(subtype || ' ' || name), 'mortgage') AS mortgage FROM accounts WHERE type IN ('credit', 'loan') AND NOT hidden)"""

_WORTH = """points AS (SELECT household_id, date, sum(change) OVER (PARTITION BY household_id ORDER BY date) AS total FROM (SELECT household_id, captured_on AS date, sum(value - before) AS change FROM
 (SELECT household_id, captured_on, value, coalesce(lag(value) OVER (PARTITION BY account_id ORDER BY captured_on), 0) AS before FROM (SELECT a.household_id, s.account_id, captured_on, {value} AS value FROM snapshots s JOIN accounts a USING (account_id) {where})) GROUP BY 1, 2))"""
_SIGNED = "CASE WHEN type IN ('credit', 'loan') THEN -balance ELSE balance END"

_MAP = "(VALUES ('URGENT', '14'), ('HIGH', '17'), ('Groceries', '19'), ('MEDIUM', 'rents'), ('LOW', '18'))"
_TAX = rows(_YEAR) + f""", shaped AS (SELECT household_id, id, date AS transaction_date, amount, {_DISPLAY} AS category, excluded, is_capital, coalesce(entity_id, account_entity) AS entity_id FROM v),
routed AS (SELECT s.*, target, CASE WHEN is_capital THEN 'capital' WHEN target = 'rents' THEN 'rents' WHEN TRY_CAST(target AS INT) IN ({', '.join(map(str, LINES))}) THEN 'line' WHEN amount < 0 THEN 'defaulted' ELSE 'unmapped' END AS route
 FROM shaped s LEFT JOIN {_MAP} m(category, target) USING (category) WHERE NOT excluded AND amount <> 0)"""
_LINE_ROWS = ", ".join(f"({k}, '{v}')" for k, v in LINES.items())
_BUCKET_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in BUCKETS.items())
_LINES = f"""lines AS (SELECT e.household_id, e.entity_id, l.line, l.label, CAST(coalesce(sum(r.amount), 0) AS DOUBLE) AS total FROM (SELECT DISTINCT household_id, entity_id FROM shaped) e CROSS JOIN (VALUES {_LINE_ROWS}) l(line, label)
 LEFT JOIN routed r ON r.household_id = e.household_id AND r.entity_id IS NOT DISTINCT FROM e.entity_id AND r.route = 'line' AND TRY_CAST(r.target AS INT) = l.line GROUP BY ALL)"""

_RATED = """rated AS (SELECT household_id, CASE WHEN on_date >= DATE '2026-07-01' THEN 0.76::DOUBLE WHEN on_date >= DATE '2026-01-01' THEN 0.725::DOUBLE WHEN on_date >= DATE '2025-01-01' THEN 0.7::DOUBLE WHEN on_date >= DATE '2024-01-01' THEN 0.67::DOUBLE END AS rate, miles FROM mileage WHERE miles > 0),
sums AS (SELECT household_id, rate, CAST(sum(miles) AS DOUBLE) AS miles, floor(CAST(sum(miles) AS DOUBLE) * rate * 100 + 0.5) / 100 AS amount FROM rated GROUP BY 1, 2)"""

_WALK = """a AS (SELECT household_id, category, month, sum(assigned) AS assigned, max(target_override) AS override FROM assignments WHERE month <= DATE '1996-06-01' GROUP BY 1, 2, 3),
s AS (SELECT household_id, category, month, sum(spent) AS spent FROM envelope_spending WHERE month <= DATE '1996-06-01' GROUP BY 1, 2, 3),
c AS (SELECT DISTINCT household_id, category FROM a UNION SELECT household_id, category FROM settings UNION SELECT household_id, category FROM s WHERE month = DATE '1996-06-01'),
b AS (SELECT c.household_id, c.category, coalesce((SELECT min(month) FROM assignments x WHERE x.household_id = c.household_id AND x.category = c.category AND x.month <= DATE '1996-06-01' AND x.assigned <> 0), DATE '1996-06-01') AS begins FROM c),
w AS (SELECT b.household_id, b.category, coalesce((SELECT sum(assigned) FROM a WHERE a.household_id = b.household_id AND a.category = b.category AND month = DATE '1996-06-01'), 0) AS assigned,
 coalesce((SELECT sum(spent) FROM s WHERE s.household_id = b.household_id AND s.category = b.category AND month = DATE '1996-06-01'), 0) AS spent,
 coalesce((SELECT sum(assigned) FROM a WHERE a.household_id = b.household_id AND a.category = b.category AND month >= begins AND month < DATE '1996-06-01'), 0)
 - coalesce((SELECT sum(spent) FROM s WHERE s.household_id = b.household_id AND s.category = b.category AND month >= begins AND month < DATE '1996-06-01'), 0) AS before,
 (SELECT max(override) FROM a WHERE a.household_id = b.household_id AND a.category = b.category AND month = DATE '1996-06-01') AS override FROM b),
walked AS (SELECT w.household_id, w.category, CAST(assigned AS DOUBLE) AS assigned, CAST(CASE WHEN coalesce(rollover, true) THEN before ELSE 0 END AS DOUBLE) AS rolled_over, CAST(spent AS DOUBLE) AS spent,
 CAST(assigned + CASE WHEN coalesce(rollover, true) THEN before ELSE 0 END - spent AS DOUBLE) AS available, CAST(target AS DOUBLE) AS target, coalesce(target_kind, 'monthly') AS target_kind, target_date, coalesce(rollover, true) AS rollover, CAST(override AS DOUBLE) AS target_override
 FROM w LEFT JOIN settings USING (household_id, category))"""

_DUE = "CASE cadence WHEN 'weekly' THEN due_date + 7 WHEN 'monthly' THEN CAST(due_date + INTERVAL 1 MONTH AS DATE) WHEN 'annual' THEN CAST(due_date + INTERVAL 1 YEAR AS DATE) END"
_GUARD = f"(NOT coalesce(account_type = 'credit' AND amount > 0, false) AND ({_m('description', T.TRANSFER)} OR {_m('description', T.STANDALONE_PAYMENT)} OR ({_m('description', T.CARD_ISSUER)} AND {_m('description', T.PAYMENT_WORD)})))"
_LEARNED = f"""k AS (SELECT *, {_KEY} AS full_key FROM {{source}}),
best AS (SELECT k.id, arg_max(r.category, (r.amount IS NOT NULL, length(r.merchant_key), r.category)) AS learned, arg_max(r.merchant_key, (r.amount IS NOT NULL, length(r.merchant_key), r.category)) AS rule_key, CASE WHEN bool_or(r.amount IS NOT NULL) THEN max(r.amount) END AS rule_amount FROM k JOIN rules r ON r.household_id = k.household_id AND (k.full_key = r.merchant_key OR starts_with(k.full_key, r.merchant_key || ' '))
 AND (r.amount IS NULL OR r.amount = k.amount) WHERE full_key <> '' GROUP BY 1)"""

_CELLS = """p AS (SELECT household_id, account_id, row, trim(date_cell) AS d, trim(description_cell) AS description, trim(amount_cell) AS t FROM cells),
q AS (SELECT *, CASE WHEN regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(d AS DATE) WHEN regexp_full_match(d, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN TRY_CAST(try_strptime(d, '%m/%d/%Y') AS DATE) END AS date,
 CASE WHEN starts_with(t, '(') THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(t, '[()$]', '', 'g') AS DECIMAL(18,4)) AS value FROM p),
r AS (SELECT *, CASE WHEN date IS NULL OR value IS NULL OR description = '' THEN concat_ws(', ', CASE WHEN date IS NULL THEN 'unparseable date' END, CASE WHEN value IS NULL THEN 'unparseable amount' END, CASE WHEN description = '' THEN 'empty description' END)
 WHEN abs(value) < 0.005 THEN 'zero amount' END AS reason, CAST(-value AS DECIMAL(14,2)) AS amount FROM q),
built AS (SELECT *, CAST(CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY household_id, account_id, reason IS NULL, CASE WHEN reason IS NULL THEN date END, CASE WHEN reason IS NULL THEN amount END, CASE WHEN reason IS NULL THEN upper(regexp_replace(description, '\\s+', ' ', 'g')) END ORDER BY row)
  ELSE row_number() OVER (PARTITION BY household_id, account_id, reason IS NULL ORDER BY row) END - 1 AS INT) AS ordinal, coalesce(account_id % 3 = 0 AND date >= DATE '1996-01-01', false) AS overlap FROM r)"""

_RECURRING = """c AS (SELECT * FROM (VALUES (0, 'weekly', 5, 9, 2, 52.0::DOUBLE / 12, 84), (1, 'monthly', 24, 32, 4, 1.0::DOUBLE, 190), (2, 'annual', 350, 380, 15, 1.0::DOUBLE / 12, NULL)) AS c(rank, cadence, min_gap, max_gap, gap_tol, per_month, look_back)),
ru AS (SELECT household_id, id, account_id, merchant_name, category, CAST(amount AS DOUBLE) AS amount, datediff('day', DATE '1970-01-01', transaction_date) AS day, trim(regexp_replace(regexp_replace(regexp_replace(upper(merchant_name), '[0-9#*]+', ' ', 'g'), '[^A-Z ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM series WHERE amount > 0),
rt AS (SELECT w.*, c.* FROM (SELECT *, max(day) OVER (PARTITION BY household_id, key) AS newest, count(*) OVER (PARTITION BY household_id, key) AS size FROM ru WHERE key <> '') w JOIN c ON size >= 3 AND (look_back IS NULL OR newest - day <= look_back)),
rm AS (SELECT *, median(amount) OVER (PARTITION BY household_id, key, rank) AS median_amount, count(*) OVER (PARTITION BY household_id, key, rank) AS n FROM rt),
rk AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY household_id, key, rank) AS kept FROM rm WHERE abs(amount - median_amount) <= 0.2 * median_amount) WHERE n >= 3 AND kept >= 3 AND kept >= 0.8 * n),
rg AS (SELECT *, day - lag(day) OVER (PARTITION BY household_id, key, rank ORDER BY day, id) AS gap, row_number() OVER (PARTITION BY household_id, key, rank ORDER BY day, id) AS position FROM rk),
rh AS (SELECT *, median(gap) OVER (PARTITION BY household_id, key, rank) AS median_gap FROM rg),
rf AS (SELECT household_id, key, rank, cadence, min_gap, max_gap, per_month, median_amount, median_gap, count(*) AS count, count(gap) AS gaps, count(*) FILTER (WHERE abs(gap - median_gap) <= gap_tol) AS near, sum(gap) AS gap_sum, max(day) AS last_day, median(amount) AS monthly_amount, arg_max(amount, (day, amount)) AS last_amount FROM rh GROUP BY ALL),
rx AS (SELECT * FROM (SELECT *, min(rank) OVER (PARTITION BY household_id, key) AS best FROM rf WHERE median_gap BETWEEN min_gap AND max_gap AND near >= ceil(gaps * 2 / 3)) WHERE rank = best),
rmode AS (SELECT household_id, key, rank, arg_max(v, (n, -reached)) FILTER (WHERE f = 1) AS name, arg_max(v, (n, -reached)) FILTER (WHERE f = 2) AS category, CAST(arg_max(v, (n, -reached)) FILTER (WHERE f = 3) AS BIGINT) AS account_id FROM (SELECT household_id, key, rank, f, v, count(*) AS n, max(position) AS reached FROM
 (SELECT *, 1 AS f, merchant_name AS v FROM rg UNION ALL SELECT *, 2, category FROM rg UNION ALL SELECT *, 3, CAST(account_id AS VARCHAR) FROM rg) WHERE coalesce(v, '') <> '' GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3),
recurs AS (SELECT household_id, key, name, category, account_id, round(monthly_amount, 2) AS monthly_amount, monthly_amount * per_month AS monthly_equivalent, cadence, count, CAST(DATE '1970-01-01' + CAST(last_day AS INT) AS DATE) AS last_date, CAST(DATE '1970-01-01' + CAST(last_day + floor(median_gap + 0.5) AS INT) AS DATE) AS next_date,
 CAST(floor(gap_sum / gaps + 0.5) AS BIGINT) AS avg_gap_days, round(last_amount, 2) AS last_amount, round(median_amount, 2) AS median_amount, last_amount > 1.05 * median_amount AS price_creep, CAST(NULL AS VARCHAR) AS due_status FROM rx JOIN rmode USING (household_id, key, rank))"""

SQL: dict[str, str] = {
    "A01_D01_visible_range": _q("SELECT household_id, id, account_id, date, CAST(amount AS DOUBLE) AS amount, account_type FROM vb", *_LEDGER, then=rows(_RANGE, False)),
    "A05_D03_accounts": _q(f"SELECT household_id, account_id, name, type, institution, CAST({_SIGNED.replace('balance', 'current_balance')} AS DOUBLE) AS balance, hidden FROM accounts", "accounts"),
    "A07_H02_M15_account_ledger_page": _q("SELECT household_id, id, date, CAST(amount AS DOUBLE) AS amount, (SELECT count(*) FROM transactions WHERE account_id = 7) > 5 AS has_more FROM transactions WHERE account_id = 7 ORDER BY date DESC, id DESC LIMIT 5", "transactions"),
    "A06_M11_debts": _q("SELECT * FROM debts", "accounts", then=_DEBTS),
    "C01_C12_verdicts": _q(f"SELECT household_id, id, category, counted, income, card_payment, auto_type, {_TYPE} AS type, {_NAME} AS name, {_DISPLAY} AS display, CASE WHEN {_TYPE} = 'spending' AND amount < 0 THEN 'Refund' ELSE CASE {_TYPE} WHEN 'spending' THEN 'Spending' WHEN 'inflow' THEN 'Income' WHEN 'transfer' THEN 'Transfer' WHEN 'card_payment' THEN 'Card payment' WHEN 'loan' THEN 'Loan' ELSE '?' END END AS label FROM v", *_LEDGER, then=rows("true", False)),
    "E01_E02_totals": _q("SELECT household_id, CAST(sum(CASE WHEN counted THEN amount ELSE 0 END) AS DOUBLE) AS spent, CAST(sum(CASE WHEN income THEN -amount ELSE 0 END) AS DOUBLE) AS income FROM v GROUP BY 1", *_LEDGER, then=rows(_RANGE, False)),
    "D04_internal_transfers": _q("SELECT household_id, id FROM vl JOIN transactions USING (id)", *_LEDGER, then=rows("true")),
    "M01_spending_by_category": _q("SELECT household_id, category, CAST(s AS DOUBLE) AS amount, transaction_count, CASE WHEN t = 0 THEN 0.0 ELSE CAST(s AS DOUBLE) / abs(CAST(t AS DOUBLE)) * 100 END AS percent_of_total FROM (SELECT *, sum(s) OVER (PARTITION BY household_id) AS t FROM groups)", *_LEDGER, then=rows(_MONTH) + ", " + _GROUPS),
    "M02_E05_biggest_movers": _q("SELECT household_id, category, CAST(c AS DOUBLE) AS curr, CAST(p AS DOUBLE) AS prev, CAST(c - p AS DOUBLE) AS delta, rank FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY abs(c - p) DESC, category) AS rank FROM (SELECT household_id, category, coalesce(x.s, 0) AS c, coalesce(y.s, 0) AS p FROM (SELECT household_id, category, sum(amount) AS s FROM v WHERE counted GROUP BY 1, 2) x FULL JOIN (SELECT household_id, category, sum(amount) AS s FROM u WHERE counted GROUP BY 1, 2) y USING (household_id, category)) WHERE abs(c - p) >= 1) WHERE rank <= 5", *_LEDGER, then=rows(_MONTH) + ", " + rows(_MAY, name="u")),
    "M03_C11_month_transactions": _q(f"SELECT household_id, id, {_NAME} AS merchant_name, date AS transaction_date, CAST(amount AS DOUBLE) AS amount, {_DISPLAY} AS category, coalesce(nullif(mapped_category, ''), 'Uncategorized') AS auto_category, {_BANK} AS auto_description, excluded, {_TYPE} AS tx_type, auto_type AS auto_tx_type, counted FROM v", *_LEDGER, then=rows(_MONTH)),
    "M04_E07_cash_flow": _q("SELECT household_id, month, CAST(income AS DOUBLE) AS income, CAST(spending AS DOUBLE) AS spending, income_count, CAST(sum(spending) OVER (PARTITION BY household_id) AS DOUBLE) / 6 AS average_spending FROM flow", *_LEDGER, then=rows(_RANGE) + ", " + _FLOW),
    "M05_E08_actual_income": _q("SELECT c.household_id, coverage_start, coalesce(income, 0.0) AS income FROM (SELECT t.household_id, min(date) AS coverage_start FROM transactions t JOIN accounts a USING (account_id) WHERE NOT hidden AND type = 'depository' GROUP BY 1) c LEFT JOIN (SELECT household_id, CAST(sum(-amount) AS DOUBLE) AS income FROM v WHERE income GROUP BY 1) i USING (household_id)", *_LEDGER, then=rows(_MONTH)),
    "E04_spending_to_date": _q("SELECT household_id, CAST(sum(amount) AS DOUBLE) AS spent FROM v WHERE counted AND day(date) <= 15 GROUP BY 1", *_LEDGER, then=rows(_MONTH)),
    "E06_envelope_spending": _q("SELECT household_id, category, CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(amount) AS DOUBLE) AS spent FROM v WHERE counted GROUP BY 1, 2, 3", *_LEDGER, then=rows(_RANGE)),
    "E17_teach_queue": _q("SELECT household_id, key, count(*) FILTER (WHERE counted) AS spend_count, CAST(sum(CASE WHEN counted THEN amount ELSE 0 END) AS DOUBLE) AS spent, count(*) FILTER (WHERE NOT counted) AS other_count, CAST(sum(CASE WHEN NOT counted AND amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS money_in, CAST(sum(CASE WHEN NOT counted AND amount >= 0 THEN amount ELSE 0 END) AS DOUBLE) AS other_out, coalesce(arg_max(id, (date, -id)) FILTER (WHERE counted AND amount > 0), arg_max(id, (date, -id))) AS example_id FROM keyed WHERE key <> '' GROUP BY 1, 2", *_LEDGER, then=rows(_RANGE) + f", keyed AS (SELECT *, {_KEY} AS key FROM v)"),
    "E18_categorized_share": _q("SELECT household_id, CASE WHEN t > 0 THEN greatest(0.0, least(1.0, 1 - abs(u) / t)) END AS share FROM (SELECT household_id, CAST(sum(s) AS DOUBLE) AS t, CAST(sum(CASE WHEN category = 'Uncategorized' THEN s ELSE 0 END) AS DOUBLE) AS u FROM groups GROUP BY 1)", *_LEDGER, then=rows(_MONTH) + ", " + _GROUPS),
    "E19_D14_category_rollup": _q("SELECT household_id, coalesce(parent, category) AS \"group\", round(CAST(sum(s) AS DOUBLE), 2) AS amount, count(*) AS members FROM groups LEFT JOIN legal USING (household_id, category) GROUP BY 1, 2", *_LEDGER, "registry", then=rows(_MONTH) + ", " + _GROUPS + """, trimmed AS (SELECT household_id, position, trim(name) AS name, nullif(trim(parent), '') AS parent FROM registry WHERE trim(name) NOT IN ('', 'Uncategorized', 'Return', 'Transfers and card payments')),
 claims AS (SELECT household_id, name, arg_min(parent, position) AS parent FROM trimmed t WHERE parent IS NOT NULL AND parent <> name AND EXISTS (SELECT 1 FROM trimmed n WHERE n.household_id = t.household_id AND n.name = t.parent) GROUP BY 1, 2),
 legal AS (SELECT household_id, name AS category, parent FROM claims c WHERE NOT EXISTS (SELECT 1 FROM claims n WHERE n.household_id = c.household_id AND n.name = c.parent))"""),
    "E21_income_sections": _q("SELECT household_id, round(CAST(sum(income) AS DOUBLE), 2) AS total, CAST(sum(income) AS DOUBLE) / 6 AS average, CAST(sum(income_count) AS BIGINT) AS count FROM flow GROUP BY 1", *_LEDGER, then=rows(_RANGE) + ", " + _FLOW),
    "E22_income_vs_spending": _q("SELECT household_id, CASE WHEN s / i < 0.9 THEN 'less' WHEN s / i > 1.1 THEN 'more' ELSE 'about' END AS kind, i AS avg_income, s AS avg_spending FROM (SELECT household_id, CAST(sum(income) AS DOUBLE) / 6 AS i, CAST(sum(spending) AS DOUBLE) / 6 AS s FROM flow GROUP BY 1) WHERE i > 0", *_LEDGER, then=rows(_RANGE) + ", " + _FLOW),
    "E23_breakdown_segments": _q("SELECT household_id, label, amount, position, amount / sum(amount) OVER (PARTITION BY household_id) AS share FROM (SELECT household_id, CASE WHEN rank <= 6 THEN category ELSE 'All Others' END AS label, round(CAST(sum(s) AS DOUBLE), 2) AS amount, min(rank) AS position FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY s DESC, category) AS rank FROM groups WHERE s > 0) GROUP BY 1, 2)", *_LEDGER, then=rows(_MONTH) + ", " + _GROUPS),
    "E10_M16_coverage": _q("SELECT household_id, account_id, min(first) AS first, max(last) AS last, CAST(sum(n) AS BIGINT) AS count, string_agg(source || '=' || n, ',' ORDER BY source || '=' || n) AS sources FROM (SELECT household_id, account_id, coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n, min(date) AS first, max(date) AS last FROM vb GROUP BY 1, 2, 3) GROUP BY 1, 2", *_LEDGER, then=rows("true", False)),
    "D15_coverage_gaps": _q("SELECT a.household_id, a.account_id, f AS served_from FROM accounts a JOIN (SELECT account_id, min(date) AS f FROM transactions GROUP BY 1) t USING (account_id) WHERE f BETWEEN created_on - 88 AND created_on + 7", *_LEDGER),
    "D06_classify": _q(f"SELECT household_id, k.id, CASE WHEN coalesce(account_type = 'credit' AND amount > 0, false) OR {_m('description', T.CARD_WORD)} OR NOT {_m('description', T.TRANSFER)} THEN '' WHEN amount > 0 THEN 'TRANSFER_OUT' WHEN amount < 0 THEN 'TRANSFER_IN' ELSE '' END AS raw_category, CASE WHEN {_GUARD} THEN 'Transfers and card payments' ELSE coalesce(learned, 'Uncategorized') END AS mapped_category FROM k LEFT JOIN best ON k.id = best.id", *_LEDGER, "rules", then=rows("true", False) + ", " + _LEARNED.format(source="vb")),
    "B07_M17_rule_matches": _q(f"SELECT household_id, rule_key AS merchant_key, CAST(rule_amount AS DOUBLE) AS amount, learned AS category, count(*) AS matched, count(*) FILTER (WHERE learned <> coalesce(mapped_category, '')) AS changed FROM k JOIN best ON k.id = best.id WHERE NOT {_GUARD} AND coalesce(user_category, '') = '' GROUP BY 1, 2, 3, 4", *_LEDGER, "rules", then="every AS (SELECT t.*, a.type AS account_type FROM transactions t JOIN accounts a USING (account_id)), " + _LEARNED.format(source="every")),
    "C18_M14_search": _q("SELECT id, date, CAST(amount AS DOUBLE) AS amount, (SELECT count(*) FROM hits) > 52 AS has_more FROM hits ORDER BY date DESC, id DESC LIMIT 50 OFFSET 2", *_LEDGER, then=rows("true", False) + ", hits AS (SELECT * FROM vb WHERE contains(lower(concat_ws(chr(10), description, merchant_name, user_description)), 'vendor 1') AND abs(amount) BETWEEN 10 AND 200 AND year(date) BETWEEN 1995 AND 1997)"),
    "E11_schedule_lines": _q("SELECT * FROM lines", *_LEDGER, then=_TAX + ", " + _LINES),
    "E11_schedule_summary": _q("SELECT household_id, entity_id, CAST(rents AS DOUBLE) AS rents, CAST(defaulted AS DOUBLE) AS defaulted, CAST(expenses AS DOUBLE) AS expenses, CAST(unmapped AS DOUBLE) AS unmapped, CAST(capital AS DOUBLE) AS capital, rents_count, defaulted_count, CAST(rents - expenses AS DOUBLE) AS net FROM (SELECT household_id, entity_id, sum(CASE WHEN route IN ('rents', 'defaulted') THEN -amount ELSE 0 END) AS rents, count(*) FILTER (WHERE route IN ('rents', 'defaulted')) AS rents_count, sum(CASE WHEN route = 'defaulted' THEN -amount ELSE 0 END) AS defaulted, count(*) FILTER (WHERE route = 'defaulted') AS defaulted_count, sum(CASE WHEN route = 'line' THEN amount ELSE 0 END) AS expenses, sum(CASE WHEN route = 'unmapped' THEN amount ELSE 0 END) AS unmapped, sum(CASE WHEN route = 'capital' THEN amount ELSE 0 END) AS capital FROM routed GROUP BY 1, 2)", *_LEDGER, then=_TAX),
    "E11_unmapped": _q("SELECT household_id, entity_id, category, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS count FROM routed WHERE route = 'unmapped' GROUP BY 1, 2, 3", *_LEDGER, then=_TAX),
    "E12_entity_monthly": _q("SELECT household_id, entity_id, strftime(transaction_date, '%Y-%m') AS ym, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS income, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS expenses, CAST(sum(-amount) AS DOUBLE) AS net FROM shaped WHERE NOT excluded AND amount <> 0 GROUP BY 1, 2, 3", *_LEDGER, then=_TAX),
    "E13_entity_ledger": _q("SELECT household_id, entity_id, section, id, transaction_date, CAST(amount AS DOUBLE) AS amount, row_number() OVER (PARTITION BY household_id, entity_id, section ORDER BY transaction_date DESC, CAST(id AS VARCHAR)) AS position FROM (SELECT *, CASE WHEN excluded OR amount = 0 THEN 'not_counted' WHEN amount < 0 THEN 'in' ELSE 'out' END AS section FROM shaped)", *_LEDGER, then=_TAX),
    "E14_deductions": _q(f"SELECT h.household_id, b.bucket, b.label, CAST(coalesce(sum(s.amount), 0) AS DOUBLE) AS total, count(s.id) AS count FROM (SELECT DISTINCT household_id FROM shaped) h CROSS JOIN (VALUES {_BUCKET_ROWS}) b(bucket, label) LEFT JOIN (VALUES ('URGENT', 'medical'), ('HIGH', 'charitable')) m(category, bucket) ON m.bucket = b.bucket LEFT JOIN shaped s ON s.household_id = h.household_id AND s.category = m.category AND NOT excluded AND amount <> 0 GROUP BY 1, 2, 3", *_LEDGER, then=_TAX),
    "E15_D11_mileage": _q("SELECT * FROM sums", "mileage", then=_RATED),
    "E15_mileage_total": _q("SELECT household_id, coalesce(round(sum(CASE WHEN rate IS NOT NULL THEN miles END), 2), 0.0) AS miles, coalesce(round(sum(amount), 2), 0.0) AS amount, coalesce(round(sum(CASE WHEN rate IS NULL THEN miles END), 2), 0.0) AS unrated_miles FROM sums GROUP BY 1", "mileage", then=_RATED),
    "B13_schedule_csv": _q("""SELECT household_id, entity_id, line, coalesce(CAST(entity_id AS VARCHAR), '') || ',' || line || ',' || CASE WHEN contains(label, ',') THEN '"' || label || '"' ELSE label END || ',' || printf('%.2f', total) AS csv FROM lines""", *_LEDGER, then=_TAX + ", " + _LINES),
    "F01_M08_envelopes": _q("SELECT * FROM walked", "assignments", "envelope_spending", "settings", then=_WALK),
    "F01_envelope_totals": _q("SELECT household_id, round(sum(assigned), 2) AS assigned, round(sum(rolled_over), 2) AS rolled_over, round(sum(spent), 2) AS spent, round(sum(available), 2) AS available, round(sum(coalesce(target_override, target, 0.0)), 2) AS target FROM walked WHERE assigned <> 0 OR rolled_over <> 0 OR coalesce(target_override, target) IS NOT NULL GROUP BY 1", "assignments", "envelope_spending", "settings", then=_WALK),
    "F02_F03_target_need_pace": _q("SELECT household_id, category, CASE WHEN n > 0 THEN floor(n * 100 + 0.5) / 100 ELSE 0.0 END AS need, CASE WHEN assigned > 0 AND spent > 0 AND spent > assigned * (10 / 30) + 0.1 * assigned THEN floor((spent - 10 / 30 * assigned) * 100 + 0.5) / 100 END AS ahead FROM (SELECT *, CASE WHEN target_override IS NOT NULL THEN target_override - assigned WHEN target IS NULL THEN 0.0 WHEN target_kind = 'by_date' THEN (target - rolled_over) / greatest(coalesce(datediff('month', DATE '1996-06-01', target_date) + 1, 1), 1) - assigned ELSE target - assigned END AS n FROM walked)", "assignments", "envelope_spending", "settings", then=_WALK),
    "F05_auto_fill": _q("SELECT household_id, category, CAST(sum(assigned) AS DOUBLE) AS assigned, EXISTS (SELECT 1 FROM assignments e WHERE e.household_id = a.household_id AND e.category = a.category AND e.month = DATE '1996-06-01' AND e.assigned > 400) AS skipped FROM assignments a WHERE month = DATE '1996-05-01' GROUP BY household_id, category HAVING sum(assigned) <> 0", "assignments"),
    "F07_M10_net_worth": _q("SELECT household_id, date, CAST(total AS DOUBLE) AS total FROM points", "accounts", "snapshots", then=_WORTH.format(value=_SIGNED, where="")),
    "F08_net_worth_since": _q("SELECT household_id, date, CAST(total AS DOUBLE) AS total FROM (SELECT *, lead(date) OVER (PARTITION BY household_id ORDER BY date) AS n FROM points) WHERE date >= DATE '2024-01-10' OR n >= DATE '2024-01-10' OR n IS NULL", "accounts", "snapshots", then=_WORTH.format(value=_SIGNED, where="")),
    "F09_debt_series": _q("SELECT household_id, date, CAST(total AS DOUBLE) AS total FROM points", "accounts", "snapshots", then=_WORTH.format(value="balance", where="WHERE type IN ('credit', 'loan')")),
    "G01_amortize": "WITH RECURSIVE " + ctes("accounts") + ", " + _DEBTS + """, z AS (SELECT household_id, account_id, floor(balance * 100 + 0.5) AS bal, monthly_rate * 1200 / 1200 AS r, floor(minimum_payment * 100 + 0.5) AS pay FROM debts),
 step AS (SELECT household_id, account_id, bal, r, pay, 0 AS months, 0.0::DOUBLE AS interest, bal > 0 AS open, false AS stalled FROM z UNION ALL
 SELECT household_id, account_id, CASE WHEN pay > c THEN bal + c - pay ELSE bal END, r, pay, CASE WHEN pay > c THEN months + 1 ELSE months END, CASE WHEN pay > c THEN interest + c ELSE interest END, pay > c AND bal + c - pay > 0, pay <= c
 FROM (SELECT *, floor(bal * r + 0.5) AS c FROM step) WHERE open AND months < 600)
 SELECT household_id, account_id, max(months) AS months, max(interest) / 100 AS interest, bool_or(stalled) OR bool_and(open) AS stalled FROM step GROUP BY 1, 2""",
    "G05_debt_order": _q("SELECT household_id, account_id, balance, monthly_rate, row_number() OVER (PARTITION BY household_id ORDER BY balance, monthly_rate DESC, account_id) AS priority FROM debts", "accounts", then=_DEBTS),
    "E20_debt_totals": _q("SELECT household_id, count(*) AS debts, round(sum(balance), 2) AS total_balance, round(sum(minimum_payment), 2) AS total_minimum FROM debts GROUP BY 1", "accounts", then=_DEBTS),
    "G07_I22_expected_status": _q(f"SELECT household_id, id, CASE WHEN status IN ('matched', 'dismissed') THEN status WHEN due_date < DATE '1996-03-01' THEN 'overdue' ELSE 'pending' END AS state, status = 'pending' AND due_date < DATE '1996-03-01' AND datediff('day', due_date, DATE '1996-03-01') > CASE WHEN cadence IN ('monthly', 'annual') THEN 60 ELSE 14 END AS missed, {_DUE} AS next_due FROM expected", "expected"),
    "G08_projected_cycles": "WITH RECURSIVE " + ctes("expected") + f", step AS (SELECT household_id, id, cadence, due_date, -1 AS cycle FROM expected WHERE status = 'pending' UNION ALL SELECT household_id, id, cadence, {_DUE}, cycle + 1 FROM step WHERE cycle < 199 AND {_DUE} <= DATE '1999-01-31') SELECT household_id, id, cycle, due_date FROM step WHERE cycle >= 0",
    "E16_expected_by_category": _q("SELECT household_id, category, CAST(sum(amount) AS DOUBLE) AS amount FROM expected WHERE status = 'pending' AND coalesce(category, '') <> '' GROUP BY 1, 2", "expected"),
    "D10_I23_duplicate_expected": _q("SELECT household_id, id FROM expected f WHERE status = 'dismissed' AND recurring_key IS NOT NULL AND EXISTS (SELECT 1 FROM expected h WHERE h.status = 'pending' AND h.household_id = f.household_id AND h.recurring_key = f.recurring_key AND abs(datediff('day', h.due_date, f.due_date)) <= CASE f.cadence WHEN 'weekly' THEN 2 WHEN 'monthly' THEN 4 WHEN 'annual' THEN 15 ELSE 0 END)", "expected"),
    "J01_import_rows": _q(f"SELECT household_id, account_id, row, date, CAST(amount AS DOUBLE) AS amount, description, CASE WHEN reason IS NULL THEN 'csv:' || {fnv("date || '|' || amount || '|' || upper(regexp_replace(description, '\\s+', ' ', 'g'))")} || ':' || ordinal END AS external_id, ordinal, reason, overlap FROM built", "cells", then=_CELLS),
    "J02_import_plan": _q("SELECT household_id, account_id, usable, overlapping, 0 AS duplicates, usable - overlapping AS new, skipped, CASE WHEN usable = 0 THEN 'empty' WHEN account_id % 3 <> 0 OR overlapping = 0 THEN 'import' WHEN overlapping = usable THEN 'audit' ELSE 'both' END AS verdict FROM (SELECT household_id, account_id, count(*) FILTER (WHERE reason IS NULL) AS usable, count(*) FILTER (WHERE reason IS NULL AND overlap) AS overlapping, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped FROM built GROUP BY 1, 2)", "cells", then=_CELLS),
    "B01_upsert": _q("SELECT household_id, t.id, CAST(coalesce(n.amount, t.amount) AS DOUBLE) AS amount, CASE WHEN n.id IS NULL THEN t.description ELSE 'FEED' END AS description, user_category FROM transactions t LEFT JOIN fresh n USING (household_id, id) UNION ALL SELECT household_id, id, CAST(amount AS DOUBLE), 'FEED', NULL FROM fresh WHERE id >= 10000000000", "transactions", then="fresh AS (SELECT household_id, id + CASE WHEN id % 2 = 0 THEN 10000000000 ELSE 0 END AS id, amount + 1 AS amount FROM transactions WHERE id % 3 = 0)"),
    "F06_M09_recurring": _q("SELECT * FROM recurs", "series", then=_RECURRING),
    "K09_recurring_headline": _q("SELECT household_id, round(sum(monthly_equivalent), 2) AS monthly_cost, count(*) AS items FROM recurs WHERE NOT (household_id = 0 AND key = 'STREAM AA') GROUP BY 1", "series", then=_RECURRING),
}

#: Months until debts are paid, as the amortization finds them.
SQL["G06_debt_free_month"] = f"SELECT account_id, CASE WHEN NOT stalled AND months > 0 THEN strftime(DATE '2026-01-01' + to_months(CAST(months AS INT)), '%Y-%m') END AS free FROM ({SQL['G01_amortize']})"

