"""Edits of budgets and kept rows as queries, with their SQL, and SQL for what is settled step by step: expected bills and payoff plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import amount
from ..operators import envelopes, importing, manual
from . import fixture
from .more import _tokens
from .oracles import _DEBTS, _LEDGER, _q, ctes

col, lit = F.col, F.lit

_KEYS = "SELECT DISTINCT CAST(l_suppkey AS INT) AS household_id, l_returnflag || l_linestatus AS category, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_suppkey * 5 + month(l_shipdate) * 7 + year(l_shipdate) + ascii(l_returnflag) AS k FROM {lineitem}"
#: Three edits of three in four months of a category, with and without an assignment.
BUDGET_EDITS = f"""SELECT household_id, category, month, p AS position, CASE (k + p * p) % 3 WHEN 0 THEN 'assign' WHEN 1 THEN 'override' ELSE 'fund' END AS action,
 CASE (k * p + p) % 7 WHEN 0 THEN '0' WHEN 1 THEN '' WHEN 2 THEN '12.5' WHEN 3 THEN '1-2' WHEN 4 THEN '-3' WHEN 5 THEN ' 40 ' END AS value FROM ({_KEYS}) AS t JOIN (VALUES (1), (2), (3)) AS e(p) ON k % 4 <> 0"""
#: Four edits of how each category of a household is budgeted.
PLAN_EDITS = """SELECT household_id, category, p AS position, CASE (k + p * p) % 5 WHEN 0 THEN 'by_date' WHEN 1 THEN 'monthly' ELSE 'rollover' END AS action,
 CASE WHEN (k + p * p) % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN '1997-01-31' END WHEN (k + p) % 3 <> 0 THEN 'true' ELSE 'false' END AS value
 FROM (SELECT DISTINCT CAST(l_suppkey AS INT) AS household_id, l_returnflag || l_linestatus AS category, l_suppkey + ascii(l_returnflag) * 3 + ascii(l_linestatus) AS k FROM {lineitem}) AS t JOIN (VALUES (1), (2), (3), (4)) AS e(p) ON k % 7 <> 0"""
fixture.ALL["budget_edits"], fixture.ALL["plan_edits"] = BUDGET_EDITS, PLAN_EDITS


def queries() -> dict:
    def assigned(s: SparkSession, d: str) -> DataFrame:
        after = envelopes.assigned(fixture.load(s, d, "assignments"), fixture.load(s, d, "budget_edits"))
        return after.withColumn("assigned", amount(col("assigned"))).withColumn("target_override", amount(col("target_override")))

    def planned(s: SparkSession, d: str) -> DataFrame:
        return envelopes.planned(fixture.load(s, d, "settings"), fixture.load(s, d, "plan_edits")).withColumn("target", amount(col("target")))

    def filled(s: SparkSession, d: str) -> DataFrame:
        """June filled from May, then 50 moved between two categories of it."""
        table = fixture.load(s, d, "assignments").where("month = date'1996-05-01' or month = date'1996-06-01' and assigned > 400")
        may, june = (table.where(col("month") == lit(m).cast("date")) for m in ("1996-05-01", "1996-06-01"))
        after = envelopes.assigned(table, envelopes.assignment_edits(envelopes.auto_fill(may, june), "1996-06-01"))
        moved = envelopes.move(after.where("month = date'1996-06-01'"), "NO", "RF", 50.0)
        out = envelopes.assigned(after, envelopes.assignment_edits(moved, "1996-06-01"))
        return out.select("household_id", "category", "month", amount(col("assigned")).alias("assigned"))

    def first_of_pull(s: SparkSession, d: str) -> DataFrame:
        """Each third transaction comes three times; the first to come has neither the least amount nor the least wording."""
        held = fixture.load(s, d, "transactions").select("household_id", "id", "amount", "description", "user_category")
        new = held.where("id % 3 = 0").select("household_id", "id", F.explode(F.array(lit(1), lit(2), lit(3))).alias("n"))
        new = new.select("household_id", "id", ((col("n") + col("id")) % 3).alias("came"), (col("n") * 10).cast("decimal(14,2)").alias("amount"), F.concat(lit("PULLED "), col("n").cast("string")).alias("description"))
        return importing.upsert(held, new, ["household_id", "id"], ["amount", "description"], "came").withColumn("amount", amount(col("amount")))

    def cleared(s: SparkSession, d: str) -> DataFrame:
        a = fixture.load(s, d, "accounts").select("household_id", "account_id", "name", "subtype", "created_on")
        k = col("account_id")
        edits = a.where("account_id % 3 > 0").select("household_id", "account_id", F.explode(F.array(lit(1), lit(2))).alias("position"), "created_on").select(
            "household_id", "account_id", "position", F.when(k % 11 == 0, "delete").otherwise("update").alias("action"), F.when(col("position") == 2, F.concat(lit("Renamed "), k.cast("string"))).alias("name"), lit(None).cast("string").alias("subtype"),
            F.when(k % 3 == 1, F.array(lit("subtype"), lit("created_on"))).alias("cleared"), F.when(k % 5 == 0, F.date_add("created_on", 1)).alias("created_on"),
        )
        return manual.edit_rows(a, edits, "account_id", ["name", "subtype", "created_on"])

    return {"B08_assigned": assigned, "B08_planned": planned, "B08_F05_filled_month": filled, "B01_first_of_pull": first_of_pull, "B18_cleared_fields": cleared}


_NUMBER = "TRY_CAST(trim(coalesce(value, '')) AS DECIMAL(14,2))"
#: A row's edits one after the other.
_ASSIGNED = f"""e AS (SELECT household_id, category, month, position, action, trim(coalesce(value, '')) = '' AS blank, {_NUMBER} AS n FROM budget_edits),
st AS (SELECT household_id, category, month, 0 AS p, CAST(coalesce(assigned, 0) AS DECIMAL(14,2)) AS a, CAST(target_override AS DECIMAL(14,2)) AS t, assigned IS NOT NULL AS there
  FROM (SELECT household_id, category, month FROM assignments UNION SELECT household_id, category, month FROM budget_edits) LEFT JOIN assignments USING (household_id, category, month)
 UNION ALL SELECT household_id, category, month, p + 1, CASE WHEN stays THEN na ELSE 0 END, CASE WHEN stays THEN nt END, stays FROM
 (SELECT *, CASE WHEN sets THEN true WHEN clears THEN there AND (na <> 0 OR nt IS NOT NULL) ELSE there END AS stays FROM
  (SELECT st.*, coalesce(action = 'fund' AND (blank OR n IS NOT NULL) OR action = 'assign' AND n <> 0 OR action = 'override' AND n >= 0, false) AS sets, coalesce(action = 'assign' AND (blank OR n = 0) OR action = 'override' AND blank, false) AS clears,
    CASE WHEN action IN ('assign', 'fund') AND blank THEN 0 WHEN action IN ('assign', 'fund') AND n IS NOT NULL THEN n ELSE a END AS na, CASE WHEN action = 'override' AND blank THEN NULL WHEN action = 'override' AND n >= 0 THEN n ELSE t END AS nt
   FROM st LEFT JOIN e USING (household_id, category, month) WHERE p < 3 AND (position = p + 1 OR position IS NULL))))"""
_PLANNED = """st AS (SELECT household_id, category, 0 AS p, target, target_kind AS kind, target_date AS d, rollover AS r, target_kind IS NOT NULL AS there
  FROM (SELECT household_id, category FROM settings UNION SELECT household_id, category FROM plan_edits) LEFT JOIN settings USING (household_id, category)
 UNION ALL SELECT household_id, category, p + 1, CASE WHEN stays THEN target END, CASE WHEN stays THEN CASE WHEN action IN ('by_date', 'monthly') THEN action ELSE coalesce(kind, 'monthly') END END,
  CASE WHEN stays THEN CASE WHEN action = 'by_date' THEN TRY_CAST(value AS DATE) WHEN action = 'monthly' THEN NULL ELSE d END END, CASE WHEN stays THEN CASE WHEN action = 'rollover' THEN value = 'true' ELSE coalesce(r, true) END END, stays FROM
 (SELECT st.*, action, value, CASE WHEN action IS NULL THEN there WHEN action <> 'rollover' OR value <> 'true' THEN true ELSE there AND (target IS NOT NULL OR d IS NOT NULL) END AS stays
  FROM st LEFT JOIN plan_edits USING (household_id, category) WHERE p < 4 AND (position = p + 1 OR position IS NULL)))"""

#: Pairs by rank, in rounds: what is the first left for both its ends is taken.
_EXPECTED = f"""pairs AS (SELECT e.household_id, e.id AS expected_id, t.id AS tx_id, row_number() OVER (ORDER BY abs(datediff('day', t.date, e.due_date)), e.due_date, CAST(e.id AS VARCHAR), t.date, CAST(t.id AS VARCHAR)) AS rank
 FROM (SELECT *, {_tokens('description')} AS et, KEY AS ek, CASE cadence WHEN 'weekly' THEN 4 WHEN 'annual' THEN 30 ELSE 7 END AS reach FROM expected WHERE status = 'pending' AND amount > 0) e
 JOIN (SELECT * EXCLUDE (description), {_tokens('said')} AS tt, TKEY AS tk FROM (SELECT t.*, coalesce(nullif(merchant_name, ''), t.description, '') AS said FROM transactions t JOIN accounts a USING (household_id, account_id) WHERE NOT a.hidden)) t
 ON e.household_id = t.household_id AND t.date BETWEEN e.due_date - reach AND e.due_date + reach AND (e.account_id IS NULL OR e.account_id = t.account_id) AND abs(CAST(t.amount AS DOUBLE) - CAST(e.amount AS DOUBLE)) <= 0.2 * CAST(e.amount AS DOUBLE)
 WHERE ek = tk OR (len(et) > 0 AND len(tt) > 0 AND len(list_intersect(et, tt)) / (len(et) + len(tt) - len(list_intersect(et, tt))) >= 0.4)),
r AS (SELECT household_id, expected_id, tx_id, rank, false AS taken FROM pairs
 UNION ALL SELECT household_id, expected_id, tx_id, rank, rank = min(rank) OVER (PARTITION BY household_id, expected_id) AND rank = min(rank) OVER (PARTITION BY household_id, tx_id)
 FROM r AS w WHERE NOT taken AND NOT EXISTS (SELECT 1 FROM r AS x WHERE x.taken AND x.household_id = w.household_id AND x.expected_id = w.expected_id) AND NOT EXISTS (SELECT 1 FROM r AS x WHERE x.taken AND x.household_id = w.household_id AND x.tx_id = w.tx_id))"""


def _key(column: str) -> str:
    return f"array_to_string(list_filter(string_split(regexp_replace(upper(coalesce({column}, '')), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+')), ' ')"


#: A month of a household's plan at a time, in cents: interest, then the minimums in order, then what is left in order.
_PAYOFF = f"""d AS (SELECT household_id, account_id, monthly_rate AS rate, CAST(floor(balance * 100 + 0.5) AS BIGINT) AS bal, CAST(floor(greatest(0, coalesce(minimum_payment, 0)) * 100 + 0.5) AS BIGINT) AS least_,
  row_number() OVER (PARTITION BY household_id ORDER BY monthly_rate DESC, balance, account_id) AS pri FROM debts),
plans AS (SELECT household_id, plan, sum(CASE WHEN bal > 0 THEN least_ ELSE 0 END) + plan * 20000 AS budget FROM d, (VALUES (0), (1)) AS q(plan) GROUP BY 1, 2),
m AS (SELECT plan, household_id, pri, rate, least_, budget, 0 AS month, bal, CAST(0 AS BIGINT) AS charge, budget <= 0 AS stop FROM d JOIN plans USING (household_id) WHERE bal > 0
 UNION ALL SELECT plan, household_id, pri, rate, least_, budget, month + 1, CASE WHEN stop THEN owed ELSE CAST(rest - greatest(0, least(rest, budget - given - (sum(rest) OVER w - rest))) AS BIGINT) END, charge, stop FROM
 (SELECT *, owed - paid AS rest, sum(paid) OVER (PARTITION BY plan, household_id) AS given FROM
  (SELECT *, greatest(0, least(want, budget - (sum(want) OVER v - want))) AS paid FROM
   (SELECT *, bal + charge AS owed, least(bal + charge, least_) AS want, budget <= sum(charge) OVER (PARTITION BY plan, household_id) AS stop FROM
    (SELECT * EXCLUDE (charge, stop), CAST(floor(bal / 100.0::DOUBLE * rate * 100 + 0.5) AS BIGINT) AS charge FROM m WHERE NOT stop AND bal > 0 AND month < 600)) WINDOW v AS (PARTITION BY plan, household_id ORDER BY pri)))
 WINDOW w AS (PARTITION BY plan, household_id ORDER BY pri)),
s AS (SELECT plan, household_id, max(CASE WHEN NOT stop THEN month ELSE 0 END) AS months, sum(charge) / 100.0::DOUBLE AS interest, bool_or(stop OR month = 600 AND bal > 0) AS stalled FROM m GROUP BY 1, 2),
f AS (SELECT household_id, plan, coalesce(months, 0) AS months, coalesce(interest, 0.0) AS interest, coalesce(stalled, false) AS stalled FROM plans LEFT JOIN s USING (household_id, plan))"""

SQL = {
    "B08_assigned": "WITH RECURSIVE " + ctes("assignments", "budget_edits") + ", " + _ASSIGNED + " SELECT household_id, category, month, CAST(a AS DOUBLE) AS assigned, CAST(t AS DOUBLE) AS target_override FROM st WHERE p = 3 AND there",
    "B08_planned": "WITH RECURSIVE " + ctes("settings", "plan_edits") + ", " + _PLANNED + " SELECT household_id, category, CAST(target AS DOUBLE) AS target, kind AS target_kind, d AS target_date, r AS rollover FROM st WHERE p = 4 AND there",
    "B08_F05_filled_month": _q(
        "SELECT household_id, category, month, CAST(assigned AS DOUBLE) AS assigned FROM t WHERE month = DATE '1996-05-01' UNION ALL SELECT j.household_id, category, DATE '1996-06-01', CAST(assigned + CASE WHEN h.household_id IS NULL THEN 0 WHEN category = 'NO' THEN -50 WHEN category = 'RF' THEN 50 ELSE 0 END AS DOUBLE) FROM j LEFT JOIN h USING (household_id)"
        " UNION ALL SELECT household_id, 'RF', DATE '1996-06-01', 50.0 FROM h WHERE household_id NOT IN (SELECT household_id FROM j WHERE category = 'RF')",
        "assignments",
        then="t AS (SELECT * FROM assignments WHERE month = DATE '1996-05-01' OR (month = DATE '1996-06-01' AND assigned > 400)), o AS (SELECT * FROM t WHERE month = DATE '1996-06-01'), j AS (SELECT household_id, category, assigned FROM o UNION ALL SELECT household_id, category, assigned FROM t WHERE month = DATE '1996-05-01' AND assigned <> 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.household_id = t.household_id AND o.category = t.category)), h AS (SELECT household_id FROM j WHERE category = 'NO')",
    ),
    "B01_first_of_pull": _q("SELECT household_id, id, CASE WHEN id % 3 = 0 THEN n * 10.0 ELSE CAST(amount AS DOUBLE) END AS amount, CASE WHEN id % 3 = 0 THEN 'PULLED ' || n ELSE description END AS description, user_category FROM (SELECT *, CASE id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS n FROM transactions)", "transactions"),
    "B18_cleared_fields": _q(
        "SELECT household_id, account_id, CASE WHEN account_id % 3 > 0 THEN 'Renamed ' || account_id ELSE name END AS name, CASE WHEN account_id % 3 <> 1 THEN subtype END AS subtype, CASE WHEN account_id % 3 = 1 THEN NULL WHEN account_id % 3 = 2 AND account_id % 5 = 0 THEN created_on + 1 ELSE created_on END AS created_on FROM accounts WHERE account_id % 11 <> 0 OR account_id % 3 = 0", "accounts"
    ),
    "D07_expected_match": "WITH RECURSIVE " + ctes(*_LEDGER, "expected") + ", " + _EXPECTED.replace("TKEY", _key("said")).replace("KEY", _key("description")) + " SELECT household_id, expected_id, tx_id FROM r WHERE taken",
    "G03_G04_payoff": "WITH RECURSIVE " + ctes("accounts") + ", " + _DEBTS + ", " + _PAYOFF + """ SELECT household_id, a.months, a.interest, a.stalled, b.months AS baseline_months, b.interest AS baseline_interest, CASE WHEN a.stalled OR b.stalled THEN 0.0 ELSE floor(greatest(0, b.interest - a.interest) * 100 + 0.5) / 100 END AS interest_saved,
 CASE WHEN a.stalled OR b.stalled THEN 0 ELSE greatest(0, b.months - a.months) END AS months_saved FROM f a JOIN f b USING (household_id) WHERE a.plan = 1 AND b.plan = 0""",
}
