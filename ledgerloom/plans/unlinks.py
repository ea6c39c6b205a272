"""Removing, restoring and deleting banks as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import unlinking
from . import fixture
from .oracles import _q

col, lit = F.col, F.lit
_BANK = "account_id % 40"


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    accounts = fixture.load(s, d, "accounts").select("household_id", "account_id", F.expr(_BANK).alias("institution_id"), ((col("account_id") % 3) == 0).alias("hidden"))
    banks = accounts.select("household_id", "institution_id").distinct()
    n = col("institution_id")
    return {
        "accounts": accounts, "institutions": banks.select("*", F.when(n % 10 == 7, "").when(n % 4 != 0, F.concat(lit("org"), n.cast("string"))).alias("org_id"), lit("active").alias("status")),
        "settings": banks.where(n % 8 == 1).select("household_id", unlinking.record_key(n).alias("key"), F.when(n % 16 == 1, F.concat(lit('["'), (n + 40).cast("string"), lit('","'), (n + 80).cast("string"), lit('"]'))).otherwise("broken").alias("value")),
        "transactions": fixture.load(s, d, "transactions").select("household_id", "account_id", "id"),
    }


def queries() -> dict:
    def removed(s: SparkSession, d: str) -> DataFrame:
        t = _tables(s, d)
        after = unlinking.unlink(t, t["institutions"].where("institution_id % 5 < 3"))
        shown = after["accounts"].join(after["institutions"], unlinking.BANK).groupBy(*unlinking.BANK, "status").agg(F.count_if("hidden").alias("hidden"), F.count("*").alias("accounts"))
        return shown.withColumn("key", unlinking.record_key(col("institution_id"))).join(after["settings"], ["household_id", "key"], "left").drop("key").withColumnRenamed("value", "record")

    def restored(s: SparkSession, d: str) -> DataFrame:
        """Removed twice, then restored."""
        t = _tables(s, d)
        for _ in range(2):
            t |= unlinking.unlink(t, t["institutions"].where("institution_id % 5 < 3"))
        after = unlinking.restore(t, t["institutions"].where("institution_id % 2 = 0 or institution_id % 5 = 1"))
        left = after["settings"].groupBy("household_id").agg(F.count("*").alias("records"))
        return after["counts"].join(after["accounts"].groupBy(*unlinking.BANK).agg(F.count_if("hidden").alias("hidden")), unlinking.BANK).join(left, "household_id", "left")

    def deleted(s: SparkSession, d: str) -> DataFrame:
        t = _tables(s, d)
        n = col("institution_id")
        asked = t["institutions"].select(*unlinking.BANK, (n % 3 != 0).alias("permanent"), F.when(n % 5 == 0, "Delete").otherwise("delete").alias("confirm")).unionByName(t["institutions"].select("household_id", lit(999).cast("long").alias("institution_id"), lit(True).alias("permanent"), lit("delete").alias("confirm")))
        after = unlinking.delete(t, asked)
        of = after["accounts"].groupBy(*unlinking.BANK).agg(F.count("*").alias("accounts"))
        rows = after["transactions"].join(t["accounts"], ["household_id", "account_id"]).groupBy(*unlinking.BANK).agg(F.count("*").alias("transactions"))
        both = after["outcome"].join(after["institutions"].select(*unlinking.BANK, "status"), unlinking.BANK, "left").join(of, unlinking.BANK, "left").join(rows, unlinking.BANK, "left")
        return both.select(*unlinking.BANK, "outcome", "status", F.coalesce("accounts", lit(0)).alias("accounts"), F.coalesce("transactions", lit(0)).alias("transactions"))

    return {"B12_removed_banks": removed, "B12_restored_banks": restored, "B12_deleted_banks": deleted}


def _sql() -> dict[str, str]:
    base = f"""ua AS (SELECT household_id, account_id, {_BANK} AS n, account_id % 3 = 0 AS hidden FROM accounts), ub AS (SELECT household_id, n AS institution_id, n, CASE WHEN n % 10 = 7 THEN '' WHEN n % 4 <> 0 THEN 'org' || n END AS org_id, count(*) AS accounts, count(*) FILTER (WHERE hidden) AS hidden,
 list_sort(list(account_id) FILTER (WHERE NOT hidden)) AS visible, CASE WHEN n % 8 = 1 THEN CASE WHEN n % 16 = 1 THEN '["' || (n + 40) || '","' || (n + 80) || '"]' ELSE 'broken' END END AS held FROM ua GROUP BY household_id, n)"""
    record = "coalesce(held, '[' || coalesce(array_to_string(list_transform(visible, lambda i: '\"' || i || '\"'), ','), '') || ']')"
    shown = f"CASE WHEN n % 5 < 3 OR held IS NOT NULL THEN (SELECT count(*) FROM ua WHERE ua.household_id = ub.household_id AND ua.n = ub.n AND contains(CASE WHEN ub.n % 5 < 3 THEN {record} ELSE held END, '\"' || ua.account_id || '\"') AND (ub.n % 5 < 3 OR ua.hidden)) ELSE 0 END"
    out = "CASE WHEN n % 3 = 0 OR n % 5 = 0 THEN 'not confirmed' WHEN org_id = '' THEN 'unknown kind' ELSE 'deleted' END"
    asked = "(n % 2 = 0 OR n % 5 = 1)"
    return {
        "B12_removed_banks": _q(f"SELECT household_id, institution_id, CASE WHEN n % 5 < 3 AND org_id IS NOT NULL THEN 'disabled' ELSE 'active' END AS status, CASE WHEN n % 5 < 3 THEN accounts ELSE hidden END AS hidden, accounts, CASE WHEN n % 5 < 3 THEN {record} ELSE held END AS record FROM ub", "accounts", then=base),
        "B12_restored_banks": _q(f"SELECT household_id, institution_id, unhidden, CASE WHEN n % 5 < 3 THEN accounts ELSE hidden END - unhidden AS hidden, records FROM (SELECT *, {shown} AS unhidden FROM ub WHERE {asked}) LEFT JOIN (SELECT household_id, count(*) AS records FROM ub WHERE (n % 5 < 3 OR held IS NOT NULL) AND NOT {asked} GROUP BY 1) USING (household_id)", "accounts", then=base),
        "B12_deleted_banks": _q(f"SELECT household_id, institution_id, outcome, CASE WHEN outcome = 'deleted' THEN CASE WHEN org_id IS NOT NULL THEN 'disabled' END ELSE 'active' END AS status, CASE WHEN outcome = 'deleted' THEN 0 ELSE accounts END AS accounts, CASE WHEN outcome = 'deleted' THEN 0 ELSE coalesce(t, 0) END AS transactions FROM (SELECT *, {out} AS outcome FROM ub) LEFT JOIN (SELECT household_id, {_BANK} AS n, count(*) AS t FROM transactions GROUP BY ALL) USING (household_id, n) UNION ALL SELECT DISTINCT household_id, 999, 'not found', CAST(NULL AS VARCHAR), 0, 0 FROM ub", "accounts", "transactions", then=base),
    }


SQL = _sql()
