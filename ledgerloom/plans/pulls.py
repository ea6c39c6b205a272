"""Pulls of the feed as queries, with their SQL: who may ask for what, what envelopes change, what is remembered, and settings of several devices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import amount
from ..operators import pulls, settings
from ..sources import feed
from . import fixture
from .more import _JSON, _feed_type
from .oracles import _q

NOW = "2026-01-06 12:00:00"
col, lit = F.col, F.lit


def _access(s: SparkSession, d: str) -> DataFrame:
    now, a = lit(NOW).cast("timestamp"), col("account_id")
    ago = lambda unit, n: F.timestamp_add(unit, -n, now)
    return fixture.load(s, d, "accounts").select(
        "household_id", F.concat(lit("u"), a.cast("string")).alias("access_url"), F.when(a % 6 != 0, ago("DAY", a * 3 % 900)).alias("last_pulled_at"), F.when(a % 7 != 0, ago("MINUTE", a % 180)).alias("last_attempt_at"), F.when(a % 2 == 0, "old").alias("last_error")
    )


def _pulled(s: SparkSession, d: str) -> DataFrame:
    """Each order's account is pulled twice: its transaction comes a day later then, and its balance is 7.25."""
    rows = fixture.load(s, d, "feeds")
    again = rows.withColumn("posted", F.when(col("posted") > 0, col("posted") + 86400).otherwise(0)).withColumn("balance", lit("7.25"))
    both = rows.withColumn("pulled_at", lit("2026-01-05 12:00:00").cast("timestamp")).unionByName(again.withColumn("pulled_at", lit(NOW).cast("timestamp")))
    return feed.parsed(both.selectExpr("household_id", "concat('u', k % 3) AS access_url", "pulled_at", "false AS backfill", f"{_JSON} AS json"))


def _changes(s: SparkSession, d: str, find: Callable[..., dict] = pulls.account_changes) -> dict[str, DataFrame]:
    rows, k = fixture.load(s, d, "feeds"), col("k")
    banks = rows.select("household_id", col("org").alias("org_key")).distinct().where("household_id % 3 != 1").select("household_id", "org_key", (col("household_id") + 100).cast("long").alias("institution_id"), ((col("household_id") % 5 == 0) & (col("org_key") == "Discover")).alias("disabled"))
    held = rows.where(k % 4 != 0).select(
        "household_id", F.concat(lit("sfin:a"), k.cast("string")).alias("external_id"), k.alias("account_id"), lit(1).cast("long").alias("institution_id"), F.when(k % 3 == 0, "loan").otherwise("depository").alias("type"), lit("old").alias("subtype"),
        F.when(k % 8 == 1, 7.25).otherwise(1).cast("decimal(14,2)").alias("current_balance"), lit("2025-01-01").cast("date").alias("balance_on"),
    )
    taught = rows.where("household_id % 2 = 0").select("household_id", lit("PAYEE SHOP").alias("merchant_key"), lit("Shops").alias("category"), lit(None).cast("decimal(14,2)").alias("amount")).distinct()
    return find({"institutions": banks, "accounts": held, "rules": taught}, _pulled(s, d), NOW)


def queries() -> dict:
    def account_sets(s: SparkSession, d: str) -> DataFrame:
        return feed.account_sets(feed.parsed(fixture.load(s, d, "feeds").selectExpr("household_id", f"""regexp_replace({_JSON}, '"id":"a[0-9]*[05]"', '"id":" "') AS json""")))

    def throttle(s: SparkSession, d: str) -> DataFrame:
        return pulls.attempts(_access(s, d), NOW).select("household_id", "access_url", "throttled", F.date_format("last_attempt_at", "yyyy-MM-dd HH:mm").alias("last_attempt_at"))

    def watermarks(s: SparkSession, d: str) -> DataFrame:
        n = F.substring("access_url", 2, 20).cast("long") % 4
        told = _access(s, d).where(n != 3).select("household_id", "access_url", F.when(n == 1, F.array(lit("bank down"), lit("locked"))).otherwise(F.array().cast("array<string>")).alias("errors"), (n == 2).alias("backfill_failed"))
        return pulls.watermarks(_access(s, d), told, NOW).select("household_id", "access_url", F.date_format("last_pulled_at", "yyyy-MM-dd HH:mm").alias("last_pulled_at"), "last_error")

    def outcomes(s: SparkSession, d: str) -> DataFrame:
        rows = fixture.load(s, d, "feeds").selectExpr("household_id", "concat('u', k % 3) AS access_url", "k % 5 = 0 AS backfill", f"{_JSON} AS json")
        return pulls.outcomes(feed.parsed(rows)).select("household_id", "access_url", F.array_join("errors", "; ").alias("errors"), "backfill_failed", "usable")

    def accounts(s: SparkSession, d: str) -> DataFrame:
        rows = _changes(s, d)["accounts"]
        return rows.select("household_id", "external_id", F.when(~col("fresh"), col("account_id")).alias("account_id"), "type", "subtype", amount(col("current_balance")).alias("balance"), "balance_on", "fresh")

    def transactions(s: SparkSession, d: str) -> DataFrame:
        rows = _changes(s, d, pulls.changes)["transactions"]
        return rows.select("household_id", "external_id", (col("account_id").cast("string") == F.substring("external_id", 7, 20)).alias("held_account"), "date", amount(col("amount")).alias("amount"), "description", "raw_category", "mapped_category")

    def snapshots(s: SparkSession, d: str) -> DataFrame:
        return _changes(s, d)["snapshots"].groupBy("household_id", "captured_on").agg(F.count("*").alias("n"), amount(F.sum("balance")).alias("balance"))

    def merged(s: SparkSession, d: str) -> DataFrame:
        """Two devices change each list: one adds what the other keeps, one takes back what the other has removed, or adds to what the other has put."""
        a = fixture.load(s, d, "accounts").select("household_id", "account_id", F.concat(lit("ignore:"), col("account_id").cast("string")).alias("key"))
        op = lambda seq, op, item: F.struct(lit(seq).alias("seq"), lit(op).alias("op"), lit(item).alias("item"))
        n = col("account_id") % 3
        edits = F.when(n == 0, F.array(op(1, "add", "N1"), op(2, "add", "N2"))).when(n == 1, F.array(op(1, "remove", "A"), op(2, "add", "A"), op(3, "remove", "B"))).otherwise(F.array(op(1, "add", "Z"), op(2, "put", '["P"]'), op(3, "add", "Q")))
        return settings.merged(fixture.load(s, d, "kept"), a.select("household_id", "key", F.inline(edits)))

    return {
        "A37_account_sets": account_sets, "B14_throttle": throttle, "B14_watermarks": watermarks, "M19_outcomes": outcomes, "M19_pulled_accounts": accounts, "M19_pulled_transactions": transactions, "M19_pulled_snapshots": snapshots, "B16_settings_merge": merged,
        "J05_pull_plan": lambda s, d: pulls.pull_plan(_access(s, d), NOW),
    }


def _sql() -> dict[str, str]:
    access = f"""ac AS (SELECT household_id, account_id AS n, 'u' || account_id AS access_url, CASE WHEN account_id % 6 <> 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(account_id * 3 % 900 AS INT)) END AS last_pulled_at, CASE WHEN account_id % 7 <> 0 THEN TIMESTAMP '{NOW}' - to_minutes(account_id % 180) END AS last_attempt_at, CASE WHEN account_id % 2 = 0 THEN 'old' END AS last_error FROM accounts)"""
    stamp = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M')"
    wanted = "greatest(coalesce(CAST(last_pulled_at AS DATE) - 30, DATE '2026-01-06' - 730), DATE '2026-01-06' - 730)"
    kind = "CASE k % 6 WHEN 1 THEN 'capped' WHEN 2 THEN 'advisory' WHEN 4 THEN 'capped' WHEN 5 THEN 'advisory' ELSE 'error' END"
    served = f"""sv AS (SELECT *, k % 4 = 0 AS fresh, CASE WHEN k % 4 = 0 THEN split_part(y, '|', 1) WHEN k % 3 = 0 THEN 'loan' ELSE 'depository' END AS type, CASE WHEN k % 4 = 0 THEN split_part(y, '|', 2) ELSE 'old' END AS subtype FROM (SELECT *, {_feed_type()} AS y FROM (SELECT * REPLACE ('7.25' AS balance) FROM feeds)) WHERE NOT (household_id % 3 <> 1 AND household_id % 5 = 0 AND org = 'Discover'))"""
    names = "CASE WHEN value LIKE '[%' THEN '\"A\",\"B\",\"' || (c % 3) || '\"' ELSE '' END"
    return {
        "A37_account_sets": _q("SELECT household_id, count(*) FILTER (WHERE k % 5 <> 0) AS usable, count(*) FILTER (WHERE k % 5 = 0) AS skipped, count(*) FILTER (WHERE k % 5 <> 0 AND posted > 0 AND value <> 'x') AS readable, count(*) FILTER (WHERE k % 5 <> 0 AND (posted = 0 OR value = 'x')) AS unreadable FROM feeds GROUP BY 1", "feeds"),
        "B14_throttle": _q(f"SELECT household_id, access_url, t AS throttled, CASE WHEN t THEN {stamp('last_attempt_at')} ELSE '2026-01-06 12:00' END AS last_attempt_at FROM (SELECT *, coalesce(last_attempt_at >= TIMESTAMP '{NOW}' - INTERVAL {pulls.MIN_MINUTES} MINUTE, false) AS t FROM ac)", "accounts", then=access),
        "J05_pull_plan": _q(f"SELECT household_id, access_url, coalesce(last_attempt_at >= TIMESTAMP '{NOW}' - INTERVAL {pulls.MIN_MINUTES} MINUTE, false) AS throttled, CAST({wanted} AS DATE) AS wanted_from, CAST(greatest({wanted}, DATE '2026-01-06' - 88) AS DATE) AS served_from, CAST(datediff('day', {wanted}, greatest({wanted}, DATE '2026-01-06' - 88)) AS INT) AS shortfall_days FROM ac", "accounts", then=access),
        "B14_watermarks": _q(f"SELECT household_id, access_url, CASE n % 4 WHEN 0 THEN '2026-01-06 12:00' WHEN 2 THEN NULL ELSE {stamp('last_pulled_at')} END AS last_pulled_at, CASE n % 4 WHEN 1 THEN 'bank down; locked' WHEN 3 THEN last_error END AS last_error FROM ac", "accounts", then=access),
        "M19_outcomes": _q(f"SELECT household_id, 'u' || (k % 3) AS access_url, coalesce(string_agg(DISTINCT message, '; ' ORDER BY message) FILTER (WHERE {kind} = 'error' AND k % 5 <> 0), '') AS errors, coalesce(bool_or(k % 5 = 0 AND {kind} = 'error'), false) AS backfill_failed, count(*) FILTER (WHERE k % 5 <> 0) AS usable FROM feeds GROUP BY 1, 2", "feeds"),
        "M19_pulled_accounts": _q("SELECT household_id, 'sfin:a' || k AS external_id, CASE WHEN NOT fresh THEN k END AS account_id, type, subtype, 7.25::DOUBLE AS balance, CASE WHEN posted > 0 THEN CAST(DATE '1970-01-01' + CAST(posted // 86400 AS INT) + 1 AS DATE) ELSE DATE '2026-01-06' END AS balance_on, fresh FROM sv", "feeds", then=served),
        "M19_pulled_snapshots": _q("SELECT household_id, DATE '2026-01-06' AS captured_on, count(*) AS n, 7.25::DOUBLE * count(*) AS balance FROM sv WHERE fresh OR k % 8 <> 1 GROUP BY 1", "feeds", then=served),
        "M19_pulled_transactions": _q("SELECT household_id, 'sfin:t' || k AS external_id, NOT fresh AS held_account, CAST(DATE '1970-01-01' + CAST(posted // 86400 AS INT) + 1 AS DATE) AS date, -CAST(value AS DOUBLE) AS amount, CASE WHEN description = '' THEN 'Payee' ELSE description END AS description, '' AS raw_category, CASE WHEN description <> '' AND household_id % 2 = 0 THEN 'Shops' ELSE 'Uncategorized' END AS mapped_category FROM sv WHERE posted > 0 AND value <> 'x'", "feeds", then=served),
        "B16_settings_merge": _q(
            f"SELECT household_id, key, CASE WHEN key NOT LIKE 'ignore:%' THEN value WHEN c % 3 = 0 THEN '[' || concat_ws(',', nullif(b, ''), '\"N1\",\"N2\"') || ']' WHEN c % 3 = 1 THEN CASE WHEN b = '' THEN '[\"A\"]' ELSE '[\"A\",\"' || (c % 3) || '\"]' END ELSE '[\"P\",\"Q\"]' END AS value FROM (SELECT *, {names} AS b FROM (SELECT *, CAST(split_part(key, ':', 2) AS BIGINT) AS c FROM kept))",
            "kept",
        ),
    }


SQL = _sql()
