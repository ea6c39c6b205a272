"""What a pull of the feed may ask for, what its envelopes change in the ledger, and what is remembered of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import held
from ..sources import feed
from . import rules as rule_book

#: Minutes between attempts; days of a first pull, of the overlap with the last one, and that a feed serves at most.
MIN_MINUTES, FIRST_DAYS, OVERLAP_DAYS, REACH_DAYS = 60, 730, 30, 88
PREFIX = "sfin:"
ERROR_CHARS = 1000
NO_BANK = "unknown"


def attempts(access: DataFrame, now: str, force: bool = False) -> DataFrame:
    """``access`` (household_id, access_url, last_pulled_at, last_attempt_at, last_error) with throttled, and last_attempt_at stamped where it isn't.

    The last attempt counts, not the last success, so that a broken bank isn't asked again and again; none yet is due.  Committed by
    ``VersionedTable.commit``, of two devices in the same hour the second loses its version and finds itself throttled.
    """
    at = F.lit(now).cast("timestamp")
    due = F.lit(force) | F.col("last_attempt_at").isNull() | (F.col("last_attempt_at") < at - F.expr(f"INTERVAL {MIN_MINUTES} MINUTES"))
    return access.select(*(c for c in access.columns if c != "last_attempt_at"), F.when(due, at).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"), (~due).alias("throttled"))


def pull_plan(access: DataFrame, now: str, force: bool = False) -> DataFrame:
    """household_id, access_url, throttled, wanted_from, served_from and shortfall_days: the range to ask for, and what the feed can't serve of it."""
    today = F.lit(now).cast("timestamp").cast("date")
    wanted = F.greatest(F.coalesce(F.date_sub(F.col("last_pulled_at").cast("date"), OVERLAP_DAYS), F.date_sub(today, FIRST_DAYS)), F.date_sub(today, FIRST_DAYS))
    served = F.greatest(wanted, F.date_sub(today, REACH_DAYS))
    return attempts(access, now, force).select("household_id", "access_url", "throttled", wanted.alias("wanted_from"), served.alias("served_from"), F.datediff(served, wanted).alias("shortfall_days"))


def watermarks(access: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """``access`` after a pull.  outcomes: household_id, access_url, errors (array of texts) and backfill_failed.

    The data's watermark moves only on a pull without errors, and goes back to none if the history of a new account failed, so
    that the next pull asks for everything; a pull that isn't among the outcomes changes nothing.
    """
    told = outcomes.select("household_id", "access_url", F.filter(F.coalesce("errors", F.array().cast("array<string>")), lambda e: e.isNotNull()).alias("_errors"), F.coalesce("backfill_failed", F.lit(False)).alias("_failed"))
    clean, known = F.size("_errors") == 0, F.col("_errors").isNotNull()
    pulled = F.when(known & F.col("_failed"), F.lit(None)).when(known & clean, F.lit(now).cast("timestamp")).otherwise(F.col("last_pulled_at"))
    error = F.when(known & clean, F.lit(None)).when(known, F.substring(F.array_join("_errors", "; "), 1, ERROR_CHARS)).otherwise(F.col("last_error"))
    both = access.join(told, ["household_id", "access_url"], "left")
    return both.select(*(pulled.alias(c) if c == "last_pulled_at" else error.alias(c) if c == "last_error" else F.col(c) for c in access.columns))


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of several rows with a key the first of the latest pull; a pull's own rows come before those of its backfill."""
    order = Window.partitionBy(*keys).orderBy(F.col("pulled_at").desc_nulls_last(), F.col("backfill"), "nth")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "nth")


def _id(*columns: str) -> Column:
    """An id that is the same whenever it is computed again."""
    return F.abs(F.xxhash64(*columns))


def outcomes(feeds: DataFrame) -> DataFrame:
    """household_id, access_url, errors, backfill_failed and usable (accounts) of each pull: notes about the range asked for are no errors, unless no account came with them."""
    numbered = feeds.select("household_id", "access_url", "backfill", "feed", F.xxhash64("household_id", "access_url", "backfill", F.to_json("feed")).alias("_pull"))
    said = feed.feed_messages(numbered.select(F.struct("household_id", "access_url", "backfill", "_pull").alias("household_id"), "feed"))
    notes = said.groupBy(F.col("household_id._pull").alias("_pull")).agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "error", F.col("message")))).alias("errors"), F.array_sort(F.collect_set("message")).alias("all"))
    counted = numbered.select("household_id", "access_url", "backfill", "_pull", F.greatest(F.size("feed.accounts"), F.lit(0)).alias("accounts"), (F.col("feed.accounts").isNull() & F.col("feed.errors").isNull() & F.col("feed.errlist").isNull()).alias("broken"))
    both = counted.join(notes, "_pull", "left")
    empty = F.array().cast("array<string>")
    errors = F.when(F.col("broken"), F.array(F.lit("unreadable answer"))).when(F.col("accounts") == 0, F.coalesce("all", empty)).otherwise(F.coalesce("errors", empty))
    own = both.withColumn("errors", errors)
    return own.groupBy("household_id", "access_url").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("backfill"), F.col("errors")))))).alias("errors"),
        F.coalesce(F.max(F.col("backfill") & (F.size("errors") > 0)), F.lit(False)).alias("backfill_failed"), F.sum(F.when(~F.col("backfill"), F.col("accounts")).otherwise(0)).alias("usable"),
    )


def account_changes(state: dict[str, DataFrame], feeds: DataFrame, now: str) -> dict[str, DataFrame]:
    """``changes`` without the transactions."""
    day = F.lit(now).cast("timestamp").cast("date")
    of_pull = feed.feed_accounts(feeds.where("not backfill"), "pulled_at", "backfill").withColumn("org_key", F.coalesce("org_key", F.lit(NO_BANK))).withColumn("external_id", F.concat(F.lit(PREFIX), "external_id"))
    seen = held(_first(of_pull, ["household_id", "external_id"]))
    banks = feed.resolve_institutions(state["institutions"], seen).withColumn("institution_id", F.coalesce("institution_id", _id("household_id", "org_key")))
    old = state["accounts"].select("household_id", "external_id", "account_id", F.col("type").alias("_type"), F.col("subtype").alias("_subtype"), F.col("current_balance").alias("_balance"), F.col("balance_on").alias("_on"), F.lit(True).alias("_held"))
    both = seen.join(banks.select("household_id", "org_key", "institution_id"), ["household_id", "org_key"]).join(old, ["household_id", "external_id"], "left")
    kind = F.coalesce("_type", "type")
    both = held(both.withColumn("_new", feed.stored_balance(kind, F.col("raw_balance"))).select(
        "household_id", F.coalesce("account_id", _id("household_id", "external_id")).alias("account_id"), "external_id", "institution_id", "name", "currency", kind.alias("type"), F.when(F.col("_held"), F.col("_subtype")).otherwise(F.col("subtype")).alias("subtype"),
        F.col("_held").isNull().alias("fresh"), F.coalesce("_new", "_balance").alias("current_balance"), F.when(F.col("_new").isNull(), F.col("_on")).otherwise(F.coalesce("balance_on", day)).alias("balance_on"),
        (F.col("_new").isNotNull() & (F.col("_held").isNull() | ~F.col("_new").eqNullSafe(F.col("_balance")))).alias("moved"),
    ))
    return {
        "institutions": banks.select("household_id", "org_key", "institution_id", F.lit(False).alias("disabled"), day.alias("last_pulled_on")),
        "accounts": both.select("household_id", "account_id", "external_id", "institution_id", "name", "currency", "type", "subtype", "current_balance", "balance_on", "fresh"),
        "snapshots": both.where("moved").select("household_id", "account_id", day.alias("captured_on"), F.col("current_balance").alias("balance")),
    }


def changes(state: dict[str, DataFrame], feeds: DataFrame, now: str) -> dict[str, DataFrame]:
    """New rows of institutions, accounts, snapshots and transactions, as they are to be upserted.

    state: institutions (household_id, org_key, institution_id, disabled), accounts (household_id, external_id, account_id, institution_id,
    type, subtype, current_balance) and rules.  feeds: household_id, access_url, pulled_at, backfill and feed (parsed).

    A new account's type is guessed once and it starts hidden; later pulls change neither.  Accounts of disabled banks are left out, with
    their transactions.  A missing balance keeps the last one; a balance that moved is a snapshot of the day.
    """
    day = F.lit(now).cast("timestamp").cast("date")
    found = account_changes(state, feeds, now)
    both = found["accounts"]
    known = state["accounts"].select("household_id", "external_id", "account_id", "type").unionByName(both.where("fresh").select("household_id", "external_id", "account_id", "type"))
    usable = known.join(both.select("household_id", "external_id").distinct(), ["household_id", "external_id"], "left_semi")
    rows = feed.feed_transactions(feeds, "pulled_at", "backfill").withColumn("account_external", F.concat(F.lit(PREFIX), "account")).withColumn("external_id", F.concat(F.lit(PREFIX), "external_id"))
    mine = rows.join(usable.select("household_id", F.col("external_id").alias("account_external"), "account_id", F.col("type").alias("account_type")), ["household_id", "account_external"])
    # Held, as the rows and the rules that they meet come from it.
    first = held(_first(mine, ["household_id", "account_id", "external_id"])).withColumn("id", _id("household_id", "account_id", "external_id"))
    said = first.withColumn("plain", F.col("description")).withColumn("description", F.when((F.col("merchant_name") != "") & (F.col("merchant_name") != F.col("description")), F.concat_ws(" ", "merchant_name", "description")).otherwise(F.col("description")))
    sorted_ = rule_book.classify(said, state["rules"]).withColumn("description", F.col("plain"))
    return {
        **found,
        "transactions": sorted_.select("household_id", "account_id", "external_id", "id", "date", "amount", "merchant_name", "description", "raw_category", "mapped_category", "pending", day.alias("pulled_on"), F.lit("simplefin").alias("source")),
    }
