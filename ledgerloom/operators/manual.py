"""Rows that people enter by hand, and small edits of what they keep: accounts, transactions, entities, mileage, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import present
from .rules import classify
from .verdicts import MECHANISMS

BY = ["household_id"]
# How account types are called, the kinds that can be made by hand, and days until a balance is stale.
TYPE_LABELS = {"depository": "Bank account", "credit": "Credit card", "loan": "Loan"}
KINDS = ["checking", "savings", "credit", "loan"]
STALE_DAYS = 14
#: Days that a feed reaches back from its link, and reads again with each pull.
REACH_DAYS, REREAD_DAYS = 88, 30


def type_label(kind: Column, subtype: Column) -> Column:
    named = F.when(kind == "depository", F.when(subtype == "checking", "Checking account").when(subtype == "savings", "Savings account"))
    out = F.coalesce(present(kind), F.lit("Unknown type"))
    for name, label in TYPE_LABELS.items():
        out = F.when(kind == name, label).otherwise(out)
    return F.coalesce(named, out)


def unhide_label(nickname: Column, name: Column, mask: Column) -> Column:
    """How a prompt names an account: its nickname, else its name and mask."""
    return F.coalesce(present(nickname), F.concat(F.coalesce(present(name), F.lit("this account")), F.coalesce(F.concat(F.lit(" ··"), present(mask)), F.lit(""))))


def stale_days(at: Column, now: Column) -> Column:
    """Whole days since a balance was told, never negative; null where that isn't known."""
    return F.greatest(F.floor((F.unix_seconds(now) - F.unix_seconds(at)) / 86_400), F.lit(0))


def account_rows(entries: DataFrame) -> DataFrame:
    """``entries`` (household_id, name, kind, balance) as accounts, with problem where one is refused.

    An unknown kind is a checking account.  Debts are entered as what is owed: a negative balance is refused, not turned;
    other kinds have no balance by hand.
    """
    kind = F.when(F.col("kind").isin(KINDS), F.col("kind")).otherwise("checking")
    debt = kind.isin("credit", "loan")
    balance = F.when(debt, F.col("balance").try_cast("decimal(14,2)"))
    return entries.select(
        *BY, F.trim(F.coalesce(present(F.col("name")), F.lit("Imported account"))).alias("name"), F.when(debt, kind).otherwise("depository").alias("type"), F.when(kind == "credit", "credit card").otherwise(kind).alias("subtype"),
        F.when(balance >= 0, balance).alias("current_balance"), F.when(balance < 0, "a debt is entered as a positive amount").alias("problem"),
    )


def balance_edits(accounts: DataFrame, edits: DataFrame) -> DataFrame:
    """household_id, account_id, balance, snapshot (whether one is due) and problem of each edit (household_id, account_id, balance) of an account; accounts have source and current_balance."""
    both = edits.select(*BY, "account_id", F.col("balance").try_cast("decimal(14,2)").alias("balance")).join(accounts.select(*BY, "account_id", "type", "source", "current_balance"), [*BY, "account_id"])
    problem = F.when(~F.col("source").eqNullSafe(F.lit("manual")), "only a manual account is edited by hand").when(F.col("balance").isNull(), "not a number").when(F.col("type").isin("credit", "loan") & (F.col("balance") < 0), "a debt is entered as a positive amount")
    return both.select(*BY, "account_id", F.when(problem.isNull(), F.col("balance")).alias("balance"), F.coalesce(problem.isNull() & ~F.col("balance").eqNullSafe(F.col("current_balance")), F.lit(False)).alias("snapshot"), problem.alias("problem"))


def transaction_rows(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """``entries`` (household_id, id, account_id, date, amount, description, category, account_type) as transactions, classified as they are written.

    A user's category is kept only where one was picked.  Entries without a date or a number for an amount are left out.
    """
    rows = entries.withColumn("amount", F.col("amount").try_cast("decimal(14,2)")).withColumn("description", F.trim(F.coalesce("description", F.lit("")))).where("date is not null and amount is not null")
    return classify(rows, rules).withColumn("external_id", F.concat(F.lit("manual:"), F.col("id").cast("string"))).withColumn("user_category", present(F.col("category"))).drop("category")


def edit_rows(held: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``held`` with rows of ``edits`` (household_id, key, position, action, fields): add and update set the fields that aren't null, delete removes; the last of several edits, by position, counts.

    Where ``edits`` have cleared (an array of names), the fields it names become null.
    """
    keys = [*BY, key]
    cleared = F.coalesce("cleared", F.array().cast("array<string>")) if "cleared" in edits.columns else F.array().cast("array<string>")
    last = edits.groupBy(*keys).agg(F.max_by(F.struct("action", cleared.alias("cleared"), *fields), "position").alias("_edit"))
    both = held.withColumn("_held", F.lit(True)).join(last, keys, "full_outer").where(~F.col("_edit.action").eqNullSafe(F.lit("delete")) & (F.col("_held") | (F.col("_edit.action") == "add")))
    value = lambda c: F.when(~F.coalesce(F.array_contains("_edit.cleared", c), F.lit(False)), F.coalesce(F.col(f"_edit.{c}"), F.col(c))).alias(c)
    return both.select(*(value(c) if c in fields else F.col(c) for c in held.columns))


def claim(access: DataFrame, new: DataFrame) -> DataFrame:
    """``access`` (household_id, access_url, last_pulled_at, last_attempt_at, last_error) with newly claimed ones; a known one starts anew."""
    fresh = new.select(*BY, "access_url").distinct()
    blank = fresh.select(*(F.col(c) if c in fresh.columns else F.lit(None).cast(dict(access.dtypes)[c]).alias(c) for c in access.columns))
    return access.join(fresh, [*BY, "access_url"], "left_anti").unionByName(blank)


def disconnect(access: DataFrame, households: DataFrame) -> DataFrame:
    """``access`` without that of households whose request says so; what they pulled stays."""
    return access.join(households.where("confirm = 'disconnect'").select(*BY).distinct(), BY, "left_anti")


def overlap_from(coverage_start: Column, created_on: Column, fed: Column, today: Column, synced: Column) -> Column:
    """The day from which rows belong to the feed: its first row's, else REACH_DAYS before the account was linked, else REREAD_DAYS ago once it has been pulled.  Null: no feed, or not known yet."""
    return F.when(fed, F.coalesce(coverage_start, F.date_sub(created_on, REACH_DAYS), F.when(synced, F.date_sub(today, REREAD_DAYS))))


def duplicate_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``wanted`` (household_id, name) with taken: whether the household, or the program itself, has that name in any case."""
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    held = existing.select(*BY, key(F.col("name")).alias("_name")).distinct().withColumn("_held", F.lit(True))
    both = wanted.withColumn("_name", key(F.col("name"))).join(held, [*BY, "_name"], "left")
    own = F.col("_name").isin([m.lower() for m in MECHANISMS])
    return both.withColumn("taken", (F.col("_name") != "") & (own | F.coalesce("_held", F.lit(False)))).drop("_name", "_held")


def moved_with_proof(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Counts that must agree before ``source`` may be wiped: copied, missing (rows of it that ``target`` lacks), and safe."""
    held = target.select(*keys).distinct().withColumn("_held", F.lit(True))
    both = source.select(*keys).join(held, [source[k].eqNullSafe(held[k]) for k in keys], "left")
    return both.agg(F.count("_held").alias("copied"), F.count_if(F.col("_held").isNull()).alias("missing")).withColumn("safe", F.col("missing") == 0)
