"""Accounts, net worth and debts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grouped import apply_in_groups
from ..functions.money import amount
from ..functions.shipping import ship

BY = ["household_id"]
MAX_MONTHS = 600


def is_debt(kind: Column) -> Column:
    return kind.isin("credit", "loan")


def display_balance(balance: Column, kind: Column) -> Column:
    """Debts are stored as what is owed and shown negative; null shows as 0."""
    value = F.coalesce(balance, F.lit(0))
    return F.when(F.coalesce(is_debt(kind), F.lit(False)), -value).otherwise(value)


def _account_keys(rows: DataFrame) -> list[str]:
    """What tells an account in ``rows``: ids are unique within a household, and over all of them only in tables that name no household."""
    return [*BY, "account_id"] if BY[0] in rows.columns else ["account_id"]


def net_worth(snapshots: DataFrame, accounts: DataFrame, since: str | None = None, debts_only: bool = False) -> DataFrame:
    """A point per household and snapshot date: the sum of every account's last balance.

    Each snapshot counts as its change against the account's one before, so dates are summed once and run up by a
    window; no date meets every account.  since: points from that date and the one before it (or else the last).
    debts_only: what is owed, as stored.
    """
    known, keys = accounts.select(*BY, "account_id", "type"), _account_keys(snapshots)
    rows = snapshots.select(*keys, "captured_on", "balance").join(known.where(is_debt(F.col("type"))) if debts_only else known, keys)
    value = F.coalesce("balance", F.lit(0)) if debts_only else display_balance(F.col("balance"), F.col("type"))
    before = F.lag("value").over(Window.partitionBy(*BY, "account_id").orderBy("captured_on"))
    change = rows.withColumn("value", value).withColumn("change", F.col("value") - F.coalesce(before, F.lit(0)))
    daily = change.groupBy(*BY, F.col("captured_on").alias("date")).agg(F.sum("change").alias("change"))
    order = Window.partitionBy(*BY).orderBy("date")
    points = daily.withColumn("total", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if since is not None:
        edge = F.lit(since).cast("date")
        following = F.lead("date").over(order)
        points = points.withColumn("next", following).where((F.col("date") >= edge) | (F.col("next") >= edge) | F.col("next").isNull())
    return points.select(*BY, "date", amount(F.col("total")).alias("total"))


def debts(accounts: DataFrame) -> DataFrame:
    """Visible debts with balance, rate, minimum, utilisation of the limit and progress of the payoff."""
    rows = accounts.where(is_debt(F.col("type")) & ~F.coalesce("hidden", F.lit(False)))
    rate = F.coalesce("apr", "interest_rate")
    use = F.when(F.col("credit_limit") > 0, F.least(amount(F.col("current_balance")) / amount(F.col("credit_limit")), F.lit(1.0)))
    return rows.select(
        *BY, "account_id", "name", "type", "subtype", amount(F.coalesce("current_balance", F.lit(0))).alias("balance"), F.when(rate > 0, rate / 1200).otherwise(0.0).alias("monthly_rate"),
        amount(F.col("minimum_payment")).alias("minimum_payment"), use.alias("utilisation"), payoff_progress(F.col("original_balance"), F.col("current_balance")).alias("progress"),
        ((F.col("type") == "loan") & (F.lower(F.concat_ws(" ", "subtype", "name")).contains("mortgage"))).alias("mortgage"),
    )


def payoff_progress(original: Column, current: Column) -> Column:
    """Percent of an original balance paid, null where either is unknown or more is owed than was."""
    paid = amount(original) - F.greatest(F.lit(0.0), amount(current))
    return F.when((original > 0) & (current <= original), F.least(F.lit(100.0), F.greatest(F.lit(0.0), paid / amount(original) * 100)))


def debt_totals(accounts: DataFrame) -> DataFrame:
    return debts(accounts).groupBy(*BY).agg(F.count("*").alias("debts"), F.round(F.sum("balance"), 2).alias("total_balance"), F.round(F.sum("minimum_payment"), 2).alias("total_minimum"))


def _in_order(accounts: DataFrame, strategy: str) -> DataFrame:
    first = [F.col("monthly_rate").desc(), F.col("balance")] if strategy == "avalanche" else [F.col("balance"), F.col("monthly_rate").desc()]
    return debts(accounts).withColumn("priority", F.row_number().over(Window.partitionBy(*BY).orderBy(*first, "account_id")))


def debt_order(accounts: DataFrame, strategy: str = "snowball") -> DataFrame:
    """Priority of each debt: the smallest balance first, or (avalanche) the highest rate."""
    return _in_order(accounts, strategy).select(*BY, "account_id", "balance", "monthly_rate", "priority")


def amortize(balance: Column, percent: Column, payment: Column) -> Column:
    """months, interest and stalled of one debt under a fixed payment, rounded to cents each month (600 at most); money is held in whole cents."""
    rate = F.when(percent > 0, percent / 1200).otherwise(0.0)
    pay = F.floor(F.coalesce(payment, F.lit(0.0)) * 100 + 0.5).cast("double")
    start = F.floor(F.coalesce(balance, F.lit(0.0)) * 100 + 0.5).cast("double")
    ship(SparkSession.active())
    return _amortized(start, rate, pay)


def _months(left: np.ndarray, rate: np.ndarray, pay: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Month by month, for the debts that are paid on: their places, interest, payment and what is left; all debts of a batch at once."""
    left, at = left.copy(), np.flatnonzero(left > 0)
    for _ in range(MAX_MONTHS):
        charge = np.floor(left[at] * rate[at] + 0.5)
        at, charge = at[pay[at] > charge], charge[pay[at] > charge]
        if not len(at):
            break
        due = left[at] + charge
        paid = np.minimum(pay[at], due)
        yield at, charge, paid, due - paid
        left[at] = due - paid
        at = at[left[at] > 0]


@F.pandas_udf(T.StructType([T.StructField("months", T.IntegerType()), T.StructField("interest", T.DoubleType()), T.StructField("stalled", T.BooleanType())]))
def _amortized(start: pd.Series, rate: pd.Series, pay: pd.Series) -> pd.DataFrame:
    left = start.to_numpy(float)
    months, interest, rest = np.zeros(len(left), np.int32), np.zeros(len(left)), np.maximum(left, 0)
    for at, charge, _, after in _months(left, rate.to_numpy(float), pay.to_numpy(float)):
        months[at] += 1
        interest[at] += charge
        rest[at] = after
    return pd.DataFrame({"months": months, "interest": interest / 100, "stalled": rest > 0})


def schedule(accounts: DataFrame) -> DataFrame:
    """household_id, account_id, month, payment, interest and balance of each month of each debt, 600 at most; none where the payment does not cover the interest."""
    ship(accounts.sparkSession)
    rows = debts(accounts).select(*BY, "account_id", F.floor(F.col("balance") * 100 + 0.5).cast("double").alias("left"), (F.col("monthly_rate") * 1200 / 1200).alias("rate"), F.floor(F.col("minimum_payment") * 100 + 0.5).cast("double").alias("pay"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _months(*(batch[c].fillna(0.0).to_numpy(float) for c in ("left", "rate", "pay")))
            for month, (at, charge, paid, after) in enumerate(found, 1):
                yield pd.DataFrame({"household_id": batch["household_id"].to_numpy()[at], "account_id": batch["account_id"].to_numpy()[at], "month": month, "payment": paid / 100, "interest": charge / 100, "balance": after / 100})

    return rows.mapInPandas(run, f"household_id int, account_id {dict(rows.dtypes)['account_id']}, month int, payment double, interest double, balance double")


def _poured(pool: float, wanted: np.ndarray) -> np.ndarray:
    """What each of some wants in order gets of a pool."""
    return np.clip(pool - (np.cumsum(wanted) - wanted), 0, wanted)


def plan(debts: list[dict], extra: float) -> tuple[int, float, bool, dict]:
    """months, interest, stalled and per debt (months, interest), for debts in order of priority; a month's debts at once, in whole cents."""
    state = [d for d in debts if d["balance"] > 0]
    whole = lambda x: np.floor(np.asarray(x, float) * 100 + 0.5)
    rate, lowest = np.array([d["rate"] for d in state], float), [max(0.0, d["minimum"]) for d in state]
    left, least, budget = whole([d["balance"] for d in state]), whole(lowest), float(whole(sum(lowest) + max(0.0, extra)))
    interest, ended, at, months, stalled = np.zeros(len(state)), np.zeros(len(state), int), np.arange(len(state)), 0, bool(state) and budget <= 0
    while len(at) and not stalled and months < MAX_MONTHS:
        charge = np.floor(left[at] / 100 * rate[at] * 100 + 0.5)
        interest[at] += charge
        stalled = budget <= float(charge.sum())
        if stalled:
            break
        owed = left[at] + charge
        bound = _poured(budget, np.minimum(owed, least[at]))
        owed -= bound
        left[at] = owed - _poured(budget - bound.sum(), owed)  # the minimums in order, then what is left in order
        months += 1
        ended[at[left[at] <= 0]] = months
        at = at[left[at] > 0]
    each = {d["account_id"]: (int(m) or None, i / 100) for d, m, i in zip(state, ended, interest.tolist(), strict=True)}
    return months, float(interest.sum()) / 100, stalled or bool(len(at)), each


def payoff(accounts: DataFrame, strategy: str = "snowball", extra: float = 0.0) -> DataFrame:
    """Months and interest of each household's payoff plan, and against paying the minimums only.

    A plan's months follow each other, so a household's debts (a few rows) are one group.
    """
    rows = _in_order(accounts, strategy).select(*BY, "priority", "account_id", "balance", "monthly_rate", F.coalesce("minimum_payment", F.lit(0.0)).alias("minimum"))

    def solve(group: list[tuple]) -> list[tuple]:
        held = [{"account_id": a, "balance": b, "rate": r, "minimum": m} for _, _, a, b, r, m in sorted(group, key=lambda g: g[1])]
        (months, interest, stalled, _), base = plan(held, extra), plan(held, 0.0)
        same = not stalled and not base[2]
        return [(group[0][0], months, interest, stalled, base[0], base[1], round(max(0.0, base[1] - interest), 2) if same else 0.0, max(0, base[0] - months) if same else 0)]

    return apply_in_groups(rows, BY, solve, "household_id int, months int, interest double, stalled boolean, baseline_months int, baseline_interest double, interest_saved double, months_saved int")


def in_payoff(accounts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The debts that a plan takes: those with a balance that their household chose (household_id, account_id, included), and cards where it said nothing.  no_minimum: without a payment to plan by."""
    said = chosen.select(*BY, "account_id", "included")
    both = debts(accounts).where("balance > 0").join(said, [*BY, "account_id"], "left").where(F.coalesce("included", F.col("type") == "credit"))
    return both.select(*BY, "account_id", "type", "balance", (~F.coalesce(F.col("minimum_payment") > 0, F.lit(False))).alias("no_minimum"))
