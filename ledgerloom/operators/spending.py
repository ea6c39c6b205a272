"""Spending and cash-flow reports per household."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import amount
from ..functions.text import present
from .verdicts import with_verdicts

BY = ["household_id"]


def spending_total(rows: DataFrame, through_day: int | None = None) -> DataFrame:
    """spent per household, up to a day of the month if one is given."""
    rows = with_verdicts(rows).where("counted")
    if through_day is not None:
        rows = rows.where(F.dayofmonth("date") <= through_day)
    return rows.groupBy(*BY).agg(amount(F.sum("amount")).alias("spent"))


def spending_groups(rows: DataFrame) -> DataFrame:
    """category, amount, transaction_count and percent_of_total; percents keep the sign of the amount."""
    groups = with_verdicts(rows).where("counted").groupBy(*BY, "category").agg(F.sum("amount").alias("sum"), F.count("*").alias("transaction_count"))
    total = F.sum("sum").over(Window.partitionBy(*BY))
    percent = F.when(total == 0, 0.0).otherwise(amount(F.col("sum")) / F.abs(amount(total)) * 100)
    return groups.select(*BY, "category", amount(F.col("sum")).alias("amount"), "transaction_count", percent.alias("percent_of_total"))


def biggest_movers(rows: DataFrame, month: str, limit: int = 5, least: float = 1.0) -> DataFrame:
    """The categories that moved most from the month before to ``month`` (its first day).  rows: of both months, each paired on its own."""
    now = F.trunc("date", "month") == F.lit(month).cast("date")
    part = lambda which, name: F.coalesce(F.sum(F.when(which, F.col("amount"))), F.lit(0)).alias(name)
    both = with_verdicts(rows).where("counted").groupBy(*BY, "category").agg(part(now, "curr"), part(~now, "prev"))
    moved = both.withColumn("delta", F.col("curr") - F.col("prev")).where(F.abs("delta") >= least)
    rank = F.row_number().over(Window.partitionBy(*BY).orderBy(F.abs("delta").desc(), "category"))
    return moved.withColumn("rank", rank).where(F.col("rank") <= limit).select(*BY, "category", *(amount(F.col(c)).alias(c) for c in ("curr", "prev", "delta")), "rank")


def envelope_spending(rows: DataFrame) -> DataFrame:
    """spent per month and category."""
    return with_verdicts(rows).where("counted").groupBy(*BY, "category", F.trunc("date", "month").alias("month")).agg(F.sum("amount").alias("spent"))


def cash_flow(rows: DataFrame, first_month: str, months: int) -> DataFrame:
    """income and spending of each month of a fixed range for each household in ``rows``; months without rows are 0, and averages divide by all months."""
    v = with_verdicts(rows)
    sums = v.groupBy(*BY, F.trunc("date", "month").alias("month")).agg(
        F.sum(F.when(F.col("income"), -F.col("amount"))).alias("income"), F.sum(F.when(F.col("counted"), F.col("amount"))).alias("spending"), F.count_if("income").alias("income_count")
    )
    start = F.lit(first_month).cast("date")
    spine = v.select(*BY).distinct().withColumn("month", F.explode(F.sequence(start, F.add_months(start, months - 1), F.expr("interval 1 month"))))
    full = spine.join(sums, [*BY, "month"], "left").na.fill(0, ["income", "spending", "income_count"])
    average = F.sum("spending").over(Window.partitionBy(*BY))
    return full.select(*BY, "month", amount(F.col("income")).alias("income"), amount(F.col("spending")).alias("spending"), "income_count", (amount(average) / months).alias("average_spending"))


def actual_income(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """income of the rows, and the first date of any visible depository account."""
    income = with_verdicts(rows).where("income").groupBy(*BY).agg(amount(F.sum(-F.col("amount"))).alias("income"))
    start = coverage.where("account_type = 'depository'").groupBy(*BY).agg(F.min("date").alias("coverage_start"))
    return start.join(income, BY, "left").na.fill(0.0, ["income"])


def insight(flow: DataFrame, band: float = 0.1) -> DataFrame:
    """Whether a household spends less or more than it makes, or about as much; none without income."""
    mean = flow.groupBy(*BY).agg(F.avg("income").alias("income"), F.avg("spending").alias("spending")).where("income > 0")
    ratio = F.col("spending") / F.col("income")
    kind = F.when(ratio < 1 - band, "less").when(ratio > 1 + band, "more").otherwise("about")
    return mean.select(*BY, kind.alias("kind"), F.col("income").alias("avg_income"), F.col("spending").alias("avg_spending"))


def income_sections(flow: DataFrame) -> DataFrame:
    """Per household: total, average over all months, and count of income rows."""
    return flow.groupBy(*BY).agg(F.round(F.sum("income"), 2).alias("total"), (F.sum("income") / F.count("*")).alias("average"), F.sum("income_count").alias("count"))


def breakdown_segments(groups: DataFrame, most: int = 6) -> DataFrame:
    """The largest positive categories with their share of gross spending, and the rest as one."""
    positive = groups.where("amount > 0")
    order = Window.partitionBy(*BY).orderBy(F.col("amount").desc(), "category")
    named = positive.withColumn("rank", F.row_number().over(order)).withColumn("label", F.when(F.col("rank") <= most, F.col("category")).otherwise("All Others"))
    parts = named.groupBy(*BY, "label").agg(F.round(F.sum("amount"), 2).alias("amount"), F.min("rank").alias("position"))
    return parts.withColumn("share", F.col("amount") / F.sum("amount").over(Window.partitionBy(*BY)))


def categorized_share(groups: DataFrame, label: str) -> DataFrame:
    """1 less the uncategorised share of spending, within 0 and 1; null without spending."""
    sums = groups.groupBy(*BY).agg(F.sum("amount").alias("total"), F.sum(F.when(F.col("category") == label, F.col("amount")).otherwise(0.0)).alias("plain"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs("plain") / F.col("total")))
    return sums.select(*BY, F.when(F.col("total") > 0, share).alias("share"))


def teach_queue(rows: DataFrame, key: Column) -> DataFrame:
    """Per merchant key: counted and other rows, money in and out, and the latest counted money-out row (else the latest)."""
    v = with_verdicts(rows).withColumn("key", key).where("key != ''")
    out = v.groupBy(*BY, "key").agg(
        F.count_if("counted").alias("spend_count"), F.sum(F.when(F.col("counted"), F.col("amount")).otherwise(0)).alias("spent"), F.count_if(~F.col("counted")).alias("other_count"),
        F.sum(F.when(~F.col("counted") & (F.col("amount") < 0), -F.col("amount")).otherwise(0)).alias("money_in"), F.sum(F.when(~F.col("counted") & (F.col("amount") >= 0), F.col("amount")).otherwise(0)).alias("other_out"),
        F.max(F.when(F.col("counted") & (F.col("amount") > 0), F.struct("date", (-F.col("id")).alias("o"), "id"))).alias("a"), F.max(F.struct("date", (-F.col("id")).alias("o"), "id")).alias("b"),
    )
    return out.select(*BY, "key", "spend_count", amount(F.col("spent")).alias("spent"), "other_count", amount(F.col("money_in")).alias("money_in"), amount(F.col("other_out")).alias("other_out"), F.coalesce("a.id", "b.id").alias("example_id"))


def other_label(money_in: Column, money_out: Column) -> Column:
    """How much a merchant moved without spending."""
    dollars = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    both = [F.when(money_in > 0, F.concat(dollars(money_in), F.lit(" in"))), F.when(money_out > 0, F.concat(dollars(money_out), F.lit(" out")))]
    return F.coalesce(present(F.concat_ws(" / ", *both)), F.lit("no amount"))


def month_delta(overview: DataFrame, current: bool) -> DataFrame:
    """household_id and delta against the month before: up to the same day while the month still runs, where that is known; else all of it."""
    base = F.coalesce("last_to_date", "last_month") if current else F.col("last_month")
    return overview.select(*BY, F.round(F.col("spent") - base, 2).alias("delta"))
