"""Tax worksheets: rental lines, entity totals, deductions, mileage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import amount, cents
from ..functions.tables import literal_rows
from ..functions.text import csv_cell

BY = ["household_id", "entity_id"]
# Expense lines of the rental form, deduction buckets, and mileage rates by first date.
LINES = {
    5: "Advertising", 6: "Auto and travel", 7: "Cleaning and maintenance", 8: "Commissions", 9: "Insurance", 10: "Legal and other professional fees", 11: "Management fees",
    12: "Mortgage interest (paid to banks)", 13: "Other interest", 14: "Repairs", 15: "Supplies", 16: "Taxes", 17: "Utilities", 19: "Other",
}
BUCKETS = {"charitable": "Charitable giving", "medical": "Medical and dental", "taxes_paid": "Taxes paid (property, etc.)"}
RATES = [("2024-01-01", 0.67), ("2025-01-01", 0.70), ("2026-01-01", 0.725), ("2026-07-01", 0.76)]


def routed(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``rows`` that count, with where each goes: capital, rents, line, defaulted (rents by default) or unmapped.  mapping: category, target (a line's number or rents)."""
    live = rows.where(~F.coalesce("excluded", F.lit(False)) & (F.coalesce("amount", F.lit(0)) != 0)).join(mapping, "category", "left")
    line = F.col("target").try_cast("int")
    route = F.when(F.coalesce("is_capital", F.lit(False)), "capital").when(F.col("target") == "rents", "rents").when(line.isin(list(LINES)), "line").when(F.col("amount") < 0, "defaulted").otherwise("unmapped")
    return live.withColumn("route", route).withColumn("line", F.when(route == "line", line))


def schedule_lines(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """All lines of each entity with their totals, 0 where nothing is."""
    sums = routed(rows, mapping).where("route = 'line'").groupBy(*BY, "line").agg(F.sum("amount").alias("total"))
    full = rows.select(*BY).distinct().select(*BY, F.inline(literal_rows(list(LINES.items()), ["line", "label"], ["int", "string"])))
    keys = [full[c].eqNullSafe(sums[c]) for c in BY] + [full["line"] == sums["line"]]
    return full.join(sums, keys, "left").select(full["household_id"], full["entity_id"], full["line"], "label", amount(F.coalesce("total", F.lit(0))).alias("total"))


def schedule_summary(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rents, expenses, unmapped and capital per entity; parts are rounded before they are summed, and net is rents less expenses."""
    r = routed(rows, mapping)
    part = lambda *routes: F.col("route").isin(*routes)
    out = r.groupBy(*BY).agg(
        F.sum(F.when(part("rents", "defaulted"), -F.col("amount")).otherwise(0)).alias("rents"), F.count_if(part("rents", "defaulted")).alias("rents_count"), F.sum(F.when(part("defaulted"), -F.col("amount")).otherwise(0)).alias("defaulted"),
        F.count_if(part("defaulted")).alias("defaulted_count"), F.sum(F.when(part("line"), F.col("amount")).otherwise(0)).alias("expenses"), F.sum(F.when(part("unmapped"), F.col("amount")).otherwise(0)).alias("unmapped"), F.sum(F.when(part("capital"), F.col("amount")).otherwise(0)).alias("capital"),
    )
    money = ("rents", "defaulted", "expenses", "unmapped", "capital")
    return out.select(*BY, *(amount(F.col(c)).alias(c) for c in money), "rents_count", "defaulted_count", amount(F.col("rents") - F.col("expenses")).alias("net"))


def unmapped(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Money out in categories that no line takes; never dropped."""
    return routed(rows, mapping).where("route = 'unmapped'").groupBy(*BY, "category").agg(amount(F.sum("amount")).alias("total"), F.count("*").alias("count"))


def monthly(rows: DataFrame) -> DataFrame:
    live = rows.where(~F.coalesce("excluded", F.lit(False)) & (F.coalesce("amount", F.lit(0)) != 0) & F.col("transaction_date").isNotNull())
    return live.groupBy(*BY, F.date_format("transaction_date", "yyyy-MM").alias("ym")).agg(
        amount(F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0))).alias("income"), amount(F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0))).alias("expenses"), amount(F.sum(-F.col("amount"))).alias("net")
    )


def ledger(rows: DataFrame) -> DataFrame:
    """Every row with its section (in, out, not counted) and its place there, newest first."""
    barred = F.coalesce("excluded", F.lit(False)) | (F.coalesce("amount", F.lit(0)) == 0)
    section = F.when(barred, "not_counted").when(F.col("amount") < 0, "in").otherwise("out")
    order = Window.partitionBy(*BY, "section").orderBy(F.col("transaction_date").desc(), F.col("id").cast("string"))
    return rows.withColumn("section", section).select(*BY, "section", "id", "transaction_date", amount(F.col("amount")).alias("amount"), F.row_number().over(order).alias("position"))


def deductions(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each household's three buckets; refunds net.  mapping: category, bucket."""
    live = rows.where(~F.coalesce("excluded", F.lit(False)) & (F.coalesce("amount", F.lit(0)) != 0)).join(mapping, "category")
    sums = live.groupBy("household_id", "bucket").agg(F.sum("amount").alias("total"), F.count("*").alias("count"))
    full = rows.select("household_id").distinct().select("household_id", F.inline(literal_rows(list(BUCKETS.items()), ["bucket", "label"], ["string", "string"])))
    return full.join(sums, ["household_id", "bucket"], "left").select("household_id", "bucket", "label", amount(F.coalesce("total", F.lit(0))).alias("total"), F.coalesce("count", F.lit(0)).alias("count"))


def rate_table(spark: SparkSession) -> DataFrame:
    starts = [r[0] for r in RATES]
    rows = [(a, b, r) for (a, r), b in zip(RATES, [*starts[1:], None], strict=True)]
    return spark.createDataFrame(rows, "first string, after string, rate double").select(F.to_date("first").alias("first"), F.to_date("after").alias("after"), "rate")


def mileage(log: DataFrame) -> DataFrame:
    """Miles and deduction per rate; a null rate holds miles from before the first one.  log: household_id, on_date, miles.

    A date's rate is the latest that has begun, by a range join with the four rates.
    """
    rated = log.where("miles > 0").join(F.broadcast(rate_table(log.sparkSession)), (F.col("on_date") >= F.col("first")) & (F.col("after").isNull() | (F.col("on_date") < F.col("after"))), "left")
    return rated.groupBy("household_id", "rate").agg(amount(F.sum("miles")).alias("miles"), cents(amount(F.sum("miles")) * F.col("rate")).alias("amount"))


def mileage_total(log: DataFrame) -> DataFrame:
    """The household's deduction: the sum of the rates' rounded amounts; and its unrated miles."""
    return mileage(log).groupBy("household_id").agg(
        F.coalesce(F.round(F.sum(F.when(F.col("rate").isNotNull(), F.col("miles"))), 2), F.lit(0.0)).alias("miles"), F.coalesce(F.round(F.sum("amount"), 2), F.lit(0.0)).alias("amount"), F.coalesce(F.round(F.sum(F.when(F.col("rate").isNull(), F.col("miles"))), 2), F.lit(0.0)).alias("unrated_miles")
    )


def schedule_csv(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """A CSV line per entity and form line, in order."""
    lines = schedule_lines(rows, mapping)
    cells = [csv_cell(F.col(c)) for c in ("entity_id", "line", "label")] + [F.format_string("%.2f", "total")]
    return lines.select("household_id", "entity_id", "line", F.concat_ws(",", *cells).alias("csv"))
