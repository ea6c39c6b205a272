"""The ledger's scans: a household's or all households' tables with the joins every report needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matching import mark_internal

TRANSACTION = T.StructType([
    T.StructField("household_id", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("external_id", T.StringType()), T.StructField("account_id", T.LongType()), T.StructField("date", T.DateType()),
    T.StructField("amount", T.DecimalType(14, 2)), T.StructField("merchant_name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("mapped_category", T.StringType()), T.StructField("user_category", T.StringType()),
    T.StructField("user_description", T.StringType()), T.StructField("user_type", T.StringType()), T.StructField("excluded", T.BooleanType()), T.StructField("entity_id", T.LongType()), T.StructField("is_capital", T.BooleanType()),
    T.StructField("placed_in_service", T.DateType()), T.StructField("useful_life_years", T.IntegerType()), T.StructField("source", T.StringType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns and types of a schema; a missing column is null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


class Ledger:
    """Tables by name.  household: only that one's rows, as an equality filter that reaches the files; None: all households."""

    def __init__(self, tables: dict[str, DataFrame], household: int | None = None) -> None:
        self.tables, self.household = tables, household

    def __getitem__(self, name: str) -> DataFrame:
        df = self.tables[name]
        return df if self.household is None else df.where(F.col("household_id") == self.household)

    def visible(self, where: Column | None = None) -> DataFrame:
        """Transactions of accounts that aren't hidden, with the account's type and entity.  The accounts' side is broadcast if Spark finds it small."""
        accounts = self["accounts"].where(~F.coalesce("hidden", F.lit(False))).select("household_id", "account_id", F.col("type").alias("account_type"), F.col("entity_id").alias("account_entity"))
        rows = self["transactions"]
        return (rows if where is None else rows.where(where)).join(accounts, ["household_id", "account_id"])

    def between(self, start: str, end: str) -> DataFrame:
        """Visible transactions from start to end, both included."""
        return self.visible(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    def paired(self, start: str, end: str) -> DataFrame:
        """``between`` with internal transfers marked among exactly those rows."""
        return mark_internal(self.between(start, end))

    def two_months(self, month: str) -> DataFrame:
        """Visible rows of a month (its first day) and the one before, in one scan, each month paired on its own."""
        start = F.lit(month).cast("date")
        rows = self.visible((F.col("date") >= F.add_months(start, -1)) & (F.col("date") <= F.last_day(start)))
        return mark_internal(rows, F.trunc("date", "month"))

    def month(self, year: int, month: int, paired: bool = True) -> DataFrame:
        start = f"{year:04d}-{month:02d}-01"
        last = F.last_day(F.lit(start).cast("date"))
        rows = self.visible((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") <= last))
        return mark_internal(rows) if paired else rows
