"""Settings: values that hold JSON, read leniently, and changed as lists and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_list(value: Column) -> Column:
    """Distinct trimmed names of a JSON array of texts, in order; empty for anything else."""
    parsed = F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(parsed, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != "")))


def toggled(names: Column, key: Column, on: Column) -> Column:
    """``names`` with or without a key."""
    rest = F.array_remove(names, key)
    return F.when(on, F.when(F.array_contains(names, key), names).otherwise(F.concat(names, F.array(key)))).otherwise(rest)


def true_keys(value: Column) -> Column:
    """Sorted keys whose value is true in a JSON object; empty for anything else."""
    parsed = F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.array_sort(F.map_keys(F.map_filter(parsed, lambda _, v: v == "true")))


def bundle(settings: DataFrame, keys: list[str]) -> DataFrame:
    """A row per household with the values of some keys (household_id, key, value)."""
    return settings.where(F.col("key").isin(keys)).groupBy("household_id").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k.replace(":", "_")) for k in keys))


def put(settings: DataFrame, new: DataFrame) -> DataFrame:
    """``settings`` with the keys of ``new`` set; a null value deletes its key."""
    return settings.join(new, ["household_id", "key"], "left_anti").unionByName(new.where("value is not null").select(*settings.columns))


def month_value(settings: DataFrame, key: str, month: str) -> DataFrame:
    """A month's own value of a number (key:month), else the household's default (key)."""
    own, default = (F.max(F.when(F.col("key") == k, F.col("value").try_cast("double"))) for k in (f"{key}:{month}", key))
    return settings.groupBy("household_id").agg(F.coalesce(own, default).alias("amount"))


def merged(settings: DataFrame, edits: DataFrame) -> DataFrame:
    """``settings`` (household_id, key, value) after edits of several devices, none of which drops what another has changed.

    edits: household_id, key, seq (their order), op and item.  put: the whole value; clear: no value; add and remove: one name of a list (a JSON
    array of texts), with the others as they are.  Under ``VersionedTable.update`` the order is that of the commits.  A list's own names come first, then added ones
    in their order; a key without edits stays as it is, whatever it holds.
    """
    by = Window.partitionBy("household_id", "key")
    whole = F.max(F.when(F.col("op").isin("put", "clear"), F.struct("seq", F.when(F.col("op") == "put", F.col("item")).alias("value")))).over(by)
    told = edits.withColumn("whole", whole).where(F.col("whole").isNull() | (F.col("seq") >= F.col("whole.seq")))
    last = told.groupBy("household_id", "key", "whole", "item", F.col("op").isin("add", "remove").alias("listed")).agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    names = lambda op: F.transform(F.array_sort(F.collect_list(F.when(F.col("listed") & (F.col("op") == op), F.struct("seq", "item")))), lambda n: n["item"])
    net = last.groupBy("household_id", "key").agg(F.first("whole").alias("whole"), F.max("listed").alias("listed"), names("add").alias("more"), names("remove").alias("fewer"))
    both = settings.withColumn("held", F.lit(True)).join(net.withColumn("edited", F.lit(True)), ["household_id", "key"], "full_outer")
    base = F.when(F.col("whole").isNotNull(), F.col("whole.value")).otherwise(F.col("value"))
    kept = F.array_except(name_list(base), F.col("fewer"))
    value = F.when(F.col("edited").isNull(), F.col("value")).when(F.col("listed"), F.to_json(F.concat(kept, F.array_except(F.col("more"), kept)))).otherwise(base)
    return both.select("household_id", "key", value.alias("value"), "edited").where("edited is null or value is not null").drop("edited")
