"""The list of categories as it is shown: nested one level deep, in order; and which category may be part of which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import amount
from ..functions.text import present
from .rules import registry_tree
from .verdicts import MECHANISMS

BY = ["household_id"]
# Fixed texts: why a category can't be filed under another.
MANAGED, ITSELF = "That category is managed by the app.", "A category can't be part of itself."
NESTED, PARENT = " is already part of another category — only one level of nesting.", " has subcategories of its own — only one level of nesting."


def is_user(name: Column) -> Column:
    return present(F.trim(name)).isNotNull() & ~F.trim(name).isin(MECHANISMS)


def shown(groups: DataFrame, names: DataFrame, tree: DataFrame) -> DataFrame:
    """Every category of a month with place, the place of its group, and the group's sums.

    groups: household_id, category, amount, transaction_count; names (household_id, category) without spending are added with zeros.
    A group is a category with those that are part of it; it stands by the sum that it shows, the largest first, and of equal sums by
    where its own row stands among the largest categories and then the added ones.  Its own row leads it, the others follow by name.
    """
    fresh = names.select(*BY, "category").distinct().join(groups.select(*BY, "category"), [*BY, "category"], "left_anti")
    money = F.col("amount").cast("decimal(18,2)")
    rows = groups.select(*BY, "category", money.alias("amount"), "transaction_count", F.lit(0).alias("added")).unionByName(
        fresh.select(*BY, "category", F.lit(0).cast("decimal(18,2)").alias("amount"), F.lit(0).cast("long").alias("transaction_count"), F.lit(1).alias("added"))
    )
    listed = F.row_number().over(Window.partitionBy(*BY).orderBy("added", F.col("amount").desc(), "category"))
    held = rows.select(*BY, F.col("category").alias("parent")).withColumn("there", F.lit(True))
    claims = tree.where("parent is not null").select(*BY, F.col("name").alias("category"), "parent").join(held, [*BY, "parent"])
    placed = rows.withColumn("listed", listed).join(claims, [*BY, "category"], "left").withColumn("group", F.coalesce("parent", "category")).withColumn("own", F.col("parent").isNull())
    whole = Window.partitionBy(*BY, "group")
    summed = placed.withColumn("rolled", F.sum("amount").over(whole)).withColumn("rolled_count", F.sum("transaction_count").over(whole)).withColumn("first", F.max(F.when(F.col("own"), F.col("listed"))).over(whole))
    order = Window.partitionBy(*BY).orderBy(F.col("rolled").desc(), "first")
    inner = Window.partitionBy(*BY, "group").orderBy(F.col("own").desc(), F.lower("category"), "category")
    return summed.select(
        *BY, "category", "group", amount(F.col("amount")).alias("amount"), "transaction_count", amount(F.col("rolled")).alias("group_amount"), F.col("rolled_count").alias("group_count"),
        F.dense_rank().over(order).alias("group_place"), (F.row_number().over(inner) - 1).alias("place"),
    )


def earliest(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """household_id, group and rank: the earliest place in a list (household_id, category, rank) of any category of each group of ``shown`` rows."""
    return rows.select(*BY, "category", "group").join(ranks, [*BY, "category"], "left").groupBy(*BY, "group").agg(F.min("rank").alias("rank"))


def filing(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (household_id, child, parent) with reason, null where the child may be filed under the parent; no parent takes it out, which always may be."""
    tree = registry_tree(registry).where("parent is not null")
    nested, parents = tree.select(*BY, F.col("name").alias("parent"), F.lit(True).alias("_nested")), tree.select(*BY, F.col("parent").alias("child"), F.lit(True).alias("_holds")).distinct()
    both = wanted.join(nested, [*BY, "parent"], "left").join(parents, [*BY, "child"], "left")
    to = present(F.col("parent"))
    reason = (
        F.when(~F.coalesce(is_user(F.col("child")), F.lit(False)), MANAGED).when(to.isNull(), None).when(~is_user(F.col("parent")), MANAGED).when(F.col("child") == F.col("parent"), ITSELF)
        .when(F.col("_nested"), F.concat("parent", F.lit(NESTED))).when(F.col("_holds"), F.concat("child", F.lit(PARENT)))
    )
    return both.select(*wanted.columns, reason.alias("reason"))


def filed(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """``registry`` after ``wanted`` (household_id, child, parent; one for a child): each entry of the child's name gets the parent, or none."""
    new = wanted.select(*BY, F.trim("child").alias("_child"), present(F.trim(F.coalesce("parent", F.lit("")))).alias("_parent"), F.lit(True).alias("_set"))
    both = registry.withColumn("_child", F.trim(F.coalesce("name", F.lit("")))).join(new, [*BY, "_child"], "left")
    return both.select(*(F.when(F.col("_set"), F.col("_parent")).otherwise(F.col(c)).alias(c) if c == "parent" else F.col(c) for c in registry.columns))
