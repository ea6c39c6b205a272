"""Categories by wording and by taught rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CARD_ISSUER, CARD_WORD, PAYMENT_WORD, STANDALONE_PAYMENT, TRANSFER, matches, merchant_key, present
from .verdicts import TRANSFER_CATEGORY, UNCATEGORIZED

BY = ["household_id"]


def raw_category(description: Column, amount: Column, account_type: Column) -> Column:
    """TRANSFER_OUT or TRANSFER_IN for a worded transfer that is no card's, else empty."""
    purchase = F.coalesce((account_type == "credit") & (amount > 0), F.lit(False))
    wanted = ~purchase & ~matches(description, CARD_WORD) & matches(description, TRANSFER)
    return F.when(wanted & (amount > 0), "TRANSFER_OUT").when(wanted & (amount < 0), "TRANSFER_IN").otherwise("")


def guarded(description: Column, amount: Column, account_type: Column) -> Column:
    """Whether the wording makes it a transfer or a payment to a card, whatever rules say; never a purchase on a card."""
    purchase = F.coalesce((account_type == "credit") & (amount > 0), F.lit(False))
    payment = matches(description, STANDALONE_PAYMENT) | (matches(description, CARD_ISSUER) & matches(description, PAYMENT_WORD))
    return ~purchase & (matches(description, TRANSFER) | payment)


def learned(rows: DataFrame, rules: DataFrame, text: str = "description", key: str = "id") -> DataFrame:
    """household_id, key, learned (the category of the best rule for each row that has one), rule_key and rule_amount.

    rules: household_id, merchant_key, category, amount (null: any).  A rule's key must be a prefix of the row's key by
    whole tokens: the row's prefixes (a handful) are exploded and meet the rules by equality.  Rules for an amount win
    over those for any, then the longest key.
    """
    keyed = rows.select(*BY, key, F.col("amount").alias("row_amount"), merchant_key(F.col(text)).alias("full")).where("full != ''")
    tokens = F.split("full", " ")
    prefixes = keyed.select(*BY, key, "row_amount", F.explode(F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, 1, n), " "))).alias("merchant_key"))
    same = F.col("amount").isNull() | (F.round(F.col("amount") * 100) == F.round(F.col("row_amount") * 100))
    hits = prefixes.join(rules.select(*BY, "merchant_key", "category", "amount"), [*BY, "merchant_key"]).where(same)
    best = F.struct(F.col("amount").isNotNull().cast("int"), F.length("merchant_key"), "category")
    won = hits.groupBy(*BY, key).agg(F.max_by(F.struct("category", "merchant_key", "amount"), best).alias("won"))
    return won.select(*BY, key, F.col("won.category").alias("learned"), F.col("won.merchant_key").alias("rule_key"), F.col("won.amount").alias("rule_amount"))


def classify(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with raw_category and mapped_category: wording first, then rules, then Uncategorized."""
    kind = F.col("account_type") if "account_type" in rows.columns else F.lit(None).cast("string")
    d, a = F.col("description"), F.col("amount")
    found = rows.drop("raw_category", "mapped_category").join(learned(rows, rules).select(*BY, "id", "learned"), [*BY, "id"], "left")
    mapped = F.when(guarded(d, a, kind), TRANSFER_CATEGORY).otherwise(F.coalesce("learned", F.lit(UNCATEGORIZED)))
    return found.select("*", raw_category(d, a, kind).alias("raw_category"), mapped.alias("mapped_category")).drop("learned")


def rule_matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule the rows that it decides, hidden accounts included, and how many of them have another category."""
    hits = learned(rows, rules).join(rows.select("id", *BY, "mapped_category", "user_category", "description", "amount", "account_type"), [*BY, "id"])
    hits = hits.where(~guarded(F.col("description"), F.col("amount"), F.col("account_type")) & present(F.col("user_category")).isNull())
    return hits.groupBy(*BY, F.col("rule_key").alias("merchant_key"), F.col("rule_amount").alias("amount"), F.col("learned").alias("category")).agg(F.count("*").alias("matched"), F.count_if(F.col("learned") != F.coalesce("mapped_category", F.lit(""))).alias("changed"))


def apply_to_history(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with mapped_category from the rules where one matches, hidden accounts included; users' own categories stay as they are."""
    found = rows.join(learned(rows, rules).select(*BY, "id", "learned"), [*BY, "id"], "left")
    take = F.col("learned").isNotNull() & ~guarded(F.col("description"), F.col("amount"), F.col("account_type"))
    return found.withColumn("mapped_category", F.when(take, F.col("learned")).otherwise(F.col("mapped_category"))).drop("learned")


def set_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """``rules`` with each slot (household, key, amount or none) of ``new`` replaced; a null category deletes the slot."""
    slot = [rules[c].eqNullSafe(new[c]) for c in (*BY, "merchant_key", "amount")]
    return rules.join(new, slot, "left_anti").unionByName(new.where("category is not null").select(*rules.columns))


def registry_tree(registry: DataFrame) -> DataFrame:
    """name and parent of each category of a registry (household_id, position, name, parent), one level deep.

    Mechanism categories, unknown parents and own parents don't count; of several claims the first wins; a parent that is
    itself part of another category is no parent.
    """
    from .verdicts import MECHANISMS

    trimmed = registry.select(*BY, "position", F.trim("name").alias("name"), present(F.trim(F.coalesce("parent", F.lit("")))).alias("parent")).where((F.col("name") != "") & ~F.col("name").isin(MECHANISMS))
    names = trimmed.select(*BY, F.col("name").alias("parent")).distinct()
    claims = trimmed.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("name"))).join(names, [*BY, "parent"])
    first = F.row_number().over(Window.partitionBy(*BY, "name").orderBy("position"))
    claims = claims.withColumn("n", first).where("n = 1").select(*BY, "name", "parent")
    nested = claims.select(*BY, F.col("name").alias("parent"))
    legal = claims.join(nested, [*BY, "parent"], "left_anti")
    return trimmed.select(*BY, "name").distinct().join(legal, [*BY, "name"], "left")


def rollup(rows: DataFrame, tree: DataFrame, value: str = "amount") -> DataFrame:
    """Sums of each top category with those of its children.  rows: household_id, category, value."""
    placed = rows.join(tree.withColumnRenamed("name", "category"), [*BY, "category"], "left").withColumn("group", F.coalesce("parent", "category"))
    return placed.groupBy(*BY, "group").agg(F.round(F.sum(value), 2).alias(value), F.count("*").alias("members"))
