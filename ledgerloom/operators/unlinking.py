"""Removing a bank: hidden with a record of what was visible, restored from that record, or deleted for good with all that hangs on it.

Tables by name: institutions (household_id, institution_id, org_id, status), accounts (household_id, account_id, institution_id, hidden), settings
(household_id, key, value), and those of the accounts' rows (transactions, snapshots), which have household_id and account_id.  asked:
household_id and institution_id of the banks; asking twice is asking once, and a bank that isn't the household's is ignored.  A bank of the feed has an
org_id and becomes a disabled tombstone, so that the next pull doesn't bring it back; one made by hand has none, and its status is left
alone: there the record is the mark.  Each returns the tables that it changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANK = ["household_id", "institution_id"]
RECORD = "unlink:"
CONFIRM = "delete"
#: Tables whose rows go with their account.
OF_ACCOUNTS = ("transactions", "snapshots")


def record_key(institution: Column) -> Column:
    return F.concat(F.lit(RECORD), institution.cast("string"))


def _known(tables: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    """The asked banks that there are, with org_id."""
    return tables["institutions"].select(*BANK, "org_id").join(asked.select(*BANK).distinct(), BANK, "left_semi")


def _records(tables: dict[str, DataFrame], banks: DataFrame) -> DataFrame:
    """Banks with ids: the recorded accounts, null without a record; what isn't a JSON array of texts or numbers is an empty record."""
    value = F.coalesce(F.from_json("value", "array<string>"), F.array().cast("array<string>"))
    held = tables["settings"].where(F.col("key").startswith(RECORD)).select("household_id", F.col("key").alias("_key"), value.alias("ids"))
    return banks.withColumn("_key", record_key(F.col("institution_id"))).join(held, ["household_id", "_key"], "left").drop("_key")


def _disabled(tables: dict[str, DataFrame], banks: DataFrame, status: str) -> DataFrame:
    """Institutions with the status of the feed's banks among ``banks`` set."""
    institutions = tables["institutions"]
    hit = banks.where("org_id is not null").select(*BANK, F.lit(True).alias("_hit"))
    return institutions.join(hit, BANK, "left").select(*(F.when(F.col("_hit"), status).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in institutions.columns))


def unlink(tables: dict[str, DataFrame], asked: DataFrame) -> dict[str, DataFrame]:
    """accounts, settings and institutions after hiding the banks' accounts.

    The first record wins: a second removal finds everything hidden, and would else record that there is nothing to restore.  Rows aren't touched.
    """
    banks, accounts, settings = _known(tables, asked), tables["accounts"], tables["settings"]
    mine = accounts.join(banks.select(*BANK), BANK, "left_semi")
    visible = mine.where(~F.coalesce("hidden", F.lit(False))).groupBy(*BANK).agg(F.to_json(F.transform(F.array_sort(F.collect_list("account_id")), lambda i: i.cast("string"))).alias("value"))  # a bank's accounts
    fresh = _records(tables, banks).where("ids is null").join(visible, BANK, "left")
    new = fresh.select("household_id", record_key(F.col("institution_id")).alias("key"), F.coalesce("value", F.lit("[]")).alias("value"))
    hide = accounts.join(banks.select(*BANK, F.lit(True).alias("_hit")), BANK, "left")
    return {
        "accounts": hide.select(*(F.when(F.col("_hit"), True).otherwise(F.col(c)).alias(c) if c == "hidden" else F.col(c) for c in accounts.columns)),
        "settings": settings.unionByName(new.select(*settings.columns)), "institutions": _disabled(tables, banks, "disabled"),
    }


def restore(tables: dict[str, DataFrame], asked: DataFrame) -> dict[str, DataFrame]:
    """accounts, settings and institutions after showing again what the removal hid, and counts: household_id, institution_id and unhidden.

    Only recorded accounts that are still the bank's and hidden are shown; the record is used up either way.
    """
    banks, accounts, settings = _known(tables, asked), tables["accounts"], tables["settings"]
    ids = _records(tables, banks).where("ids is not null").select(*BANK, F.explode("ids").alias("_id")).distinct()
    both = accounts.withColumn("_id", F.col("account_id").cast("string")).join(ids.withColumn("_hit", F.lit(True)), [*BANK, "_id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)) & F.coalesce("hidden", F.lit(False)))
    used = banks.select("household_id", record_key(F.col("institution_id")).alias("key"))
    return {
        "accounts": both.select(*(F.when(F.col("_hit"), False).otherwise(F.col(c)).alias(c) if c == "hidden" else F.col(c) for c in accounts.columns)),
        "settings": settings.join(used, ["household_id", "key"], "left_anti"), "institutions": _disabled(tables, banks, "active"),
        "counts": banks.select(*BANK).join(both.where("_hit").groupBy(*BANK).agg(F.count("*").alias("unhidden")), BANK, "left").select(*BANK, F.coalesce("unhidden", F.lit(0)).alias("unhidden")),
    }


def delete(tables: dict[str, DataFrame], asked: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting banks for good, and outcome: household_id, institution_id and what was done (deleted or why not).

    asked has permanent and confirm as well: only true with the very word deletes.  A bank with an empty org_id is of no known kind and is
    refused.  With a bank go its accounts, their rows and its record; a feed's bank stays as a tombstone.
    """
    sure = F.coalesce((F.col("permanent")) & (F.col("confirm") == CONFIRM), F.lit(False))
    wanted = asked.groupBy(*BANK).agg(F.max(sure).alias("sure"))
    known = wanted.join(tables["institutions"].select(*BANK, "org_id", F.lit(True).alias("_known")), BANK, "left")
    done = F.when(F.col("_known").isNull(), "not found").when(~F.col("sure"), "not confirmed").when(F.col("org_id") == "", "unknown kind").otherwise("deleted")
    known = known.withColumn("outcome", done)
    banks = known.where("outcome = 'deleted'").select(*BANK, "org_id")
    gone = tables["accounts"].join(banks.select(*BANK), BANK, "left_semi").select("household_id", "account_id")
    used = banks.select("household_id", record_key(F.col("institution_id")).alias("key"))
    by_hand = banks.where("org_id is null").select(*BANK)
    return {
        "institutions": _disabled(tables, banks, "disabled").join(by_hand, BANK, "left_anti"), "accounts": tables["accounts"].join(banks.select(*BANK), BANK, "left_anti"),
        "settings": tables["settings"].join(used, ["household_id", "key"], "left_anti"), **{t: tables[t].join(gone, ["household_id", "account_id"], "left_anti") for t in OF_ACCOUNTS if t in tables}, "outcome": known.select(*BANK, "outcome"),
    }
