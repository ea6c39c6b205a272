"""One job from a stream of feed envelopes to all tables of the ledger: banks, accounts, snapshots, transactions and pull state.

A batch is planned whole before anything is touched: what it makes of each table's touched partitions is written aside, and a marker says that the
plan is complete.  Then each table's partitions are replaced by the plan's.  A batch that is run again, after a failure between two
tables or in the midst of one, finds its plan and only puts it in place again; one that was recorded as done does nothing.

Partitions are dealt by household (transactions and snapshots: by month and account), so that a small batch rewrites few files.  A
transaction's month may change when it is amended: a table of keys, dealt by account, says which month holds it, so no batch reads
more of the transactions than the months and accounts that it changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.storage import Files, VersionedTable, held
from ..operators import pulls
from ..sources.feed import parsed

#: An answer of the feed: of which household and access, when it was pulled, and whether it is a new account's history.
ENVELOPES = "household_id int, access_url string, pulled_at timestamp, backfill boolean, json string"
ACCESS = "household_id int, access_url string, last_pulled_at timestamp, last_attempt_at timestamp, last_error string"
RULES = "household_id int, merchant_key string, category string, amount decimal(14,2)"
#: Columns of each table, its key, and what a pull may overwrite; all else is the user's.
TABLES = {
    "institutions": ("household_id int, org_key string, institution_id long, disabled boolean, last_pulled_on date", ["household_id", "org_key"], ["institution_id", "last_pulled_on"]),
    "accounts": (
        "household_id int, account_id long, external_id string, institution_id long, name string, currency string, type string, subtype string, current_balance decimal(14,2), balance_on date, hidden boolean, nickname string",
        ["household_id", "account_id"], ["external_id", "institution_id", "name", "currency", "current_balance", "balance_on"],
    ),
    "snapshots": ("household_id int, account_id long, captured_on date, balance decimal(14,2)", ["household_id", "account_id", "captured_on"], ["balance"]),
    "transactions": (
        "household_id int, account_id long, external_id string, id long, date date, amount decimal(14,2), merchant_name string, description string, raw_category string, mapped_category string, pending boolean, pulled_on date, source string, user_category string, user_type string, user_description string, excluded boolean",
        ["household_id", "account_id", "external_id"], ["id", "date", "amount", "merchant_name", "description", "raw_category", "mapped_category", "pending", "pulled_on", "source"],
    ),
    "transaction_keys": ("household_id int, account_id long, external_id string, held_in string", ["household_id", "account_id", "external_id"], ["held_in"]),
}
#: What a table's new rows start with, where the pull says nothing of it.
STARTS = {"accounts": {"hidden": "true"}, "transactions": {"excluded": "false"}, "institutions": {"disabled": "false"}}
BUCKETS = 64


def read_envelopes(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    return spark.readStream.schema(ENVELOPES).option("maxFilesPerTrigger", files_per_batch).json(folder)


class Ingest:
    """The tables in a folder, and the batches that change them."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets, self.files = spark, folder.rstrip("/"), buckets, Files(spark, folder)
        self.access = VersionedTable(spark, f"{self.folder}/access", ACCESS)

    def schema(self, table: str) -> StructType:
        return StructType.fromDDL(TABLES[table][0] + ", part string")

    def table(self, table: str, parts: list[str] | None = None) -> DataFrame:
        """A table as it is now, or only some of its partitions."""
        if not self.files.exists(table):
            return self.spark.createDataFrame([], self.schema(table))
        rows = self.spark.read.schema(self.schema(table)).parquet(f"{self.folder}/{table}")
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    def rules(self) -> DataFrame:
        return self.spark.read.schema(RULES).parquet(f"{self.folder}/rules") if self.files.exists("rules") else self.spark.createDataFrame([], RULES)

    def part(self, table: str) -> Column:
        by = lambda *c: F.format_string("b%03d", F.pmod(F.xxhash64(*c), F.lit(self.buckets)))
        if table in ("institutions", "accounts"):
            return by("household_id")
        if table == "transaction_keys":
            return by("household_id", "account_id")
        return F.concat_ws("_", F.date_format("date" if table == "transactions" else "captured_on", "yyyy-MM"), by("household_id", "account_id"))

    def batch(self, envelopes: DataFrame, number: int) -> None:
        """Take in one batch; the same number again changes nothing that it hasn't changed."""
        plan = f"_plans/{number}"
        if self.files.exists(f"_batches/{number}"):
            return
        if not self.files.exists(f"{plan}/ready"):
            self.files.delete(plan)
            counts = self._plan(envelopes, plan)
            self.files.create(f"{plan}/ready", counts)
        counts = self.files.read(f"{plan}/ready")
        for table in TABLES:
            if counts["tables"].get(table):
                self.publish(table, plan)
        self._remember(plan, counts["now"])
        self.files.create(f"_batches/{number}", counts)
        self.files.delete(plan)

    # ---- planning -----------------------------------------------------------------------------------------------

    def _plan(self, envelopes: DataFrame, plan: str) -> dict:
        feeds = held(parsed(envelopes.withColumn("backfill", F.coalesce("backfill", F.lit(False)))))
        now = feeds.agg(F.max("pulled_at").cast("string")).first()[0]
        counts: dict = {"now": now, "tables": {}}
        if now is None:
            return counts
        pulls.outcomes(feeds).write.mode("overwrite").parquet(f"{self.folder}/{plan}/outcomes")
        homes = self._parts(feeds.select("household_id"), "accounts")
        state = {"institutions": self.table("institutions", homes), "accounts": self.table("accounts", homes), "rules": self.rules()}
        new = pulls.changes(state, feeds, now)
        new["transactions"] = held(new["transactions"])
        keys = held(new["transactions"].select("household_id", "account_id", "external_id", self.part("transactions").alias("held_in")))
        before = keys.join(self.table("transaction_keys", self._parts(keys, "transaction_keys")).select(*TABLES["transaction_keys"][1], F.col("held_in").alias("was")), TABLES["transaction_keys"][1], "left")
        moved = [r[0] for r in before.select("was").where("was is not null").distinct().collect()]  # as many as months and buckets
        for table in ("institutions", "accounts", "snapshots"):
            counts["tables"][table] = self._merged(table, new[table], plan)
        counts["tables"]["transactions"] = self._merged("transactions", new["transactions"], plan, moved)
        counts["tables"]["transaction_keys"] = self._merged("transaction_keys", keys, plan)
        return counts

    def _parts(self, rows: DataFrame, table: str) -> list[str]:
        """The partitions that some rows belong to: at most the buckets, times the months that there are."""
        return sorted(r[0] for r in rows.select(self.part(table).alias("part")).distinct().collect())

    def _merged(self, table: str, new: DataFrame, plan: str, more: list[str] = ()) -> dict:
        """Write what the touched partitions become, and count in the same pass what is inserted, changed and kept."""
        schema, keys, sent = TABLES[table]
        names = [f.name for f in StructType.fromDDL(schema)]
        new = held(new)
        touched = sorted({*self._parts(new, table), *more})
        if not touched:
            return {}
        fresh = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in names if c not in keys and c in new.columns), F.lit(True).alias("_new"))
        both = self.table(table, touched).drop("part").withColumn("_held", F.lit(True)).join(fresh, keys, "full_outer")
        starts = STARTS.get(table, {})

        def value(c: str) -> Column:
            arriving = F.col(f"_{c}") if f"_{c}" in fresh.columns else F.expr(starts.get(c, "null"))
            if c in sent:
                return F.when(F.col("_new"), arriving).otherwise(F.col(c)).alias(c)
            return F.when(F.col("_held").isNull(), arriving).otherwise(F.col(c)).alias(c)

        differs = F.lit(False)
        for c in (c for c in sent if c not in ("pulled_on", "last_pulled_on") and f"_{c}" in fresh.columns):
            differs = differs | ~F.col(f"_{c}").eqNullSafe(F.col(c))
        both = both.select(*keys, *(value(c) for c in names if c not in keys), F.col("_held").isNull().alias("_inserted"), (F.col("_held") & F.col("_new") & differs).alias("_changed"))
        seen = Observation(f"{table}_{plan.rpartition('/')[2]}")
        out = both.observe(seen, F.count_if("_inserted").alias("inserted"), F.count_if("_changed").alias("changed"), F.count("*").alias("rows"))
        out.select(*names, self.part(table).alias("part")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{plan}/{table}")
        return {**seen.get, "touched": touched}

    # ---- putting in place ---------------------------------------------------------------------------------------

    def publish(self, table: str, plan: str) -> None:
        """Replace the touched partitions of a table by the plan's."""
        rows = self.spark.read.schema(self.schema(table)).parquet(f"{self.folder}/{plan}/{table}")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.folder}/{table}")
        there = {n.removeprefix("part=") for n in self.files.names(f"{plan}/{table}")}
        for gone in set(self.files.read(f"{plan}/ready")["tables"][table]["touched"]) - there:  # all its rows have moved to other months
            self.files.delete(f"{table}/part={gone}")

    def _remember(self, plan: str, now: str | None) -> None:
        if now is None:
            return
        told = self.spark.read.parquet(f"{self.folder}/{plan}/outcomes")

        def change(access: DataFrame) -> DataFrame:
            fresh = told.select("household_id", "access_url").join(access, ["household_id", "access_url"], "left_anti")
            rows = access.unionByName(fresh, allowMissingColumns=True)
            return pulls.watermarks(rows, told, now)

        self.access.update(change)


def start(envelopes: DataFrame, job: Ingest, checkpoint: str) -> StreamingQuery:
    """Take in what there is now, each batch exactly once, and stop."""
    return envelopes.writeStream.foreachBatch(lambda batch, number: job.batch(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def begin(job: Ingest, now: str, force: bool = False) -> DataFrame:
    """household_id and access_url of the accesses that this device may ask now: stamped as attempts first, so that no other device asks too."""
    version, access = job.access.read()
    stamped = held(pulls.attempts(access, now, force))
    if not job.access.commit(version, stamped):  # another device was first: only what it has left is due
        return begin(job, now, force)
    return stamped.where("not throttled").select("household_id", "access_url")
