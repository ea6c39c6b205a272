"""Every query of the ledger engine by name (inventory id first), and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import amount
from ..functions.text import merchant_key
from ..operators import balances, envelopes, importing, recurring, rules, spending, tax, verdicts
from ..operators.matching import internal_ids
from ..sources.ledger import Ledger
from . import contexts, edits, fixture, intake, more, oracles, pulls, statements, unlinks, views

MONTH, START, END = (1995, 6), "1995-01-01", "1995-06-30"
TAX_YEAR = ("1996-01-01", "1996-12-31")
VIEW = "1996-06-01"


def ledger(spark: SparkSession, sf: str) -> Ledger:
    return Ledger({n: fixture.load(spark, sf, n) for n in ("accounts", "transactions", "snapshots")})


def _tax_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf).paired(*TAX_YEAR)
    shaped = verdicts.shape(rows).drop("entity_id")
    entity = rows.select("household_id", "id", F.coalesce("entity_id", "account_entity").alias("entity_id"))
    return shaped.join(entity, ["household_id", "id"])


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("URGENT", "14"), ("HIGH", "17"), ("Groceries", "19"), ("MEDIUM", "rents"), ("LOW", "18")], "category string, target string")


def _buckets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("URGENT", "medical"), ("HIGH", "charitable"), ("LOW", "nothing")], "category string, bucket string")


def _walk(spark: SparkSession, sf: str) -> DataFrame:
    return envelopes.walk(*(fixture.load(spark, sf, n) for n in ("assignments", "envelope_spending", "settings")), VIEW)


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    return spending.cash_flow(ledger(spark, sf).paired(START, END), START, 6)


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return spending.spending_groups(ledger(spark, sf).month(*MONTH))


def _built(spark: SparkSession, sf: str) -> DataFrame:
    cells = fixture.load(spark, sf, "cells")
    overlap = cells.select("household_id", "account_id").distinct().where("account_id % 3 = 0").withColumn("overlap_from", F.lit("1996-01-01").cast("date"))
    return importing.built(cells, overlap=overlap)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def verdict_rows(spark: SparkSession, sf: str) -> DataFrame:
        v = verdicts.with_verdicts(ledger(spark, sf).visible())
        return v.select("household_id", "id", "category", "counted", "income", "card_payment", "auto_type", "type", verdicts.display_name().alias("name"), verdicts.display_category(F.col("type")).alias("display"), F.coalesce(verdicts.type_label(F.col("type"), F.col("amount")), F.lit("?")).alias("label"))

    def totals(spark: SparkSession, sf: str) -> DataFrame:
        v = verdicts.with_verdicts(ledger(spark, sf).between(START, END))
        return v.groupBy("household_id").agg(amount(F.sum(F.when(F.col("counted"), F.col("amount")).otherwise(0))).alias("spent"), amount(F.sum(F.when(F.col("income"), -F.col("amount")).otherwise(0))).alias("income"))

    def month_rows(spark: SparkSession, sf: str) -> DataFrame:
        shaped = verdicts.shape(ledger(spark, sf).month(*MONTH))
        return shaped.select("household_id", "id", "merchant_name", "transaction_date", amount(F.col("amount")).alias("amount"), "category", "auto_category", "auto_description", "excluded", "tx_type", "auto_tx_type", "counted")

    def accounts_list(spark: SparkSession, sf: str) -> DataFrame:
        a = ledger(spark, sf)["accounts"]
        return a.select("household_id", "account_id", "name", "type", "institution", amount(balances.display_balance(F.col("current_balance"), F.col("type"))).alias("balance"), "hidden")

    def movers(spark: SparkSession, sf: str) -> DataFrame:
        return spending.biggest_movers(ledger(spark, sf).two_months("1995-06-01"), "1995-06-01")

    def income(spark: SparkSession, sf: str) -> DataFrame:
        book = ledger(spark, sf)
        return spending.actual_income(book.month(*MONTH), book.visible())

    def ledger_page(spark: SparkSession, sf: str) -> DataFrame:
        rows = ledger(spark, sf)["transactions"].where("account_id = 7")
        return importing.search(rows, limit=5).select("household_id", "id", "date", amount(F.col("amount")).alias("amount"), "has_more")

    def found(spark: SparkSession, sf: str) -> DataFrame:
        rows = ledger(spark, sf).visible()
        return importing.search(rows, "vendor 1", least=10, most=200, start="1995-01-01", end="1997-12-31", limit=50, offset=2).select("id", "date", amount(F.col("amount")).alias("amount"), "has_more")

    def snapshots(spark: SparkSession, sf: str, **how: object) -> DataFrame:
        book = ledger(spark, sf)
        return balances.net_worth(book["snapshots"], book["accounts"], **how)

    def learned_rules(spark: SparkSession, sf: str) -> DataFrame:
        rows = ledger(spark, sf).visible()
        return rules.classify(rows, fixture.load(spark, sf, "rules")).select("household_id", "id", "raw_category", "mapped_category")

    def rule_counts(spark: SparkSession, sf: str) -> DataFrame:
        book = ledger(spark, sf)
        kinds = book["accounts"].select("account_id", F.col("type").alias("account_type"))
        found = rules.rule_matches(book["transactions"].join(kinds, "account_id"), fixture.load(spark, sf, "rules"))
        return found.withColumn("amount", amount(F.col("amount")))

    def tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
        return rules.rollup(_groups(spark, sf), rules.registry_tree(fixture.load(spark, sf, "registry")))

    def teach(spark: SparkSession, sf: str) -> DataFrame:
        return spending.teach_queue(ledger(spark, sf).paired(START, END), merchant_key(F.col("description")))

    def coverage(spark: SparkSession, sf: str) -> DataFrame:
        return importing.coverage(ledger(spark, sf).visible())

    def amortized(spark: SparkSession, sf: str) -> DataFrame:
        d = balances.debts(ledger(spark, sf)["accounts"])
        out = d.select("household_id", "account_id", balances.amortize(F.col("balance"), F.col("monthly_rate") * 1200, F.col("minimum_payment")).alias("a"))
        return out.select("household_id", "account_id", "a.months", "a.interest", "a.stalled")

    def needs(spark: SparkSession, sf: str) -> DataFrame:
        rows = _walk(spark, sf)
        return rows.select("household_id", "category", envelopes.target_need(VIEW).alias("need"), envelopes.pace("1996-06-10").alias("ahead"))

    def auto_fill(spark: SparkSession, sf: str) -> DataFrame:
        a = fixture.load(spark, sf, "assignments")
        return envelopes.auto_fill(a.where("month = date'1996-05-01'"), a.where("month = date'1996-06-01' and assigned > 400"))

    def expected_status(spark: SparkSession, sf: str) -> DataFrame:
        e = fixture.load(spark, sf, "expected")
        return e.select("household_id", "id", recurring.status("1996-03-01").alias("state"), recurring.missed("1996-03-01").alias("missed"), recurring.roll_forward(F.col("due_date"), F.col("cadence")).alias("next_due"))

    def upserted(spark: SparkSession, sf: str) -> DataFrame:
        held = ledger(spark, sf)["transactions"].select("household_id", "id", "amount", "description", "user_category")
        new = held.where("id % 3 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 10_000_000_000).otherwise(0)).alias("id"), "household_id", (F.col("amount") + 1).cast("decimal(14,2)").alias("amount"), F.lit("FEED").alias("description"))
        return importing.upsert(held, new, ["household_id", "id"], ["amount", "description"]).select("household_id", "id", amount(F.col("amount")).alias("amount"), "description", "user_category")

    def duplicates(spark: SparkSession, sf: str) -> DataFrame:
        e = fixture.load(spark, sf, "expected")
        fields = e.where("status = 'dismissed'").select("household_id", "id", "recurring_key", "due_date", "cadence")
        return recurring.duplicates(fields, e).select("household_id", "id")

    return {
        "A01_D01_visible_range": lambda s, d: ledger(s, d).between(START, END).select("household_id", "id", "account_id", "date", amount(F.col("amount")).alias("amount"), "account_type"),
        "A05_D03_accounts": accounts_list,
        "A07_H02_M15_account_ledger_page": ledger_page,
        "A06_M11_debts": lambda s, d: balances.debts(ledger(s, d)["accounts"]),
        "C01_C12_verdicts": verdict_rows,
        "E01_E02_totals": totals,
        "D04_internal_transfers": lambda s, d: internal_ids(ledger(s, d).visible()),
        "M01_spending_by_category": _groups,
        "M02_E05_biggest_movers": movers,
        "M03_C11_month_transactions": month_rows,
        "M04_E07_cash_flow": _flow,
        "M05_E08_actual_income": income,
        "E04_spending_to_date": lambda s, d: spending.spending_total(ledger(s, d).month(*MONTH), 15),
        "E06_envelope_spending": lambda s, d: spending.envelope_spending(ledger(s, d).paired(START, END)).withColumn("spent", amount(F.col("spent"))),
        "E17_teach_queue": teach,
        "E18_categorized_share": lambda s, d: spending.categorized_share(_groups(s, d), verdicts.UNCATEGORIZED),
        "E19_D14_category_rollup": tree_rollup,
        "E21_income_sections": lambda s, d: spending.income_sections(_flow(s, d)),
        "E22_income_vs_spending": lambda s, d: spending.insight(_flow(s, d)),
        "E23_breakdown_segments": lambda s, d: spending.breakdown_segments(_groups(s, d)),
        "E10_M16_coverage": coverage,
        "D15_coverage_gaps": lambda s, d: importing.coverage_gaps(ledger(s, d)["accounts"], ledger(s, d)["transactions"]),
        "D06_classify": learned_rules,
        "B07_M17_rule_matches": rule_counts,
        "C18_M14_search": found,
        "E11_schedule_lines": lambda s, d: tax.schedule_lines(_tax_rows(s, d), _mapping(s)),
        "E11_schedule_summary": lambda s, d: tax.schedule_summary(_tax_rows(s, d), _mapping(s)),
        "E11_unmapped": lambda s, d: tax.unmapped(_tax_rows(s, d), _mapping(s)),
        "E12_entity_monthly": lambda s, d: tax.monthly(_tax_rows(s, d)),
        "E13_entity_ledger": lambda s, d: tax.ledger(_tax_rows(s, d)),
        "E14_deductions": lambda s, d: tax.deductions(_tax_rows(s, d), _buckets(s)),
        "E15_D11_mileage": lambda s, d: tax.mileage(fixture.load(s, d, "mileage")),
        "E15_mileage_total": lambda s, d: tax.mileage_total(fixture.load(s, d, "mileage")),
        "B13_schedule_csv": lambda s, d: tax.schedule_csv(_tax_rows(s, d), _mapping(s)),
        "F01_M08_envelopes": _walk,
        "F01_envelope_totals": lambda s, d: envelopes.totals(_walk(s, d)),
        "F02_F03_target_need_pace": needs,
        "F05_auto_fill": auto_fill,
        "F06_M09_recurring": lambda s, d: recurring.detect(fixture.load(s, d, "series")),
        "K09_recurring_headline": lambda s, d: recurring.headline(recurring.detect(fixture.load(s, d, "series")), s.createDataFrame([(0, "STREAM AA")], "household_id int, key string")),
        "F07_M10_net_worth": snapshots,
        "F08_net_worth_since": lambda s, d: snapshots(s, d, since="2024-01-10"),
        "F09_debt_series": lambda s, d: snapshots(s, d, debts_only=True),
        "G01_amortize": amortized,
        "G03_G04_payoff": lambda s, d: balances.payoff(ledger(s, d)["accounts"], "avalanche", 200.0),
        "G05_debt_order": lambda s, d: balances.debt_order(ledger(s, d)["accounts"]),
        "E20_debt_totals": lambda s, d: balances.debt_totals(ledger(s, d)["accounts"]),
        "G07_I22_expected_status": expected_status,
        "G08_projected_cycles": lambda s, d: recurring.project(fixture.load(s, d, "expected").where("status = 'pending'"), "1999-01-01"),
        "E16_expected_by_category": lambda s, d: recurring.by_category(fixture.load(s, d, "expected")),
        "D07_expected_match": lambda s, d: recurring.match(fixture.load(s, d, "expected").where("status = 'pending'"), ledger(s, d).visible()),
        "D10_I23_duplicate_expected": duplicates,
        "J01_import_rows": lambda s, d: _built(s, d).select("household_id", "account_id", "row", "date", amount(F.col("amount")).alias("amount"), "description", "external_id", "ordinal", "reason", "overlap"),
        "J02_import_plan": lambda s, d: importing.import_plan(_built(s, d)),
        "D05_reconcile": lambda s, d: importing.reconcile(
            ledger(s, d)["transactions"].where("id % 3 <> 0").select("household_id", "account_id", "id", F.date_add("date", 1).alias("date"), (F.col("amount") + F.when(F.col("id") % 7 == 0, 5).otherwise(0)).alias("amount"), "description"),
            ledger(s, d)["transactions"].select("household_id", "account_id", "id", "date", "amount", "description"),
        ),
        "B01_upsert": upserted,
        **more.queries(),
        **intake.queries(),
        **statements.queries(),
        **pulls.queries(),
        **unlinks.queries(),
        **contexts.queries(),
        **edits.queries(),
        **views.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | more.SQL | intake.SQL | statements.SQL | pulls.SQL | unlinks.SQL | contexts.SQL | edits.SQL | views.SQL
