"""What screens derive from the reports as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import amount
from ..functions.text import merchant_key, normal_merchant
from ..operators import balances, categories, importing, rules, spending, verdicts
from . import fixture
from .more import _book
from .oracles import _CELLS, _DEBTS, _GROUPS, _KEY, _LEDGER, _MAY, _MONTH, _RANGE, _YEAR, _q, rows

col, lit = F.col, F.lit


def queries() -> dict:
    def groups(s: SparkSession, d: str) -> DataFrame:
        registry = fixture.load(s, d, "registry")
        tree = rules.registry_tree(registry)
        return categories.shown(spending.spending_groups(_book(s, d).month(1995, 6)), tree.select("household_id", col("name").alias("category")), tree)

    def ranks(s: SparkSession, d: str) -> DataFrame:
        """By the letters from behind, so that a group's earliest is seldom its own."""
        shown = groups(s, d)
        return categories.earliest(shown, shown.where("length(category) > 3").select("household_id", "category", F.ascii(F.reverse("category")).alias("rank")))

    def wanted(s: SparkSession, d: str) -> DataFrame:
        """Each account's household asks for one of a few filings."""
        a, k = fixture.load(s, d, "accounts"), col("account_id")
        child = F.when(k % 5 == 0, "Work").when(k % 5 == 1, "URGENT").when(k % 5 == 2, "Uncategorized").when(k % 5 == 3, "MEDIUM").otherwise("LOW")
        parent = F.when(k % 7 == 0, "").when(k % 7 == 1, "Work").when(k % 7 == 2, "HIGH").when(k % 7 == 3, "Return").when(k % 7 == 4, "LOW").when(k % 7 == 5, "Groceries")
        return a.select("household_id", "account_id", child.alias("child"), parent.alias("parent"))

    def filed(s: SparkSession, d: str) -> DataFrame:
        registry = fixture.load(s, d, "registry")
        new = wanted(s, d).groupBy("household_id", "child").agg(F.max_by("parent", "account_id").alias("parent"))
        return categories.filed(registry, new)

    def totals(s: SparkSession, d: str) -> DataFrame:
        return importing.statement_totals(importing.built(fixture.load(s, d, "cells")))

    def typed(s: SparkSession, d: str) -> DataFrame:
        cells = fixture.load(s, d, "cells")
        return cells.select("row", importing.search_amount(col("amount_cell")).alias("amount"), importing.search_date(col("date_cell")).alias("date"))

    def payoff(s: SparkSession, d: str) -> DataFrame:
        a = _book(s, d)["accounts"]
        return balances.in_payoff(a, a.where("account_id % 4 < 2").select("household_id", "account_id", (col("account_id") % 4 == 0).alias("included")))

    def labels(s: SparkSession, d: str) -> DataFrame:
        queue = spending.teach_queue(_book(s, d).paired("1995-01-01", "1995-06-30"), merchant_key(col("description")))
        return queue.select("household_id", "key", spending.other_label(col("money_in"), col("other_out")).alias("label"))

    def delta(s: SparkSession, d: str) -> DataFrame:
        b = _book(s, d)
        now, before, part = spending.spending_total(b.month(1995, 6)), spending.spending_total(b.month(1995, 5)), spending.spending_total(b.month(1995, 5), 3)
        sums = now.join(before.withColumnRenamed("spent", "last_month"), "household_id").join(part.where("household_id % 2 = 0").withColumnRenamed("spent", "last_to_date"), "household_id", "left")
        return spending.month_delta(sums, True).join(spending.month_delta(sums, False).withColumnRenamed("delta", "whole"), "household_id")

    def paired(s: SparkSession, d: str) -> DataFrame:
        return _book(s, d).paired("1995-01-01", "1995-06-30").select("household_id", "id", "date", amount(col("amount")).alias("amount"), "internal")

    def worksheets(s: SparkSession, d: str) -> DataFrame:
        """Rows, sums and dates of each entity's tax year; personal ones have no entity."""
        v = verdicts.with_verdicts(_book(s, d).between("1996-01-01", "1996-12-31")).withColumn("entity", F.coalesce("entity_id", "account_entity"))
        return v.where("not excluded and amount <> 0").groupBy("household_id", "entity").agg(F.count("*").alias("n"), amount(F.sum("amount")).alias("net"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_if("is_capital").alias("capital"))

    def account_rows(s: SparkSession, d: str) -> DataFrame:
        """Rows of some accounts, hidden ones too, with their types, in one category."""
        b = _book(s, d)
        t = b["transactions"].where(col("date").between(lit("1996-01-01").cast("date"), lit("1996-12-31").cast("date")) & (col("account_id") % 5 == 1))
        both = t.join(b["accounts"].select("household_id", "account_id", col("type").alias("account_type")), ["household_id", "account_id"], "left")
        return both.where(verdicts.effective_category().isin("URGENT", "Uncategorized")).select("household_id", "id", "account_id", "account_type", "date")

    def names(s: SparkSession, d: str) -> DataFrame:
        return fixture.load(s, d, "series").select("household_id", "id", "account_id", normal_merchant(col("merchant_name")).alias("merchant"), F.initcap(normal_merchant(col("merchant_name"))).alias("title"))

    def assigned(s: SparkSession, d: str) -> DataFrame:
        return fixture.load(s, d, "assignments").where("month <= date'1996-06-01'").select("household_id", "category", "month", amount(col("assigned")).alias("assigned"))

    return {
        "K02_F13_H08_E27_category_groups": groups, "F13_earliest_ranks": ranks, "I32_I36_filing": lambda s, d: categories.filing(fixture.load(s, d, "registry"), wanted(s, d)), "I32_registry_filed": filed, "E26_A27_statement_totals": totals,
        "I21_search_input": typed, "K08_payoff_inclusion": payoff, "I24_other_labels": labels, "K01_month_delta": delta, "M07_A02_paired_range": paired, "M12_K11_entity_worksheets": worksheets,
        "A08_D02_K12_account_rows": account_rows, "I02_I04_merchant_names": names, "A10_assignments_through": assigned,
    }


_TREE = """trimmed AS (SELECT household_id, position, trim(name) AS name, nullif(trim(parent), '') AS parent FROM registry WHERE trim(name) NOT IN ('', 'Uncategorized', 'Return', 'Transfers and card payments')),
 claims AS (SELECT household_id, name, arg_min(parent, position) AS parent FROM trimmed t WHERE parent IS NOT NULL AND parent <> name AND EXISTS (SELECT 1 FROM trimmed n WHERE n.household_id = t.household_id AND n.name = t.parent) GROUP BY 1, 2),
 legal AS (SELECT household_id, name AS category, parent FROM claims c WHERE NOT EXISTS (SELECT 1 FROM claims n WHERE n.household_id = c.household_id AND n.name = c.parent))"""
_SHOWN = rows(_MONTH) + ", " + _GROUPS + ", " + _TREE + """, listed AS (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY added, s DESC, category) AS pos FROM (SELECT household_id, category, s, transaction_count AS n, 0 AS added FROM groups
 UNION ALL SELECT DISTINCT household_id, name, 0, 0, 1 FROM trimmed t WHERE NOT EXISTS (SELECT 1 FROM groups g WHERE g.household_id = t.household_id AND g.category = t.name))),
 placed AS (SELECT l.*, coalesce(parent, l.category) AS grp, parent IS NULL AS own FROM listed l LEFT JOIN (SELECT g.* FROM legal g JOIN listed p ON p.household_id = g.household_id AND p.category = g.parent) k ON k.household_id = l.household_id AND k.category = l.category),
 heads AS (SELECT household_id, grp, sum(s) AS gs, sum(n) AS gn, max(CASE WHEN own THEN pos END) AS first FROM placed GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY gs DESC, first) AS gp FROM heads)"""
_CHILD = "CASE account_id % 5 WHEN 0 THEN 'Work' WHEN 1 THEN 'URGENT' WHEN 2 THEN 'Uncategorized' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS child"
_PARENT = "CASE account_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'Work' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'Return' WHEN 4 THEN 'LOW' WHEN 5 THEN 'Groceries' END AS parent"

SQL = {
    "K02_F13_H08_E27_category_groups": _q("""SELECT household_id, category, grp AS "group", CAST(s AS DOUBLE) AS amount, n AS transaction_count, CAST(gs AS DOUBLE) AS group_amount, CAST(gn AS BIGINT) AS group_count, gp AS group_place, row_number() OVER (PARTITION BY household_id, grp ORDER BY own DESC, lower(category), category) - 1 AS place FROM placed JOIN ranked USING (household_id, grp)""", *_LEDGER, "registry", then=_SHOWN),
    "F13_earliest_ranks": _q("""SELECT household_id, grp AS "group", min(CASE WHEN length(category) > 3 THEN ascii(reverse(category)) END) AS rank FROM placed GROUP BY 1, 2""", *_LEDGER, "registry", then=_SHOWN),
    "I32_I36_filing": _q(
        """SELECT household_id, account_id, child, w.parent, CASE WHEN child = 'Uncategorized' THEN 'That category is managed by the app.' WHEN coalesce(w.parent, '') = '' THEN NULL WHEN w.parent = 'Return' THEN 'That category is managed by the app.' WHEN child = w.parent THEN 'A category can''t be part of itself.'
 WHEN EXISTS (SELECT 1 FROM legal n WHERE n.household_id = w.household_id AND n.category = w.parent) THEN w.parent || ' is already part of another category — only one level of nesting.' WHEN EXISTS (SELECT 1 FROM legal n WHERE n.household_id = w.household_id AND n.parent = child) THEN child || ' has subcategories of its own — only one level of nesting.' END AS reason FROM w""",
        "accounts", "registry", then=_TREE + f", w AS (SELECT household_id, account_id, {_CHILD}, {_PARENT} FROM accounts)",
    ),
    "I32_registry_filed": _q(f"SELECT r.household_id, position, name, CASE WHEN w.household_id IS NULL THEN r.parent ELSE nullif(w.parent, '') END AS parent FROM registry r LEFT JOIN (SELECT DISTINCT ON (household_id, child) * FROM (SELECT household_id, account_id, {_CHILD}, {_PARENT} FROM accounts) ORDER BY household_id, child, account_id DESC) w ON w.household_id = r.household_id AND child = trim(name)", "accounts", "registry"),
    "E26_A27_statement_totals": _q("SELECT household_id, account_id, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS money_out, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS money_in, min(date) AS first, max(date) AS last FROM built WHERE reason IS NULL GROUP BY 1, 2", "cells", then=_CELLS),
    "I21_search_input": _q("SELECT row, abs(TRY_CAST(regexp_replace(amount_cell, '[$, ]', '', 'g') AS DOUBLE)) AS amount, CASE WHEN regexp_full_match(date_cell, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN date_cell END AS date FROM cells", "cells"),
    "K08_payoff_inclusion": _q("SELECT household_id, account_id, type, balance, coalesce(minimum_payment, 0) <= 0 AS no_minimum FROM debts WHERE balance > 0 AND CASE WHEN account_id % 4 < 2 THEN account_id % 4 = 0 ELSE type = 'credit' END", "accounts", then=_DEBTS),
    "I24_other_labels": _q("SELECT household_id, key, CASE WHEN i > 0 AND o > 0 THEN format('${:,.2f} in / ${:,.2f} out', i, o) WHEN i > 0 THEN format('${:,.2f} in', i) WHEN o > 0 THEN format('${:,.2f} out', o) ELSE 'no amount' END AS label FROM (SELECT household_id, key, CAST(sum(CASE WHEN NOT counted AND amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS i, CAST(sum(CASE WHEN NOT counted AND amount >= 0 THEN amount ELSE 0 END) AS DOUBLE) AS o FROM keyed WHERE key <> '' GROUP BY 1, 2)", *_LEDGER, then=rows(_RANGE) + f", keyed AS (SELECT *, {_KEY} AS key FROM v)"),
    "K01_month_delta": _q("SELECT household_id, round(c - coalesce(CASE WHEN household_id % 2 = 0 THEN b END, a), 2) AS delta, round(c - a, 2) AS whole FROM (SELECT household_id, CAST(sum(amount) AS DOUBLE) AS a, CAST(sum(CASE WHEN day(date) <= 3 THEN amount END) AS DOUBLE) AS b FROM u WHERE counted GROUP BY 1) JOIN (SELECT household_id, CAST(sum(amount) AS DOUBLE) AS c FROM v WHERE counted GROUP BY 1) USING (household_id)", *_LEDGER, then=rows(_MONTH) + ", " + rows(_MAY, name="u")),
    "M07_A02_paired_range": _q("SELECT household_id, id, date, CAST(amount AS DOUBLE) AS amount, internal FROM v", *_LEDGER, then=rows(_RANGE)),
    "M12_K11_entity_worksheets": _q("SELECT household_id, coalesce(entity_id, account_entity) AS entity, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS net, min(date) AS first, max(date) AS last, count(*) FILTER (WHERE is_capital) AS capital FROM vb WHERE NOT excluded AND amount <> 0 GROUP BY 1, 2", *_LEDGER, then=rows(_YEAR, False)),
    "A08_D02_K12_account_rows": _q(f"SELECT household_id, id, account_id, type AS account_type, date FROM transactions LEFT JOIN (SELECT account_id, type FROM accounts) USING (account_id) WHERE {_YEAR} AND account_id % 5 = 1 AND coalesce(nullif(user_category, ''), nullif(mapped_category, ''), 'Uncategorized') IN ('URGENT', 'Uncategorized')", *_LEDGER),
    "I02_I04_merchant_names": _q("SELECT household_id, id, account_id, m AS merchant, array_to_string(list_transform(string_split(m, ' '), lambda w: w[1] || lower(w[2:])), ' ') AS title FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(upper(merchant_name), '[0-9#*]+', ' ', 'g'), '[^A-Z ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS m FROM series)", "series"),
    "A10_assignments_through": _q("SELECT household_id, category, month, CAST(assigned AS DOUBLE) AS assigned FROM assignments WHERE month <= DATE '1996-06-01'", "assignments"),
}
