"""Scans, scalar functions, sinks and view derivations as queries of their own, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import amount
from ..functions.text import STOP_WORDS, csv_cell, description_tokens, merchant_key, normal_description, normal_merchant, similarity
from ..operators import balances, importing, recurring, rules, settings, spending, verdicts
from ..sources import feed
from ..sources.ledger import Ledger
from . import fixture
from .oracles import _DEBTS, _GROUPS, _KEY, _MONTH, _m, _q, rows

#: A feed's envelope for each order, and messages and account names that vary with its key.
FEEDS = """SELECT CAST(c_nationkey AS INT) AS household_id, o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'Visa Signature' WHEN 1 THEN 'Home Loan' WHEN 2 THEN 'Share Savings' WHEN 3 THEN 'Everyday Checking' WHEN 4 THEN 'Roth IRA' WHEN 5 THEN 'Sapphire' WHEN 6 THEN 'Account' WHEN 7 THEN 'Plain' ELSE 'Money Market' END AS name,
 CASE o_orderkey % 7 WHEN 0 THEN 'Discover' ELSE 'Some Bank' END AS org, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) * (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) AS STRING) || '.25' AS balance,
 CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 946684800 + o_orderkey % 1000 * 86400 END AS posted, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '-' || CAST(o_orderkey % 500 AS STRING) || '.75' END AS value,
 CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Shop ' || CAST(o_orderkey % 5 AS STRING) END AS description,
 CASE o_orderkey % 6 WHEN 0 THEN 'Please reconnect your account' WHEN 1 THEN 'The date range requested exceeds the limit and was capped' WHEN 2 THEN 'requested date range exceeds recommended 60 days' WHEN 3 THEN 'hello there' WHEN 4 THEN 'date range maximum is 90 days' ELSE 'date range may be capped, it exceeds' END AS message
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
#: Settings of households, a handful of keys per account, some of them broken.
KEPT = """SELECT CAST(c_nationkey AS INT) AS household_id, k || ':' || CAST(c_custkey AS STRING) AS key, CASE WHEN c_custkey % 5 = 0 THEN 'broken' WHEN k = 'ignore' THEN '["A", " B ", "A", "", "' || CAST(c_custkey % 3 AS STRING) || '"]'
 WHEN k = 'pace' THEN chr(123) || '"x": true, "y": false, "z' || CAST(c_custkey % 3 AS STRING) || '": true' || chr(125) ELSE CAST(c_custkey AS STRING) || '.5' END AS value FROM {customer} JOIN (VALUES ('ignore'), ('pace'), ('income')) AS r(k) ON c_custkey >= 0"""
fixture.ALL["feeds"], fixture.ALL["kept"] = FEEDS, KEPT

_JSON = """concat('{"errors":["', message, '"],"accounts":[{"id":"a', k, '","name":"', name, '","balance":"', balance, '","balance-date":', posted, ',"org":{"name":"', org, '"},"transactions":[{"id":"t', k, '","posted":', posted, ',"amount":"', value, '","description":"', description, '","payee":"Payee"}]}]}')"""


def _book(spark: SparkSession, sf: str) -> Ledger:
    return Ledger({n: fixture.load(spark, sf, n) for n in ("accounts", "transactions", "snapshots")})


def _feeds(spark: SparkSession, sf: str) -> DataFrame:
    return feed.parsed(fixture.load(spark, sf, "feeds").selectExpr("household_id", f"{_JSON} AS json"))


def queries() -> dict:
    col = F.col

    def text_keys(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d)["transactions"]
        both = similarity(description_tokens(col("description")), description_tokens(col("merchant_name")))
        return t.select("id", merchant_key(col("description")).alias("key"), normal_merchant(col("merchant_name")).alias("merchant"), normal_description(col("description")).alias("plain"), both.alias("alike"), csv_cell(col("user_description")).alias("cell"))

    def coverage_start(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d)["transactions"]
        return t.where(col("external_id").startswith("sfin:")).groupBy("account_id").agg(F.min("date").alias("first"), F.count("*").alias("ids"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))

    def tax_scan(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d).between("1996-01-01", "1996-12-31")
        return t.select("id", F.coalesce("entity_id", "account_entity").alias("entity_id"), (col("id") % 13 == 0).alias("receipt"))

    def snapshot_scan(s: SparkSession, d: str) -> DataFrame:
        b = _book(s, d)
        visible = b["accounts"].where("not hidden").select("account_id")
        return b["snapshots"].where("captured_on >= date'2024-01-15'").join(visible, "account_id", "left_semi").withColumn("balance", amount(col("balance")))

    def rule_bag(s: SparkSession, d: str) -> DataFrame:
        r = fixture.load(s, d, "rules")
        entry = F.concat_ws(":", F.coalesce(col("amount").cast("int").cast("string"), F.lit("any")), "category")
        return r.groupBy("household_id", "merchant_key").agg(F.array_join(F.array_sort(F.collect_list(entry)), "|").alias("entries"))

    def set_rules(s: SparkSession, d: str) -> DataFrame:
        r = fixture.load(s, d, "rules")
        new = r.where("merchant_key like 'AMAZON%'").select("household_id", "merchant_key", F.when(col("merchant_key") == "AMAZON", "Parcels").alias("category"), "amount")
        return rules.set_rules(r, new).select("household_id", "merchant_key", "category", amount(col("amount")).alias("amount"))

    def feed_accounts(s: SparkSession, d: str) -> DataFrame:
        a = feed.feed_accounts(_feeds(s, d))
        return a.select("household_id", "external_id", "org_key", "type", "subtype", "uncertain", amount(col("balance")).alias("balance"), "balance_on")

    def feed_rows(s: SparkSession, d: str) -> DataFrame:
        return feed.feed_transactions(_feeds(s, d)).select("household_id", "external_id", "date", amount(col("amount")).alias("amount"), "description")

    def messages(s: SparkSession, d: str) -> DataFrame:
        m = _feeds(s, d).select("household_id", F.explode("feed.errors").alias("m"))
        return m.groupBy("household_id", feed.message_kind(col("m")).alias("kind"), feed.clean_message(col("m")).alias("message")).agg(F.count("*").alias("n"))

    def moved(s: SparkSession, d: str) -> DataFrame:
        a = _book(s, d)["accounts"]
        pulled = a.select("account_id", F.when(col("account_id") % 2 == 0, col("current_balance") + 1).otherwise(col("current_balance")).alias("balance"))
        return importing.changed_snapshots(a, pulled, "2026-01-01").withColumn("balance", amount(col("balance")))

    def new_accounts(s: SparkSession, d: str) -> DataFrame:
        """Accounts of a pull: known ones keep their type, new ones come in hidden."""
        a = _book(s, d)["accounts"].select("account_id", "type", "hidden", amount(col("current_balance")).alias("balance"))
        pulled = a.select((col("account_id") + F.when(col("account_id") % 5 == 0, 1_000_000).otherwise(0)).alias("account_id"), F.lit("credit").alias("type"), (col("balance") + 1).alias("balance"))
        patched = importing.upsert(a, pulled, ["account_id"], ["balance"])
        kinds = pulled.select("account_id", col("type").alias("pulled_type"))
        return patched.join(kinds, "account_id", "left").select("account_id", F.coalesce("type", "pulled_type").alias("type"), F.coalesce("hidden", F.lit(True)).alias("hidden"), "balance")

    def missing(s: SparkSession, d: str) -> DataFrame:
        used = _book(s, d)["transactions"].select("household_id", verdicts.effective_category().alias("name")).distinct()
        known = fixture.load(s, d, "registry").select("household_id", F.trim("name").alias("name")).distinct()
        both = used.unionByName(known).distinct().where(~col("name").isin(verdicts.MECHANISMS))
        return both.join(known.withColumn("known", F.lit(True)), ["household_id", "name"], "left").join(used.withColumn("used", F.lit(True)), ["household_id", "name"], "left").select("household_id", "name", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("used", F.lit(False)).alias("used"))

    def by_day(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d).month(1995, 6, paired=False)
        order = Window.partitionBy("household_id").orderBy(col("date").desc(), col("amount").desc(), "id")
        return t.select("household_id", "date", "id", F.row_number().over(order).alias("position"), F.count("*").over(Window.partitionBy("household_id", "date")).alias("of_day"))

    def schedule(s: SparkSession, d: str) -> DataFrame:
        return balances.schedule(_book(s, d)["accounts"])

    def debt_free(s: SparkSession, d: str) -> DataFrame:
        b = balances.debts(_book(s, d)["accounts"])
        a = b.select("account_id", balances.amortize(col("balance"), col("monthly_rate") * 1200, col("minimum_payment")).alias("a"))
        return a.select("account_id", F.when(~col("a.stalled") & (col("a.months") > 0), F.date_format(F.add_months(F.lit("2026-01-01").cast("date"), col("a.months")), "yyyy-MM")).alias("free"))

    def sections(s: SparkSession, d: str) -> DataFrame:
        a = _book(s, d)["accounts"].where("not hidden")
        shown = balances.display_balance(col("current_balance"), col("type"))
        return a.groupBy("household_id", "type").agg(amount(F.sum(shown)).alias("total"), F.count("*").alias("accounts"))

    def overview(s: SparkSession, d: str) -> DataFrame:
        b = _book(s, d)
        now, before = spending.spending_total(b.month(1995, 6), 15), spending.spending_total(b.month(1995, 5))
        to_date = spending.spending_total(b.month(1995, 5), 15).withColumnRenamed("spent", "last_to_date")
        return before.withColumnRenamed("spent", "last_month").join(to_date, "household_id", "full_outer").join(now, "household_id", "full_outer").na.fill(0.0)

    def drill_down(s: SparkSession, d: str) -> DataFrame:
        tree = rules.registry_tree(fixture.load(s, d, "registry"))
        v = verdicts.with_verdicts(_book(s, d).month(1995, 6)).where("counted")
        members = tree.where("name = 'Work' or parent = 'Work'").select("household_id", col("name").alias("category"))
        return v.join(members, ["household_id", "category"]).select("household_id", "id", "category", "date")

    def budget_left(s: SparkSession, d: str) -> DataFrame:
        limits = fixture.load(s, d, "registry").where("name in ('URGENT', 'HIGH')").select("household_id", col("name").alias("category")).distinct().withColumn("monthly_limit", F.lit(300.0))
        spent = spending.spending_groups(_book(s, d).month(1995, 6))
        return limits.join(spent, ["household_id", "category"], "left").groupBy("household_id").agg((F.sum("monthly_limit") - F.sum(F.coalesce("amount", F.lit(0.0)))).alias("left"))

    def soon(s: SparkSession, d: str) -> DataFrame:
        e = fixture.load(s, d, "expected").where("status = 'pending' and due_date between date'1996-03-01' and date'1996-03-08'")
        return e.groupBy("household_id").agg(amount(F.sum("amount")).alias("due"), F.count("*").alias("n"))

    def usual(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d)["transactions"].withColumn("position", F.row_number().over(Window.partitionBy("household_id", "source").orderBy("id")))
        return recurring._modes(t, ["merchant_name"], ["household_id", "source"]).where("source is not null")

    def medians(s: SparkSession, d: str) -> DataFrame:
        v = verdicts.with_verdicts(_book(s, d).visible()).where("counted")
        return v.groupBy("category").agg(F.percentile(amount(col("amount")), F.lit(0.5)).alias("median"), F.count("*").alias("n"))

    def pull_window(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d)["transactions"].groupBy("account_id").agg(F.max("date").alias("last"))
        return t.select("account_id", feed.window_start(col("last"), "1998-08-10").alias("ask_from"))

    def restore(s: SparkSession, d: str) -> DataFrame:
        a = _book(s, d)["accounts"]
        hidden, recorded = a.where("hidden").select("household_id", "account_id"), a.where("account_id % 2 = 0").select("household_id", "account_id")
        return hidden.intersect(recorded)

    def status(s: SparkSession, d: str) -> DataFrame:
        a = _book(s, d)["accounts"]
        return a.groupBy("household_id", "institution").agg(F.count("*").alias("accounts"), F.count_if("hidden").alias("hidden"), F.max_by("name", "account_id").alias("latest"))

    def patched(s: SparkSession, d: str) -> DataFrame:
        """Rows edited by their owners: the edit overlays category and type, and verdicts follow."""
        t = _book(s, d).visible()
        edits = t.where("id % 10 = 1").select("id", F.lit("Gifts").alias("new_category"), F.lit("spending").alias("new_type"))
        e = t.join(edits, "id", "left").withColumn("user_category", F.coalesce("new_category", "user_category")).withColumn("user_type", F.coalesce("new_type", "user_type"))
        return verdicts.with_verdicts(e).groupBy("household_id", "category").agg(F.count_if("counted").alias("counted"))

    def lists(s: SparkSession, d: str) -> DataFrame:
        k = fixture.load(s, d, "kept")
        names = settings.name_list(col("value"))
        return k.select("household_id", "key", F.array_join(F.when(col("key").startswith("ignore"), names).otherwise(F.array().cast("array<string>")), "|").alias("names"),
            F.array_join(F.when(col("key").startswith("ignore"), settings.toggled(names, F.lit("B"), col("household_id") % 2 == 0)).otherwise(F.array().cast("array<string>")), "|").alias("toggled"),
            F.array_join(F.when(col("key").startswith("pace"), settings.true_keys(col("value"))).otherwise(F.array().cast("array<string>")), "|").alias("paced"))

    def stored_settings(s: SparkSession, d: str) -> DataFrame:
        k = fixture.load(s, d, "kept")
        new = k.where("key like 'income:%'").select("household_id", "key", F.when(F.length("key") % 2 == 0, F.lit("7")).alias("value"))
        return settings.put(k, new)

    return {
        "I26_I29_I35_setting_lists": lists, "A18_A39_B19_settings_put": stored_settings,
        "I01_I03_I15_I30_text": text_keys, "A13_A14_coverage_start": coverage_start, "A15_A16_D09_tax_year_scan": tax_scan, "A09_snapshot_scan": snapshot_scan, "A11_A12_rule_bag": rule_bag, "B06_set_rules": set_rules,
        "A31_A33_feed_accounts": feed_accounts, "A30_I42_feed_transactions": feed_rows, "A34_A37_feed_messages": messages, "B04_changed_snapshots": moved, "B02_pulled_accounts": new_accounts, "D10_H04_H07_category_lists": missing,
        "F11_H01_by_day": by_day, "G02_amortization_schedule": schedule, "G06_debt_free_month": debt_free, "K06_account_sections": sections, "M06_E09_overview": overview, "K10_drill_down": drill_down, "K03_budget_left": budget_left,
        "K05_due_soon": soon, "E24_most_frequent": usual, "E25_medians": medians, "J06_A36_pull_window": pull_window, "B12_H06_restorable": restore, "A38_connection_status": status, "B05_C12_row_edits": patched,
    }


_LEDGER = ("accounts", "transactions")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens(c: str) -> str:
    plain = f"regexp_replace(upper(trim(coalesce({c}, ''))), '[^A-Z0-9 ]', ' ', 'g')"
    return f"list_distinct(list_filter(regexp_split_to_array({plain}, '\\s+'), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({_STOP})))"


def _feed_type() -> str:
    said = "name || ' ' || org"
    rules_ = " ".join(f"WHEN {_m(said, p)} THEN '{t}|{u}|0'" for p, t, u in feed.TYPE_RULES)
    return f"CASE {rules_} WHEN {_m('org', feed.CARD_ONLY)} THEN 'credit|credit card|0' WHEN CAST(balance AS DOUBLE) < 0 THEN 'credit|credit card|1' ELSE 'depository|checking|1' END"


SQL = {
    "I26_I29_I35_setting_lists": _q("SELECT household_id, key, CASE WHEN value = 'broken' OR NOT starts_with(key, 'ignore') THEN '' ELSE 'A|B|' || split_part(value, '\"', 10) END AS names, CASE WHEN NOT starts_with(key, 'ignore') THEN '' WHEN value = 'broken' THEN CASE WHEN household_id % 2 = 0 THEN 'B' ELSE '' END WHEN household_id % 2 = 0 THEN 'A|B|' || split_part(value, '\"', 10) ELSE 'A|' || split_part(value, '\"', 10) END AS toggled, CASE WHEN value = 'broken' OR NOT starts_with(key, 'pace') THEN '' ELSE 'x|' || split_part(value, '\"', 6) END AS paced FROM kept", "kept"),
    "A18_A39_B19_settings_put": _q("SELECT household_id, key, value FROM kept WHERE NOT starts_with(key, 'income') UNION ALL SELECT household_id, key, '7' FROM kept WHERE starts_with(key, 'income') AND length(key) % 2 = 0", "kept"),
    "I01_I03_I15_I30_text": _q(f"SELECT id, {_KEY} AS key, trim(regexp_replace(regexp_replace(regexp_replace(upper(coalesce(merchant_name, '')), '[0-9#*]+', ' ', 'g'), '[^A-Z ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS merchant, upper(regexp_replace(trim(coalesce(description, '')), '\\s+', ' ', 'g')) AS plain, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS alike, coalesce(user_description, '') AS cell FROM (SELECT *, {_tokens('description')} AS a, {_tokens('merchant_name')} AS b FROM transactions)", "transactions"),
    "A13_A14_coverage_start": _q("SELECT account_id, min(date) AS first, count(*) AS ids, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM transactions WHERE external_id LIKE 'sfin:%' GROUP BY 1", "transactions"),
    "A15_A16_D09_tax_year_scan": _q("SELECT id, coalesce(entity_id, account_entity) AS entity_id, id % 13 = 0 AS receipt FROM vb", *_LEDGER, then=rows("year(date) = 1996", False)),
    "A09_snapshot_scan": _q("SELECT account_id, captured_on, CAST(balance AS DOUBLE) AS balance FROM snapshots WHERE captured_on >= DATE '2024-01-15' AND account_id IN (SELECT account_id FROM accounts WHERE NOT hidden)", "accounts", "snapshots"),
    "A11_A12_rule_bag": _q("SELECT household_id, merchant_key, string_agg(e, '|' ORDER BY e) AS entries FROM (SELECT *, coalesce(CAST(CAST(amount AS INT) AS VARCHAR), 'any') || ':' || category AS e FROM rules) GROUP BY 1, 2", "rules"),
    "B06_set_rules": _q("SELECT household_id, merchant_key, CASE WHEN merchant_key = 'AMAZON' THEN 'Parcels' ELSE category END AS category, CAST(amount AS DOUBLE) AS amount FROM rules WHERE merchant_key <> 'AMAZON COM'", "rules"),
    "A31_A33_feed_accounts": _q(f"SELECT household_id, 'a' || k AS external_id, org AS org_key, split_part(y, '|', 1) AS type, split_part(y, '|', 2) AS subtype, split_part(y, '|', 3) = '1' AS uncertain, CASE WHEN split_part(y, '|', 1) IN ('credit', 'loan') THEN abs(CAST(balance AS DOUBLE)) ELSE CAST(balance AS DOUBLE) END AS balance, CASE WHEN posted > 0 THEN CAST(DATE '1970-01-01' + CAST(posted // 86400 AS INT) AS DATE) END AS balance_on FROM (SELECT *, {_feed_type()} AS y FROM feeds)", "feeds"),
    "A30_I42_feed_transactions": _q("SELECT household_id, 't' || k AS external_id, CAST(DATE '1970-01-01' + CAST(posted // 86400 AS INT) AS DATE) AS date, -CAST(value AS DOUBLE) AS amount, CASE WHEN description = '' THEN 'Payee' ELSE description END AS description FROM feeds WHERE posted > 0 AND value <> 'x'", "feeds"),
    "A34_A37_feed_messages": _q("SELECT household_id, CASE k % 6 WHEN 1 THEN 'capped' WHEN 2 THEN 'advisory' WHEN 4 THEN 'capped' WHEN 5 THEN 'advisory' ELSE 'error' END AS kind, message, count(*) AS n FROM feeds GROUP BY 1, 2, 3", "feeds"),
    "B04_changed_snapshots": _q("SELECT account_id, DATE '2026-01-01' AS captured_on, CAST(current_balance + 1 AS DOUBLE) AS balance FROM accounts WHERE account_id % 2 = 0", "accounts"),
    "B02_pulled_accounts": _q("SELECT account_id, type, hidden, CAST(current_balance AS DOUBLE) + CASE WHEN account_id % 5 = 0 THEN 0 ELSE 1 END AS balance FROM accounts UNION ALL SELECT account_id + 1000000, 'credit', true, CAST(current_balance AS DOUBLE) + 1 FROM accounts WHERE account_id % 5 = 0", "accounts"),
    "D10_H04_H07_category_lists": _q("SELECT household_id, name, bool_or(k) AS known, bool_or(NOT k) AS used FROM (SELECT household_id, trim(name) AS name, true AS k FROM registry UNION ALL SELECT household_id, coalesce(nullif(user_category, ''), nullif(mapped_category, ''), 'Uncategorized'), false FROM transactions) WHERE name NOT IN ('Transfers and card payments', 'Return', 'Uncategorized') GROUP BY 1, 2", "registry", "transactions"),
    "F11_H01_by_day": _q("SELECT household_id, date, id, row_number() OVER (PARTITION BY household_id ORDER BY date DESC, amount DESC, id) AS position, count(*) OVER (PARTITION BY household_id, date) AS of_day FROM vb", *_LEDGER, then=rows(_MONTH, False)),
    "G02_amortization_schedule": "WITH RECURSIVE " + fixture.ctes("accounts") + ", " + _DEBTS + """, z AS (SELECT household_id, account_id, 0 AS month, 0.0::DOUBLE AS payment, 0.0::DOUBLE AS interest, floor(balance * 100 + 0.5) AS bal, monthly_rate * 1200 / 1200 AS r, floor(minimum_payment * 100 + 0.5) AS pay FROM debts),
 step AS (SELECT * FROM z UNION ALL SELECT household_id, account_id, month + 1, least(pay, bal + c), c, bal + c - least(pay, bal + c), r, pay FROM (SELECT *, floor(bal * r + 0.5) AS c FROM step) WHERE bal > 0 AND pay > c AND month < 600)
 SELECT household_id, account_id, month, payment / 100 AS payment, interest / 100 AS interest, bal / 100 AS balance FROM step WHERE month > 0""",
    "K06_account_sections": _q("SELECT household_id, type, CAST(sum(CASE WHEN type IN ('credit', 'loan') THEN -current_balance ELSE current_balance END) AS DOUBLE) AS total, count(*) AS accounts FROM accounts WHERE NOT hidden GROUP BY 1, 2", "accounts"),
    "M06_E09_overview": _q("SELECT household_id, coalesce(a, 0.0) AS last_month, coalesce(b, 0.0) AS last_to_date, coalesce(c, 0.0) AS spent FROM (SELECT household_id, CAST(sum(amount) AS DOUBLE) AS a, CAST(sum(CASE WHEN day(date) <= 15 THEN amount END) AS DOUBLE) AS b FROM u WHERE counted GROUP BY 1) FULL JOIN (SELECT household_id, CAST(sum(amount) AS DOUBLE) AS c FROM v WHERE counted AND day(date) <= 15 GROUP BY 1) USING (household_id)", *_LEDGER, then=rows(_MONTH) + ", " + rows("date BETWEEN DATE '1995-05-01' AND DATE '1995-05-31'", name="u")),
    "K10_drill_down": _q("SELECT household_id, id, category, date FROM v WHERE counted AND category IN ('Work', 'URGENT', 'HIGH')", *_LEDGER, then=rows(_MONTH)),
    "K03_budget_left": _q("SELECT n.household_id, 600.0 - coalesce(CAST(sum(s) AS DOUBLE), 0.0) AS \"left\" FROM (SELECT CAST(n_nationkey AS INT) AS household_id FROM nation) n LEFT JOIN groups g ON g.household_id = n.household_id AND g.category IN ('URGENT', 'HIGH') GROUP BY 1", *_LEDGER, then=rows(_MONTH) + ", " + _GROUPS),
    "K05_due_soon": _q("SELECT household_id, CAST(sum(amount) AS DOUBLE) AS due, count(*) AS n FROM expected WHERE status = 'pending' AND due_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-08' GROUP BY 1", "expected"),
    "E24_most_frequent": _q("SELECT household_id, source, arg_max(merchant_name, (n, -reached)) AS merchant_name FROM (SELECT household_id, source, merchant_name, count(*) AS n, max(position) AS reached FROM (SELECT *, row_number() OVER (PARTITION BY household_id, source ORDER BY id) AS position FROM transactions) WHERE coalesce(merchant_name, '') <> '' AND source IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2", "transactions"),
    "E25_medians": _q("SELECT category, median(CAST(amount AS DOUBLE)) AS median, count(*) AS n FROM v WHERE counted GROUP BY 1", *_LEDGER, then=rows("true", False)),
    "J06_A36_pull_window": _q("SELECT account_id, greatest(max(date) - 30, DATE '1998-08-10' - 730, DATE '1998-08-10' - 88) AS ask_from FROM transactions GROUP BY 1", "transactions"),
    "B12_H06_restorable": _q("SELECT household_id, account_id FROM accounts WHERE hidden AND account_id % 2 = 0", "accounts"),
    "A38_connection_status": _q("SELECT household_id, institution, count(*) AS accounts, count(*) FILTER (WHERE hidden) AS hidden, arg_max(name, account_id) AS latest FROM accounts GROUP BY 1, 2", "accounts"),
    "B05_C12_row_edits": _q("SELECT household_id, CASE WHEN id % 10 = 1 THEN 'Gifts' ELSE category END AS category, count(*) FILTER (WHERE CASE WHEN id % 10 = 1 THEN NOT excluded AND account_type <> 'loan' AND amount <> 0 ELSE counted END) AS counted FROM v GROUP BY 1, 2", *_LEDGER, then=rows("true", False)),
}
