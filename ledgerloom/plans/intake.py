"""Statement files, feed messages, rows by hand, chats and the report as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import amount
from ..operators import balances, chats, envelopes, importing, manual, recurring, report, rules
from ..sources import feed, statement_csv, statement_runs
from . import fixture
from .more import _book
from .oracles import _DEBTS, _WALK, _m, _q, fnv, rows

KEYS = ["household_id", "account_id"]
VIEW, TODAY = "1996-06-01", "1996-06-30"
col, lit = F.col, F.lit

#: What a statement says of each order: plain, with an inch mark, or with a comma, quotes and a line break.
_SAID = """CASE WHEN row % 8 = 0 THEN description_cell || ', "Inc"' || chr(10) || 'Unit 5' WHEN row % 5 = 1 THEN description_cell || ' 55" TV' ELSE description_cell END"""
#: Printed text of each order on its account's statement of the month.
_PRINTED = """SELECT CAST(c_nationkey AS INT) AS household_id, o_custkey AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate AS DATE) AS date, o_orderkey AS id, 'Vendor ' || CAST(o_orderkey % 50 AS STRING) AS description,
 CAST(floor(o_totalprice) AS BIGINT) AS dollars FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
fixture.ALL["printed"] = _PRINTED
#: Weekly bills of every account, of which none to five cycles were paid, a day early or late.
fixture.ALL["paid"] = """SELECT CAST(c_nationkey AS INT) AS household_id, c_custkey * 10 + j AS id, c_custkey AS account_id, CAST(DATE '1996-03-01' + CAST(c_custkey % 5 + 7 * j + (c_custkey + j) % 3 - 1 AS INT) AS DATE) AS date, CAST(20 + c_custkey % 50 AS DECIMAL(14,2)) AS amount, 'Gym ' || chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + c_custkey % 23 AS INT)) || ' Club' AS description
 FROM {customer} JOIN (VALUES (0), (1), (2), (3), (4)) AS cycles(j) ON j < c_custkey % 6"""
fixture.ALL["billed"] = """SELECT CAST(c_nationkey AS INT) AS household_id, c_custkey AS id, 'K' || CAST(c_custkey AS STRING) AS recurring_key, c_custkey AS account_id, CAST(DATE '1996-03-01' + CAST(c_custkey % 5 AS INT) AS DATE) AS due_date, 'Gym ' || chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + c_custkey % 23 AS INT)) || ' Club' AS description,
 CAST(20 + c_custkey % 50 AS DECIMAL(14,2)) AS amount, CASE WHEN c_custkey % 7 = 0 THEN 'once' ELSE 'weekly' END AS cadence, CASE WHEN c_custkey % 11 = 0 THEN 'dismissed' ELSE 'pending' END AS status FROM {customer}"""
_RUN_KEYS = ["household_id", "account_id", "month"]


def _files(s: SparkSession, d: str) -> DataFrame:
    """A CSV file per account, as its bank would write it: lines above the header, one or two amount columns, any line ends."""
    cells = fixture.load(s, d, "cells").withColumn("said", F.expr(_SAID))
    quoted = F.when(col("said").rlike('[,\n]'), F.concat(lit('"'), F.replace("said", lit('"'), lit('""')), lit('"'))).otherwise(col("said"))
    two, blank = col("account_id") % 2 == 0, lit("")
    money = F.when(two & (col("row") % 2 == 0), F.concat("amount_cell", lit(","))).when(two, F.concat(lit(","), "amount_cell")).otherwise(col("amount_cell"))
    lines = cells.select(*KEYS, "row", F.concat_ws(",", "date_cell", quoted, money).alias("line"))
    of = lines.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]).alias("lines"))
    head = F.array(lit("My Bank, Inc."), blank, F.concat(lit("Account,"), col("account_id").cast("string")), F.when(two, "Date,Memo,Debit,Credit").otherwise("Posting Date,Description,Amount"))
    return of.select(*KEYS, F.array_join(F.concat(head, "lines"), "\u0001").alias("text"), (col("account_id") % 3).alias("k")).select(*KEYS, F.replace("text", lit("\u0001"), F.when(col("k") == 0, "\r\n").when(col("k") == 1, "\n").otherwise("\r")).alias("text"))


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Each statement's runs of text: a title with the period, and a line for each order whose runs are not quite level."""
    printed = fixture.load(s, d, "printed").withColumn("k", F.row_number().over(importing.Window.partitionBy(*_RUN_KEYS).orderBy("date", "id")))
    run = lambda x, w, y, text: F.struct(F.lit(1).alias("page"), F.lit(x).cast("double").alias("x") if isinstance(x, int) else x.cast("double").alias("x"), w.cast("double").alias("w"), y.cast("double").alias("y"), lit(9.0).alias("h"), text.alias("text"))
    y, money = 100 + 12 * col("k"), F.concat(lit("$"), F.format_number("dollars", 2))
    style = F.when(col("id") % 3 == 0, F.date_format("date", "MMM d")).when(col("id") % 3 == 1, F.date_format("date", "d MMMM")).otherwise(F.date_format("date", "M/d/yyyy"))
    words = F.split("description", " ")
    body = printed.select(*_RUN_KEYS, F.inline(F.array(run(40, lit(40), y, style), run(150, lit(40), y + 1, words[0]), run(195, lit(20), y - 1, words[1]), run(560 - 5 * F.length(money), 5 * F.length(money), y, money))))
    last = F.last_day("month")
    title = printed.select(*_RUN_KEYS).distinct().select(*_RUN_KEYS, F.inline(F.array(run(40, lit(200), lit(20), F.concat(lit("Statement for "), F.date_format("month", "MMM d"), lit(" - "), F.date_format(last, "MMM d, yyyy"))), run(300, lit(100), lit(40), lit("Revised 01/05/1990")))))
    return title.unionByName(body)


def queries() -> dict:
    def cells_of_files(s: SparkSession, d: str) -> DataFrame:
        return statement_csv.statement_cells(_files(s, d), KEYS)

    def built_of_files(s: SparkSession, d: str) -> DataFrame:
        built = importing.built(cells_of_files(s, d))
        return built.select(*KEYS, "row", "date", amount(col("amount")).alias("amount"), "description", "external_id", "reason")

    def batches(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d)["transactions"]
        files = t.select("household_id", F.floor(col("id") / 8).alias("batch"), col("id").alias("position"), F.concat(lit("f"), col("id").cast("string"), F.when(col("account_id") % 5 == 0, ".PDF").otherwise(".csv")).alias("name"), F.when(col("id") % 40 == 1, "application/pdf").otherwise("text/csv").alias("mime"))
        return statement_csv.batch_plan(files.withColumn("kind", statement_csv.file_kind(col("name"), col("mime"))), ["household_id", "batch"])

    def printed_cells(s: SparkSession, d: str) -> DataFrame:
        placed = statement_runs.lined(_runs(s, d), _RUN_KEYS)
        return statement_runs.line_cells(placed, _RUN_KEYS, [0.17, 0.75], 600.0).where("line >= 2").select(*_RUN_KEYS, "line", "cell", "text", "start")

    def printed_rows(s: SparkSession, d: str) -> DataFrame:
        """Dates and amounts of the lines, by the statement's own period."""
        placed = statement_runs.lined(_runs(s, d), _RUN_KEYS).transform(importing.held)
        cells = statement_runs.line_cells(placed, _RUN_KEYS, [0.17, 0.75], 600.0)
        table = cells.groupBy(*_RUN_KEYS, "line").agg(*(F.max(F.when(col("cell") == k, col("text"))).alias(n) for k, n in enumerate(("date_cell", "description", "amount_cell"))))
        table = table.where(statement_runs.looks_like_date(col("date_cell")) & statement_runs.looks_like_money(col("amount_cell")))
        both = table.join(statement_runs.year_windows(placed, _RUN_KEYS), _RUN_KEYS)
        return both.select(*_RUN_KEYS, "line", statement_runs.flexible_date(col("date_cell"), col("first"), col("last")).alias("date"), "description", amount(importing.parse_money(col("amount_cell"))).alias("amount"), "first", "last", "source")

    def backlog(s: SparkSession, d: str) -> DataFrame:
        """Backlogs of up to five weeks, settled in one call."""
        paid = fixture.load(s, d, "paid").withColumn("merchant_name", lit(None).cast("string"))
        done = recurring.settle_all(fixture.load(s, d, "billed"), paid, "1996-05-01")
        return done.select("household_id", "origin", "due_date", "status", "matched_tx_id")

    def sections(s: SparkSession, d: str) -> DataFrame:
        said = F.expr("CASE id % 6 WHEN 0 THEN 'Deposits and additions' WHEN 1 THEN 'Checks paid' WHEN 2 THEN 'Total fees 12' WHEN 3 THEN 'Hello' WHEN 4 THEN 'Other Withdrawals' ELSE 'Payments and credits' END")
        t = _book(s, d)["transactions"]
        return t.groupBy("household_id", said.alias("heading")).agg(F.count("*").alias("n")).select("household_id", "heading", "n", statement_runs.section(col("heading")).alias("section"))

    def messages(s: SparkSession, d: str) -> DataFrame:
        text = F.expr("CASE k % 7 WHEN 0 THEN 'Date range capped' WHEN 1 THEN 'Credentials expired' WHEN 2 THEN '' WHEN 3 THEN 'The date range requested exceeds the limit and <b>was</b> capped' WHEN 4 THEN 'hello there' WHEN 5 THEN 'requested range maximum' ELSE 'Note' END")
        code = F.expr("CASE k % 5 WHEN 0 THEN 'date-range capped' WHEN 1 THEN 'DATE_RANGE_EXCEEDED' WHEN 2 THEN 'ODD' ELSE '' END")
        entry = F.struct(text.alias("msg"), code.alias("code"), F.when(col("k") % 3 == 0, "c1").alias("conn_id"))
        raw = fixture.load(s, d, "feeds").select("household_id", F.to_json(F.struct(F.array(entry).alias("errlist"), F.array(F.concat(lit("v1 "), "message")).alias("errors"))).alias("json"))
        return feed.feed_messages(feed.parsed(raw)).groupBy("household_id", "message", "kind").agg(F.count("*").alias("n"))

    def banks(s: SparkSession, d: str) -> DataFrame:
        """Accounts whose bank stands in the envelope's connections."""
        f = fixture.load(s, d, "feeds")
        connection = F.struct(lit("c1").alias("conn_id"), lit("My label").alias("name"), F.when(col("k") % 2 == 0, col("org")).alias("org_name"), F.when(col("k") % 3 == 0, "https://Bank.example/x").alias("org_url"))
        account = F.struct(F.when(col("k") % 5 == 0, "c2").otherwise("c1").alias("conn_id"), F.concat(lit("a"), col("k").cast("string")).alias("id"), "name", "balance")
        raw = f.select("household_id", F.to_json(F.struct(F.array(connection).alias("connections"), F.array(account).alias("accounts"))).alias("json"))
        return feed.feed_accounts(feed.parsed(raw)).select("household_id", "external_id", "org_key", "type", "subtype")

    def made_accounts(s: SparkSession, d: str) -> DataFrame:
        a = _book(s, d)["accounts"]
        kind = F.when(col("account_id") % 6 == 0, "boat").otherwise(F.when(col("type") == "depository", col("subtype")).otherwise(col("type")))
        told = F.when(col("account_id") % 7 == 0, "x").when(col("account_id") % 8 == 0, F.concat(lit("-"), col("current_balance").cast("string"))).otherwise(col("current_balance").cast("string"))
        made = manual.account_rows(a.select("household_id", F.when(col("account_id") % 4 != 0, F.concat(lit(" "), "name")).alias("name"), kind.alias("kind"), told.alias("balance")))
        return made.groupBy("household_id", "type", "subtype", "problem").agg(F.count("*").alias("n"), F.count_if(col("name") == "Imported account").alias("unnamed"), amount(F.sum("current_balance")).alias("balance"))

    def hand_balances(s: SparkSession, d: str) -> DataFrame:
        a = _book(s, d)["accounts"].withColumn("source", F.when(col("account_id") % 3 != 0, "manual").otherwise("feed"))
        told = F.expr("CASE account_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN '-3.5' WHEN 2 THEN CAST(current_balance AS STRING) ELSE '12.345' END")
        return manual.balance_edits(a, a.select(*KEYS, told.alias("balance"))).withColumn("balance", amount(col("balance")))

    def hand_rows(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d).visible()
        entries = t.select("household_id", "id", "account_id", "date", F.when(col("id") % 15 == 0, "ten").otherwise(col("amount").cast("string")).alias("amount"), F.concat(lit(" "), "description").alias("description"), F.when(col("id") % 3 == 0, "Gifts").otherwise("").alias("category"), "account_type")
        made = manual.transaction_rows(entries, fixture.load(s, d, "rules"))
        return made.select("household_id", "id", "external_id", amount(col("amount")).alias("amount"), "description", "user_category", "raw_category", "mapped_category")

    def entities(s: SparkSession, d: str) -> DataFrame:
        a = _book(s, d)["accounts"].select("household_id", col("account_id").alias("entity_id"), "name", lit(None).cast("date").alias("archived_on"))
        action = F.expr("CASE entity_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'add' END")
        first = a.select("household_id", "entity_id", lit(1).alias("position"), lit("update").alias("action"), lit("Old").alias("name"), lit(None).cast("date").alias("archived_on"))
        then = a.select("household_id", (col("entity_id") + F.when(col("entity_id") % 4 == 2, 1_000_000).otherwise(0)).alias("entity_id"), lit(2).alias("position"), action.alias("action"), F.when(col("entity_id") % 3 == 0, "New").alias("name"), F.when(col("entity_id") % 4 == 1, lit("1998-01-01").cast("date")).alias("archived_on"))
        return manual.edit_rows(a, first.unionByName(then), "entity_id", ["name", "archived_on"])

    def claims(s: SparkSession, d: str) -> DataFrame:
        a = _book(s, d)["accounts"]
        access = a.select("household_id", F.concat(lit("u"), (col("account_id") % 40).cast("string")).alias("access_url")).distinct().select("*", lit("1998-01-01").cast("date").alias("last_pulled_at"), lit(None).cast("date").alias("last_attempt_at"), lit("late").alias("last_error"))
        new = a.where("account_id % 2 = 0").select("household_id", F.concat(lit("u"), (col("account_id") % 60).cast("string")).alias("access_url"))
        off = a.where("household_id % 4 = 0").select("household_id", F.when(col("household_id") % 8 == 0, "disconnect").otherwise("yes").alias("confirm")).distinct()
        return manual.disconnect(manual.claim(access, new), off)

    def labels(s: SparkSession, d: str) -> DataFrame:
        a = _book(s, d)["accounts"]
        named = manual.unhide_label(F.when(col("account_id") % 3 == 0, "Nick"), F.when(col("account_id") % 5 != 0, col("name")), F.when(col("account_id") % 2 == 0, (col("account_id") % 10_000).cast("string")))
        return a.select(*KEYS, manual.type_label(F.when(col("account_id") % 9 == 0, "odd").otherwise(col("type")), col("subtype")).alias("label"), named.alias("named"))

    def stale(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d)["transactions"].groupBy(*KEYS).agg(F.max("date").alias("last"))
        days = manual.stale_days(col("last").cast("timestamp"), lit("1998-07-20 12:00:00").cast("timestamp"))
        return t.select(*KEYS, days.alias("stale_days"), (days >= manual.STALE_DAYS).alias("stale"))

    def boundaries(s: SparkSession, d: str) -> DataFrame:
        first = _book(s, d)["transactions"].where("source = 'simplefin' and date >= date'1995-01-01'").groupBy(*KEYS).agg(F.min("date").alias("first"))
        a = _book(s, d)["accounts"].join(first, KEYS, "left")
        day = manual.overlap_from(col("first"), F.when(col("account_id") % 4 != 0, col("created_on")), col("account_id") % 5 != 0, lit("1998-08-02").cast("date"), col("account_id") % 8 == 0)
        return a.select(*KEYS, day.alias("overlap_from"))

    def names_taken(s: SparkSession, d: str) -> DataFrame:
        wanted = _book(s, d)["transactions"].select("household_id", F.lower(F.coalesce("mapped_category", lit(""))).alias("name")).distinct().unionByName(_book(s, d)["accounts"].select("household_id", F.when(col("account_id") % 2 == 0, " return ").otherwise("New").alias("name")).distinct())
        return manual.duplicate_names(wanted, fixture.load(s, d, "registry"))

    def proof(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d)["transactions"]
        return manual.moved_with_proof(t, t.where("id % 1000 <> 1"), ["household_id", "id"])

    def topped(s: SparkSession, d: str) -> DataFrame:
        walked = envelopes.walk(*(fixture.load(s, d, n) for n in ("assignments", "envelope_spending", "settings")), VIEW)
        registry = fixture.load(s, d, "registry").where("household_id < 10")
        return envelopes.topped_up(walked, registry.select("household_id", F.trim("name").alias("category")))

    def envelope_groups(s: SparkSession, d: str) -> DataFrame:
        return envelopes.groups(topped(s, d), rules.registry_tree(fixture.load(s, d, "registry")))

    def needs(s: SparkSession, d: str) -> DataFrame:
        return envelopes.fund_needs(topped(s, d), rules.registry_tree(fixture.load(s, d, "registry")), VIEW)

    def talks(s: SparkSession, d: str) -> DataFrame:
        return s.read.parquet(f"{d}/conversations.parquet")

    def kept_turns(s: SparkSession, d: str) -> DataFrame:
        return chats.trimmed(talks(s, d)).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))

    def shelves(s: SparkSession, d: str) -> DataFrame:
        kept = chats.saved(talks(s, d)).select("*", (col("conv_id") % 9).alias("owner"), col("conv_id").alias("position"))
        return chats.shelf(kept, ["owner"]).select("owner", "conv_id", "title", "turns", "chars", "rank")

    def report_text(s: SparkSession, d: str) -> DataFrame:
        b = _book(s, d)
        return report.text(report.sections(b["accounts"], b.paired("1996-04-01", TODAY), fixture.load(s, d, "expected"), TODAY))

    def ready(s: SparkSession, d: str) -> DataFrame:
        walked = envelopes.walk(*(fixture.load(s, d, n) for n in ("assignments", "envelope_spending", "settings")), VIEW)
        income = fixture.load(s, d, "settings").where("household_id % 3 <> 0").select("household_id", lit(5000.0).alias("income")).distinct()
        return envelopes.ready_to_assign(income, envelopes.totals(walked))

    def moved(s: SparkSession, d: str) -> DataFrame:
        return envelopes.move(fixture.load(s, d, "assignments").where("month = date'1996-05-01'"), "AF", "RF", 12.34)

    def settled(s: SparkSession, d: str) -> DataFrame:
        e = fixture.load(s, d, "expected")
        done = recurring.settle(e, e.where("id % 7 = 1"), e.where("id % 7 = 2"))
        return done.select("household_id", "id", "recurring_key", "account_id", "due_date", "cadence", "status")

    def added(s: SparkSession, d: str) -> DataFrame:
        e = fixture.load(s, d, "expected")
        new = e.where("id % 3 = 0").select(*((col("id") + 20_000_000_000).alias("id") if c == "id" else F.date_add("due_date", 1).alias("due_date") if c == "due_date" else lit("pending").alias("status") if c == "status" else col(c) for c in e.columns))
        return recurring.add(e, new).select("household_id", "id", "due_date", "status")

    def institutions(s: SparkSession, d: str) -> DataFrame:
        f = fixture.load(s, d, "feeds")
        held = f.select("household_id", col("org").alias("org_key")).distinct().where("household_id % 3 <> 0").select("*", (col("household_id") + 100).alias("institution_id"), (col("household_id") % 3 == 1).alias("disabled"))
        return feed.resolve_institutions(held, f.select("household_id", col("org").alias("org_key")))

    def text_cells(s: SparkSession, d: str) -> DataFrame:
        """Each cell's date and money as they are read."""
        c = fixture.load(s, d, "cells")
        return c.select(*KEYS, "row", importing.parse_date(col("date_cell")).alias("date"), amount(importing.parse_money(col("amount_cell"))).alias("money"))

    def worded(s: SparkSession, d: str) -> DataFrame:
        t = _book(s, d).visible()
        return t.select("household_id", "id", rules.raw_category(col("description"), col("amount"), col("account_type")).alias("raw"), rules.guarded(col("description"), col("amount"), col("account_type")).alias("guarded"))

    def free(s: SparkSession, d: str) -> DataFrame:
        b = balances.debts(_book(s, d)["accounts"])
        return b.groupBy("household_id").agg(F.count_if("mortgage").alias("mortgages"), F.count("utilisation").alias("cards"), F.round(F.max("utilisation"), 6).alias("most_used"), F.round(F.sum("progress"), 4).alias("progress"))

    return {
        "M13_J07_settled_backlog": backlog, "A19_A20_J03_statement_files": cells_of_files, "J03_I14_statement_rows": built_of_files, "A28_file_batches": batches, "A22_A23_printed_cells": printed_cells, "A26_I12_I13_I37_printed_rows": printed_rows, "I25_section_headings": sections,
        "A34_A35_A37_feed_messages_v2": messages, "A31_A32_feed_banks_v2": banks, "B10_manual_accounts": made_accounts, "B10_manual_balances": hand_balances, "B10_manual_transactions": hand_rows, "B18_entity_edits": entities, "B22_claims": claims,
        "C21_type_labels": labels, "C14_stale_balances": stale, "J04_overlap_from": boundaries, "I33_duplicate_names": names_taken, "B17_move_proof": proof, "K04_envelope_rows": topped, "K04_envelope_groups": envelope_groups, "K04_fund_needs": needs,
        "I27_chat_turns": kept_turns, "I40_saved_chats": shelves, "M18_A40_report": report_text, "F04_ready_to_assign": ready, "F05_B08_move": moved, "B11_J07_settled": settled, "B11_added": added, "B03_institutions": institutions, "I09_I11_cells": text_cells, "I05_I07_wording": worded, "C22_K07_debt_measures": free,
    }


def _sql() -> dict[str, str]:
    from .oracles import _DUE, _GUARD, _LEARNED, SQL as core

    ledger = ("accounts", "transactions")
    file_cells = f"fc AS (SELECT household_id, account_id, CAST(3 + row_number() OVER (PARTITION BY household_id, account_id ORDER BY row) AS INT) AS row, date_cell, {_SAID} AS description_cell, CASE WHEN account_id % 2 = 0 THEN CASE WHEN row % 2 = 0 THEN amount_cell ELSE '' END END AS debit_cell, CASE WHEN account_id % 2 = 0 THEN CASE WHEN row % 2 = 0 THEN '' ELSE amount_cell END END AS credit_cell, CASE WHEN account_id % 2 = 1 THEN amount_cell END AS amount_cell FROM cells)"
    legal = core["E19_D14_category_rollup"].split("trimmed AS (", 1)[1]
    legal = "trimmed AS (" + legal.rsplit(" SELECT household_id, coalesce(parent, category)", 1)[0]
    printed = """pr AS (SELECT *, 1 + row_number() OVER (PARTITION BY household_id, account_id, month ORDER BY date, id) AS line, '$' || format('{:,}', dollars) || '.00' AS money FROM printed)"""
    topped = "top AS (SELECT household_id, category, assigned, rolled_over, spent, available, target, target_kind, target_date, rollover, target_override FROM walked UNION ALL SELECT DISTINCT household_id, trim(name), 0.0, 0.0, 0.0, 0.0, CAST(NULL AS DOUBLE), 'monthly', CAST(NULL AS DATE), true, CAST(NULL AS DOUBLE) FROM registry r WHERE household_id < 10 AND NOT EXISTS (SELECT 1 FROM walked w WHERE w.household_id = r.household_id AND w.category = trim(r.name)))"
    envelopes_ = ("assignments", "envelope_spending", "settings")
    fmt = lambda c: f"format('{{:,.2f}}', CAST({c} AS DOUBLE))"
    trimmed = f"""tc AS (SELECT conv_id, turn, role, substr(text, 1, {chats.TURN_CHARS}) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL),
 tr AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM tc WHERE n <= {chats.TURNS}), ts AS (SELECT * FROM tr WHERE n = 1 OR total <= {chats.ALL_CHARS}), tk AS (SELECT * FROM ts WHERE turn >= (SELECT min(turn) FROM ts u WHERE u.conv_id = ts.conv_id AND u.role = 'user'))"""
    range_ = "date BETWEEN DATE '1996-04-01' AND DATE '1996-06-30'"
    name = "coalesce(nullif(user_description, ''), CASE WHEN NOT regexp_full_match(coalesce(merchant_name, ''), '[\\s*·.xX_-]+') THEN nullif(merchant_name, '') END, CASE WHEN NOT regexp_full_match(coalesce(description, ''), '[\\s*·.xX_-]+') THEN nullif(description, '') END, 'Card transaction')"
    lines = f"""ln AS (SELECT household_id, 1 AS section, row_number() OVER (PARTITION BY household_id ORDER BY type, name, account_id) AS rank, 'account ' || name || ' (' || type || '): ' || {fmt("CASE WHEN type IN ('credit', 'loan') THEN -current_balance ELSE current_balance END")} AS line FROM accounts WHERE NOT hidden
 UNION ALL SELECT household_id, 2, row_number() OVER (PARTITION BY household_id ORDER BY m), 'month ' || m || ': in ' || {fmt("i")} || ', out ' || {fmt("o")} FROM (SELECT household_id, strftime(date, '%Y-%m') AS m, sum(CASE WHEN income THEN -amount ELSE 0 END) AS i, sum(CASE WHEN counted THEN amount ELSE 0 END) AS o FROM v GROUP BY 1, 2)
 UNION ALL SELECT household_id, 3, row_number() OVER (PARTITION BY household_id ORDER BY s DESC, category), 'category ' || category || ': ' || {fmt("s")} || ' in ' || n FROM (SELECT household_id, category, sum(amount) AS s, count(*) AS n FROM v WHERE counted GROUP BY 1, 2)
 UNION ALL SELECT household_id, 4, row_number() OVER (PARTITION BY household_id ORDER BY balance DESC, account_id), 'debt ' || name || ': ' || {fmt("balance")} FROM debts
 UNION ALL SELECT household_id, 5, row_number() OVER (PARTITION BY household_id ORDER BY due_date, id), 'due ' || due_date || ' ' || description || ': ' || {fmt("amount")} FROM expected WHERE status = 'pending' AND due_date BETWEEN DATE '1996-06-30' AND DATE '1996-07-31'
 UNION ALL SELECT household_id, 6, k, date || ' ' || {name} || ' [' || category || ']: ' || {fmt("amount")} FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY date DESC, id DESC) AS k FROM v WHERE counted) WHERE k <= 20)"""
    said = "CASE k % 7 WHEN 0 THEN 'Date range capped' WHEN 1 THEN 'Credentials expired' WHEN 2 THEN '' WHEN 3 THEN 'The date range requested exceeds the limit and was capped' WHEN 4 THEN 'hello there' WHEN 5 THEN 'requested range maximum' ELSE 'Note' END"
    code = "CASE k % 5 WHEN 0 THEN 'date-range capped' WHEN 1 THEN 'DATE_RANGE_EXCEEDED' WHEN 2 THEN 'ODD' ELSE '' END"
    kind_ = f"CASE WHEN {_m('m', feed.TROUBLE)} THEN 'error' WHEN k % 5 = 0 THEN 'capped' WHEN k % 5 = 1 THEN 'advisory' WHEN k % 3 = 0 OR k % 7 NOT IN (0, 3, 5) THEN 'error' ELSE 'capped' END"
    v1 = core_messages()
    chain = """RECURSIVE walk AS (SELECT household_id, id AS origin, account_id, due_date, cadence, status, (SELECT p.id FROM paid p WHERE p.household_id = b.household_id AND p.account_id = b.account_id AND b.status = 'pending' AND abs(datediff('day', b.due_date, p.date)) <= 2) AS tx FROM billed b
 UNION ALL SELECT household_id, origin, account_id, CAST(due_date + 7 AS DATE), cadence, status, (SELECT p.id FROM paid p WHERE p.household_id = w.household_id AND p.account_id = w.account_id AND abs(datediff('day', w.due_date + 7, p.date)) <= 2) FROM walk w WHERE tx IS NOT NULL AND cadence = 'weekly')"""
    return {
        "M13_J07_settled_backlog": "WITH " + chain.replace("walk AS (", fixture.ctes("paid", "billed") + ", walk AS (", 1) + " SELECT household_id, origin, due_date, CASE WHEN tx IS NULL THEN status ELSE 'matched' END AS status, tx AS matched_tx_id FROM walk",
        "A19_A20_J03_statement_files": _q("SELECT * FROM fc", "cells", then=file_cells),
        "J03_I14_statement_rows": _q(
            f"SELECT household_id, account_id, row, date, CAST(amount AS DOUBLE) AS amount, description, CASE WHEN reason IS NULL THEN 'csv:' || {fnv('key')} || ':' || (row_number() OVER (PARTITION BY household_id, account_id, key ORDER BY row) - 1) END AS external_id, reason FROM (SELECT *, CASE WHEN reason IS NULL THEN date || '|' || amount || '|' || upper(regexp_replace(trim(description, ' ' || chr(10)), '\\s+', ' ', 'g')) END AS key FROM (SELECT household_id, account_id, row, date, description, CAST(v AS DECIMAL(14,2)) AS amount, CASE WHEN concat_ws(', ', a, b, c) <> '' THEN concat_ws(', ', a, b, c) WHEN abs(v) < 0.005 THEN 'zero amount' END AS reason FROM (SELECT *, CASE WHEN date IS NULL THEN 'unparseable date' END AS a, CASE WHEN v IS NULL THEN 'unparseable amount' END AS b, CASE WHEN description = '' THEN 'empty description' END AS c FROM pc)))",
            "cells", then=file_cells + """, px AS (SELECT *, trim(date_cell) AS d, trim(coalesce(nullif(debit_cell, ''), nullif(credit_cell, ''), amount_cell)) AS t FROM fc),
 py AS (SELECT *, try_cast(regexp_replace(t, '[$()]', '', 'g') AS DECIMAL(18,4)) AS n FROM px),
 pc AS (SELECT household_id, account_id, row, trim(description_cell) AS description, CASE WHEN regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(d AS DATE) WHEN d LIKE '%/%' THEN try_cast(split_part(d, '/', 3) || '-' || lpad(split_part(d, '/', 1), 2, '0') || '-' || lpad(split_part(d, '/', 2), 2, '0') AS DATE) END AS date,
  CASE WHEN account_id % 2 = 1 THEN -(CASE WHEN starts_with(t, '(') THEN -n ELSE n END) WHEN debit_cell <> '' THEN abs(n) ELSE -abs(n) END AS v FROM py)""",
        ),
        "A28_file_batches": _q("SELECT household_id, batch, min(k) = max(k) AS ok, CASE WHEN min(k) = max(k) THEN min(k) END AS kind, string_agg(f, ', ' ORDER BY id) AS files, count(*) AS n FROM (SELECT household_id, id // 8 AS batch, id, 'f' || id || CASE WHEN account_id % 5 = 0 THEN '.PDF' ELSE '.csv' END AS f, CASE WHEN account_id % 5 = 0 OR id % 40 = 1 THEN 'pdf' ELSE 'csv' END AS k FROM transactions) GROUP BY 1, 2", "transactions"),
        "A22_A23_printed_cells": _q("SELECT household_id, account_id, month, CAST(line AS INT) AS line, cell, text, start FROM (SELECT *, 0 AS cell, CASE id % 3 WHEN 0 THEN strftime(date, '%b %-d') WHEN 1 THEN strftime(date, '%-d %B') ELSE strftime(date, '%-m/%-d/%Y') END AS text, 40.0 AS start FROM pr UNION ALL SELECT *, 1, description, 150.0 FROM pr UNION ALL SELECT *, 2, money, CAST(560 - 5 * length(money) AS DOUBLE) FROM pr)", "printed", then=printed),
        "A26_I12_I13_I37_printed_rows": _q("SELECT household_id, account_id, month, CAST(line AS INT) AS line, date, description, CAST(dollars AS DOUBLE) AS amount, CAST(month - 45 AS DATE) AS first, CAST(last_day(month) + 45 AS DATE) AS last, 'period' AS source FROM pr", "printed", then=printed),
        "I25_section_headings": _q("SELECT household_id, heading, count(*) AS n, CASE heading WHEN 'Deposits and additions' THEN 'in' WHEN 'Payments and credits' THEN 'in' WHEN 'Checks paid' THEN 'out' WHEN 'Other Withdrawals' THEN 'out' END AS section FROM (SELECT household_id, CASE id % 6 WHEN 0 THEN 'Deposits and additions' WHEN 1 THEN 'Checks paid' WHEN 2 THEN 'Total fees 12' WHEN 3 THEN 'Hello' WHEN 4 THEN 'Other Withdrawals' ELSE 'Payments and credits' END AS heading FROM transactions) GROUP BY 1, 2", "transactions"),
        "A34_A35_A37_feed_messages_v2": _q(f"SELECT household_id, message, kind, count(*) AS n FROM (SELECT household_id, m AS message, {kind_} AS kind FROM (SELECT household_id, k, CASE WHEN t <> '' AND c <> '' THEN t || ' (' || c || ')' ELSE t || c END AS m FROM (SELECT household_id, k, {said} AS t, {code} AS c FROM feeds)) WHERE m <> '' UNION ALL SELECT household_id, 'v1 ' || message, {v1} FROM feeds) GROUP BY 1, 2, 3", "feeds"),
        "A31_A32_feed_banks_v2": _q(f"SELECT household_id, external_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'bank.example' WHEN k % 2 = 0 THEN o ELSE 'My label' END AS org_key, split_part(y, '|', 1) AS type, split_part(y, '|', 2) AS subtype FROM (SELECT *, {feed_type()} AS y FROM (SELECT household_id, k, 'a' || k AS external_id, org AS o, name, balance, CASE WHEN k % 5 = 0 THEN '' WHEN k % 2 = 0 THEN org ELSE 'My label' END AS org FROM feeds))", "feeds"),
        "B10_manual_accounts": _q("SELECT household_id, type, subtype, problem, count(*) AS n, count(*) FILTER (WHERE account_id % 4 = 0) AS unnamed, CAST(sum(b) AS DOUBLE) AS balance FROM (SELECT household_id, account_id, CASE WHEN account_id % 6 = 0 OR type = 'depository' THEN 'depository' ELSE type END AS type, CASE WHEN account_id % 6 = 0 THEN 'checking' WHEN type = 'credit' THEN 'credit card' WHEN type = 'loan' THEN 'loan' ELSE subtype END AS subtype, CASE WHEN account_id % 6 <> 0 AND type <> 'depository' AND account_id % 7 <> 0 AND account_id % 8 = 0 AND current_balance > 0 THEN 'a debt is entered as a positive amount' END AS problem, CASE WHEN account_id % 6 <> 0 AND type <> 'depository' AND account_id % 7 <> 0 AND account_id % 8 <> 0 THEN current_balance END AS b FROM accounts) GROUP BY 1, 2, 3, 4", "accounts"),
        "B10_manual_balances": _q("SELECT household_id, account_id, CASE WHEN problem IS NULL THEN CAST(b AS DOUBLE) END AS balance, problem IS NULL AND b <> current_balance AS snapshot, problem FROM (SELECT *, CASE WHEN account_id % 3 = 0 THEN 'only a manual account is edited by hand' WHEN account_id % 5 = 0 THEN 'not a number' WHEN account_id % 5 = 1 AND type <> 'depository' THEN 'a debt is entered as a positive amount' END AS problem, CASE account_id % 5 WHEN 1 THEN -3.5 WHEN 2 THEN current_balance WHEN 0 THEN 0.0 ELSE 12.35 END AS b FROM accounts)", "accounts"),
        "B10_manual_transactions": _q(f"SELECT k.household_id, k.id, 'manual:' || k.id AS external_id, CAST(amount AS DOUBLE) AS amount, description, CASE WHEN k.id % 3 = 0 THEN 'Gifts' END AS user_category, CASE WHEN coalesce(account_type = 'credit' AND amount > 0, false) OR {_m('description', rules.CARD_WORD)} OR NOT {_m('description', rules.TRANSFER)} THEN '' WHEN amount > 0 THEN 'TRANSFER_OUT' WHEN amount < 0 THEN 'TRANSFER_IN' ELSE '' END AS raw_category, CASE WHEN {_GUARD} THEN 'Transfers and card payments' ELSE coalesce(learned, 'Uncategorized') END AS mapped_category FROM k LEFT JOIN best ON k.id = best.id WHERE k.id % 15 <> 0", *ledger, "rules", then=rows("true", False) + ", " + _LEARNED.format(source="vb")),
        "B18_entity_edits": _q("SELECT household_id, account_id AS entity_id, CASE WHEN account_id % 4 = 2 THEN 'Old' WHEN account_id % 3 = 0 THEN 'New' ELSE name END AS name, CASE WHEN account_id % 4 = 1 THEN DATE '1998-01-01' END AS archived_on FROM accounts WHERE account_id % 4 <> 0 UNION ALL SELECT household_id, account_id + 1000000, CASE WHEN account_id % 3 = 0 THEN 'New' END, NULL FROM accounts WHERE account_id % 4 = 2", "accounts"),
        "B22_claims": _q("SELECT a.household_id, a.u AS access_url, CASE WHEN n.u IS NULL THEN DATE '1998-01-01' END AS last_pulled_at, CAST(NULL AS DATE) AS last_attempt_at, CASE WHEN n.u IS NULL THEN 'late' END AS last_error FROM (SELECT household_id, u FROM old UNION SELECT household_id, u FROM fresh) a LEFT JOIN fresh n ON a.household_id = n.household_id AND a.u = n.u WHERE a.household_id % 8 <> 0", "accounts", then="old AS (SELECT DISTINCT household_id, 'u' || (account_id % 40) AS u FROM accounts), fresh AS (SELECT DISTINCT household_id, 'u' || (account_id % 60) AS u FROM accounts WHERE account_id % 2 = 0)"),
        "C21_type_labels": _q("SELECT household_id, account_id, CASE WHEN account_id % 9 = 0 THEN 'odd' WHEN type = 'depository' THEN CASE subtype WHEN 'checking' THEN 'Checking account' ELSE 'Savings account' END WHEN type = 'credit' THEN 'Credit card' ELSE 'Loan' END AS label, CASE WHEN account_id % 3 = 0 THEN 'Nick' ELSE CASE WHEN account_id % 5 <> 0 THEN name ELSE 'this account' END || CASE WHEN account_id % 2 = 0 THEN ' ··' || (account_id % 10000) ELSE '' END END AS named FROM accounts", "accounts"),
        "C14_stale_balances": _q("SELECT household_id, account_id, greatest(0, datediff('day', max(date), DATE '1998-07-20')) AS stale_days, greatest(0, datediff('day', max(date), DATE '1998-07-20')) >= 14 AS stale FROM transactions GROUP BY 1, 2", "transactions"),
        "J04_overlap_from": _q("SELECT household_id, account_id, CASE WHEN account_id % 5 <> 0 THEN coalesce(f, CASE WHEN account_id % 4 <> 0 THEN created_on - 88 END, CASE WHEN account_id % 8 = 0 THEN DATE '1998-07-03' END) END AS overlap_from FROM accounts LEFT JOIN (SELECT account_id, min(date) AS f FROM transactions WHERE source = 'simplefin' AND date >= DATE '1995-01-01' GROUP BY 1) USING (account_id)", *ledger),
        "I33_duplicate_names": _q("SELECT household_id, name, trim(name) <> '' AND (lower(trim(name)) IN ('uncategorized', 'return', 'transfers and card payments') OR EXISTS (SELECT 1 FROM registry r WHERE r.household_id = w.household_id AND lower(trim(r.name)) = lower(trim(w.name)))) AS taken FROM (SELECT DISTINCT household_id, lower(coalesce(mapped_category, '')) AS name FROM transactions UNION ALL SELECT DISTINCT household_id, CASE WHEN account_id % 2 = 0 THEN ' return ' ELSE 'New' END FROM accounts) w", *ledger, "registry"),
        "B17_move_proof": _q("SELECT count(*) FILTER (WHERE id % 1000 <> 1) AS copied, count(*) FILTER (WHERE id % 1000 = 1) AS missing, count(*) FILTER (WHERE id % 1000 = 1) = 0 AS safe FROM transactions", "transactions"),
        "K04_envelope_rows": _q("SELECT * FROM top", *envelopes_, "registry", then=_WALK + ", " + topped),
        "K04_envelope_groups": _q("SELECT household_id, coalesce(parent, category) AS \"group\", round(sum(assigned), 2) AS assigned, round(sum(rolled_over), 2) AS rolled_over, round(sum(spent), 2) AS spent, round(sum(available), 2) AS available, count(*) AS members FROM top LEFT JOIN legal USING (household_id, category) GROUP BY 1, 2", *envelopes_, "registry", then=_WALK + ", " + topped + ", " + legal),
        "K04_fund_needs": _q("SELECT household_id, category, floor(n * 100 + 0.5) / 100 AS need FROM (SELECT *, CASE WHEN target_override IS NOT NULL THEN target_override - assigned WHEN target IS NULL THEN 0.0 WHEN target_kind = 'by_date' THEN (target - rolled_over) / greatest(coalesce(datediff('month', DATE '1996-06-01', target_date) + 1, 1), 1) - assigned ELSE target - assigned END AS n FROM top) WHERE n > 0 AND category NOT IN ('Uncategorized', 'Return', 'Transfers and card payments') AND NOT EXISTS (SELECT 1 FROM legal l WHERE l.household_id = top.household_id AND l.parent = top.category)".replace("top.household_id", "t.household_id").replace("top.category", "t.category").replace("FROM top) WHERE", "FROM top) t WHERE"), *envelopes_, "registry", then=_WALK + ", " + topped + ", " + legal),
        "I27_chat_turns": f"WITH {trimmed} SELECT conv_id, turn, role, length(text) AS chars FROM tk",
        "I40_saved_chats": f"WITH {trimmed}, sv AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS t, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM tk GROUP BY 1), sw AS (SELECT *, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS w, conv_id % 9 AS owner, row_number() OVER (PARTITION BY conv_id % 9 ORDER BY conv_id DESC) AS rank FROM sv), sx AS (SELECT *, sum(chars) OVER (PARTITION BY owner ORDER BY rank) AS total FROM sw WHERE rank <= 10) SELECT owner, conv_id, CASE WHEN w = '' THEN 'Chat' WHEN length(w) > 60 THEN rtrim(substr(w, 1, 57)) || '…' ELSE w END AS title, turns, chars, rank FROM sx WHERE rank = 1 OR total <= 300000",
        "M18_A40_report": _q("SELECT household_id, string_agg(line, chr(10) ORDER BY section, rank) AS text FROM ln GROUP BY 1", *ledger, "expected", then=rows(range_) + ", " + _DEBTS + ", " + lines),
        "F04_ready_to_assign": _q("SELECT household_id, round(income - assigned, 2) AS ready FROM (SELECT household_id, round(sum(assigned), 2) AS assigned FROM walked WHERE assigned <> 0 OR rolled_over <> 0 OR coalesce(target_override, target) IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT DISTINCT household_id, 5000.0::DOUBLE AS income FROM settings WHERE household_id % 3 <> 0) USING (household_id)", *envelopes_, then=_WALK),
        "F05_B08_move": _q("SELECT household_id, c AS category, floor(CAST(CASE WHEN c = 'AF' THEN a - 12.34 ELSE coalesce(b, 0) + 12.34 END AS DOUBLE) * 100 + 0.5) / 100 AS assigned FROM (SELECT household_id, sum(assigned) FILTER (WHERE category = 'AF') AS a, sum(assigned) FILTER (WHERE category = 'RF') AS b FROM assignments WHERE month = DATE '1996-05-01' GROUP BY 1) CROSS JOIN (VALUES ('AF'), ('RF')) x(c) WHERE a IS NOT NULL", "assignments"),
        "B11_J07_settled": _q("SELECT household_id, id, recurring_key, account_id, due_date, cadence, status FROM kept UNION ALL SELECT household_id, NULL, recurring_key, account_id, nd, cadence, 'pending' FROM nx WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.status = 'pending' AND k.household_id = nx.household_id AND k.recurring_key = nx.recurring_key AND abs(datediff('day', k.due_date, nx.nd)) <= CASE nx.cadence WHEN 'weekly' THEN 2 WHEN 'monthly' THEN 4 WHEN 'annual' THEN 15 ELSE 0 END)", "expected", then=f"kept AS (SELECT * REPLACE (CASE WHEN status = 'pending' AND id % 7 = 1 THEN 'matched' WHEN status = 'pending' AND id % 7 = 2 THEN 'dismissed' ELSE status END AS status) FROM expected), nx AS (SELECT * FROM (SELECT *, {_DUE} AS nd FROM expected WHERE status = 'pending' AND id % 7 = 1) WHERE nd IS NOT NULL)"),
        "B11_added": _q("SELECT household_id, id, due_date, status FROM expected UNION ALL SELECT household_id, id + 20000000000, due_date + 1, 'pending' FROM expected n WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM expected k WHERE k.status = 'pending' AND k.household_id = n.household_id AND k.recurring_key = n.recurring_key AND abs(datediff('day', k.due_date, n.due_date + 1)) <= CASE n.cadence WHEN 'weekly' THEN 2 WHEN 'monthly' THEN 4 WHEN 'annual' THEN 15 ELSE 0 END)", "expected"),
        "B03_institutions": _q("SELECT household_id, org AS org_key, CASE WHEN household_id % 3 = 2 THEN household_id + 100 END AS institution_id, household_id % 3 = 0 AS fresh FROM (SELECT DISTINCT household_id, org FROM feeds) WHERE household_id % 3 <> 1", "feeds"),
        "I09_I11_cells": _q("SELECT household_id, account_id, row, CASE WHEN regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(d AS DATE) WHEN d LIKE '%/%' THEN try_cast(split_part(d, '/', 3) || '-' || lpad(split_part(d, '/', 1), 2, '0') || '-' || lpad(split_part(d, '/', 2), 2, '0') AS DATE) END AS date, CAST(CASE WHEN starts_with(t, '(') THEN -n ELSE n END AS DOUBLE) AS money FROM (SELECT *, trim(date_cell) AS d, trim(amount_cell) AS t, try_cast(regexp_replace(trim(amount_cell), '[$()]', '', 'g') AS DECIMAL(18,4)) AS n FROM cells)", "cells"),
        "I05_I07_wording": _q(f"SELECT household_id, id, CASE WHEN coalesce(account_type = 'credit' AND amount > 0, false) OR {_m('description', rules.CARD_WORD)} OR NOT {_m('description', rules.TRANSFER)} THEN '' WHEN amount > 0 THEN 'TRANSFER_OUT' WHEN amount < 0 THEN 'TRANSFER_IN' ELSE '' END AS raw, {_GUARD} AS guarded FROM vb", *ledger, then=rows("true", False)),
        "C22_K07_debt_measures": _q("SELECT household_id, count(*) FILTER (WHERE mortgage) AS mortgages, count(utilisation) AS cards, round(max(utilisation), 6) AS most_used, round(sum(progress), 4) AS progress FROM debts GROUP BY 1", "accounts", then=_DEBTS),
    }


def core_messages() -> str:
    """The kind of the first version's messages, by the key they vary with."""
    return "CASE k % 6 WHEN 1 THEN 'capped' WHEN 2 THEN 'advisory' WHEN 4 THEN 'capped' WHEN 5 THEN 'advisory' ELSE 'error' END"


def feed_type() -> str:
    from .more import _feed_type

    return _feed_type()


SQL = _sql()
