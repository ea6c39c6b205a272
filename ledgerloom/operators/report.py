"""A household's money as a text: lines of sections in order, one row per household.

``sections`` is a short overview; ``context`` is the whole report with its rules in words, as an assistant reads it.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import amount
from ..functions.storage import held
from ..functions.text import present
from ..sources.ledger import Ledger, conform
from . import balances, envelopes, matching, recurring, spending, verdicts

BY = ["household_id"]
#: How many days a report looks back, and how many of a household's newest rows it reads.
DAYS, NEWEST = 90, 1500
#: Parts into which a household's rows are dealt before its newest are chosen.
PARTS = 64

# The report's wording, in its order.
ACCOUNTS = ["## Accounts", "Credit card and loan balances are negative: that is the amount owed."]
MONTHS = [
    "", "## Monthly spending by category (last 90 days)",
    "Transaction amounts (unlike the balances above): positive is money out. These totals already apply the app's spending rule, the same one the dashboard uses: "
    "a REFUND on a credit card is negative and SUBTRACTS from its category (so a returned item nets to zero); money into a checking or savings account is income and does not count as spending "
    "unless the household explicitly marked that row a Refund, in which case it subtracts like a card refund; money OUT of an account that they marked Income is income given back "
    "(an overpayment returned to its sender) and LOWERS the income for that month rather than counting as spending; a row the household marked Income counts as income whatever account it sits on, "
    "including a credit card, though only checking and savings are counted as income automatically; card payments never count; and a transfer counts UNLESS it was matched to an equal-amount opposite leg "
    "on another of the household's own visible accounts. A category total can therefore be negative when refunds outweighed purchases. Quote these totals rather than re-adding the transaction rows below.",
]
PARTIAL = "The window starts {since}, so {month} is INCOMPLETE: its lines below cover {since} to the end of that month only, and its earlier days are missing. Say so if you quote them — never present {month} as a full month's total."
RECURRING = ["", "## Recurring charges (detected from the transactions below)"]
ENVELOPES = "Envelope model: available = assigned + carried over - spent. Assigned/target are budget dollars (positive); spent is money out this month. A negative available is overspending carried in the category."
ROWS = [
    "", "## Transactions (last 90 days, newest first)",
    'Format: date | account | name | category | amount — a trailing "| not counted as spending" marks a money-out row the rule above excludes (a matched internal transfer or a card payment).',
]

_TEXTS = ("name", "nickname", "mask", "type", "subtype", "institution")
ACCOUNT = T.StructType(
    [T.StructField("household_id", T.IntegerType()), T.StructField("account_id", T.LongType())] + [T.StructField(n, T.StringType()) for n in _TEXTS] + [T.StructField("current_balance", T.DecimalType(14, 2)), T.StructField("hidden", T.BooleanType())]
)


def money(c: Column) -> Column:
    """-1,234.50 as a text."""
    return F.format_number(amount(c), 2)


def sections(accounts: DataFrame, rows: DataFrame, expected: DataFrame, today: str, most: int = 20) -> DataFrame:
    """household_id, section, rank and line of the report on ``rows`` (visible, paired): accounts, months, categories, debts, expected bills and the newest transactions (``most`` of them)."""
    shown = accounts.where(~F.coalesce("hidden", F.lit(False)))
    balance = balances.display_balance(F.col("current_balance"), F.col("type"))
    v = verdicts.with_verdicts(rows)
    ranked = lambda *order: F.row_number().over(Window.partitionBy(*BY).orderBy(*order))
    line = lambda df, section, rank, *parts: df.select(*BY, F.lit(section).alias("section"), rank.cast("int").alias("rank"), F.concat(*parts).alias("line"))
    t = F.lit

    accounts_ = line(shown.withColumn("b", balance), 1, ranked("type", "name", "account_id"), t("account "), F.col("name"), t(" ("), F.col("type"), t("): "), money(F.col("b")))
    months = v.groupBy(*BY, F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum(F.when(F.col("income"), -F.col("amount")).otherwise(0)).alias("in"), F.sum(F.when(F.col("counted"), F.col("amount")).otherwise(0)).alias("out"))
    months = line(months, 2, ranked("month"), t("month "), F.col("month"), t(": in "), money(F.col("in")), t(", out "), money(F.col("out")))
    groups = v.where("counted").groupBy(*BY, "category").agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    groups = line(groups, 3, ranked(F.col("s").desc(), "category"), t("category "), F.col("category"), t(": "), money(F.col("s")), t(" in "), F.col("n").cast("string"))
    owed = balances.debts(accounts)
    owed = line(owed, 4, ranked(F.col("balance").desc(), "account_id"), t("debt "), F.col("name"), t(": "), money(F.col("balance")))
    due = expected.where((F.col("status") == "pending") & (F.datediff("due_date", F.lit(today).cast("date")).between(0, 31)))
    due = line(due, 5, ranked("due_date", "id"), t("due "), F.col("due_date").cast("string"), t(" "), F.col("description"), t(": "), money(F.col("amount")))
    newest = v.where("counted").withColumn("k", ranked(F.col("date").desc(), F.col("id").desc())).where(F.col("k") <= most)
    newest = line(newest, 6, F.col("k"), F.col("date").cast("string"), t(" "), verdicts.display_name(), t(" ["), F.col("category"), t("]: "), money(F.col("amount")))
    return accounts_.unionByName(months).unionByName(groups).unionByName(owed).unionByName(due).unionByName(newest)


def text(lines: DataFrame) -> DataFrame:
    """household_id and text, the lines in order."""
    rows = F.array_sort(F.collect_list(F.struct("section", "rank", "line")))
    return lines.groupBy(*BY).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def dollars(c: Column) -> Column:
    """$-1234.50 as a text."""
    return F.concat(F.lit("$"), c.cast("decimal(20,2)").cast("string"))


def account_label() -> Column:
    """A nickname, or the name with the last digits."""
    return F.coalesce(present(F.col("nickname")), F.concat(F.coalesce(present(F.col("name")), F.lit("Account")), F.coalesce(F.concat(F.lit(" ··"), present(F.col("mask"))), F.lit(""))))


def newest(rows: DataFrame, most: int) -> DataFrame:
    """Each household's newest rows (by date, then id), at most ``most``.  Chosen in parts first, so that a large household isn't sorted by one task."""
    order = [F.col("date").desc(), F.col("id").desc()]
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    some = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*BY, part).orderBy(*order))).where(F.col("_n") <= most)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(*BY).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def _heads(households: DataFrame, section: int, *texts: str | Column) -> DataFrame:
    """The same first lines of a section for every household."""
    lines = F.array(*(F.struct(F.lit(k - len(texts)).alias("rank"), (F.lit(t) if isinstance(t, str) else t).alias("line")) for k, t in enumerate(texts)))
    return households.select(*BY, F.lit(section).alias("section"), F.inline(lines))


def _lines(df: DataFrame, section: int, order: list, *parts: str | Column) -> DataFrame:
    line = F.concat(*(F.lit(t) if isinstance(t, str) else t for t in parts))
    return df.select(*BY, F.lit(section).alias("section"), F.row_number().over(Window.partitionBy(*BY).orderBy(*order)).alias("rank"), line.alias("line"))


def budget_walk(book: Ledger, month: str) -> tuple[DataFrame, DataFrame] | None:
    """Households that have budgeted anything (assigned up to the month, or set), and their walked envelopes; None without the tables.

    Spending is read from a household's first month with money assigned (else the viewed one) to the viewed month's end, and paired
    over just that range.
    """
    if "assignments" not in book.tables or "envelope_settings" not in book.tables:
        return None
    view = F.lit(month).cast("date")
    given = book["assignments"].where(F.col("month") <= F.last_day(view)).select(*BY, "category", "month", "assigned", F.lit(None).cast("decimal(12,2)").alias("target_override"))
    settings = book["envelope_settings"]
    first = F.min(F.when(F.coalesce("assigned", F.lit(0)) != 0, F.trunc("month", "month")))
    begun = given.select(*BY, "month", "assigned").unionByName(settings.select(*BY), allowMissingColumns=True).groupBy(*BY).agg(F.coalesce(first, view).alias("begins"))
    floor = F.add_months(view, 1 - envelopes.MAX_WALK_MONTHS)
    rows = book.visible((F.col("date") >= floor) & (F.col("date") <= F.last_day(view))).join(begun, BY).where("date >= begins").drop("begins")
    spent = spending.envelope_spending(matching.mark_internal(rows))
    return begun.select(*BY), held(envelopes.walk(given, spent, settings, month))


def _envelope_lines(budget: tuple[DataFrame, DataFrame], month: str) -> DataFrame:
    who, walked = budget
    target = F.when(F.col("target").isNull(), "").when(
        F.col("target_kind") == "by_date", F.concat(F.lit(", target "), dollars(F.col("target")), F.lit(" by "), F.coalesce(F.date_format("target_date", "yyyy-MM"), F.lit("")))
    ).otherwise(F.concat(F.lit(", target "), dollars(F.col("target")), F.lit("/mo")))
    sums = lambda: [F.lit("assigned "), dollars(F.col("assigned")), F.lit(", carried "), dollars(F.col("rolled_over")), F.lit(", spent "), dollars(F.col("spent")), F.lit(", available "), dollars(F.col("available"))]
    total = who.join(envelopes.totals(walked), BY, "left").na.fill(0.0)
    heads = _heads(who, 4, "", f"## Budget envelopes ({month[:7]})", ENVELOPES)
    return heads.unionByName(_lines(walked, 4, ["category"], "- ", F.col("category"), ": ", *sums(), target)).unionByName(_lines(total, 5, [*BY], "Totals: ", *sums()))


def context(book: Ledger, today: str, most: int = NEWEST) -> DataFrame:
    """household_id, section, rank and line of the whole report, for every household with an account; ``text`` joins them.

    Tables of the ledger: accounts (hidden ones appear nowhere) and transactions; assignments and envelope_settings, where there are any.
    The newest ``most`` rows since 90 days before ``today`` are read.  Loans' and excluded rows are left out after that.  Each calendar
    month is paired on its own, as the month's own reports do; a first month that isn't whole says so.  Recurring charges are told
    relative to a household's newest row, so a report depends on its rows and the date only.  A household that has budgeted nothing has no
    envelopes.  Null texts read as empty ones.
    """
    day = datetime.date.fromisoformat(today)
    since = day - datetime.timedelta(days=DAYS)
    partial = since.isoformat()[:7] if since.day > 1 else None
    accounts = conform(book["accounts"], ACCOUNT)
    shown = accounts.where(~F.coalesce("hidden", F.lit(False)))
    households = accounts.select(*BY).distinct()

    rows = newest(book.visible(F.col("date") >= F.lit(since)), most).where(~F.coalesce("excluded", F.lit(False)) & ~F.coalesce(F.col("account_type") == "loan", F.lit(False)))
    # Few rows a household, used by three sections: paired and judged once.
    v = verdicts.with_verdicts(matching.mark_internal(rows, F.trunc("date", "month"))).withColumn("shown_category", verdicts.display_category(F.col("type")))
    v = held(v.select(*BY, "id", "account_id", "date", "amount", "merchant_name", "description", "user_description", "category", "shown_category", "counted"))

    balance = balances.display_balance(F.col("current_balance"), F.col("type"))
    kind = F.coalesce(present(F.col("subtype")), F.col("type"), F.lit(""))
    listed = _lines(shown, 1, ["type", "name", "account_id"], "- ", account_label(), " (", F.coalesce(present(F.col("institution")), F.lit("Unknown bank")), ", ", kind, "): balance ", dollars(balance))

    sums = v.where("counted").groupBy(*BY, F.date_format("date", "yyyy-MM").alias("month"), "category").agg(F.sum("amount").alias("sum"))
    mark = F.when(F.col("month") == partial, f" (partial month: {since} onward only)").otherwise("") if partial else ""
    months = _lines(sums, 2, ["month", "category"], "- ", F.col("month"), " ", F.col("category"), ": ", dollars(F.col("sum")), mark)
    note = [PARTIAL.format(since=since, month=partial)] if partial else []

    clock = v.groupBy(*BY).agg(F.max("date").alias("today"))
    named = v.select(*BY, "id", "account_id", F.coalesce(present(F.col("user_description")), F.col("merchant_name")).alias("merchant_name"), "description", F.col("date").alias("transaction_date"), "amount", F.col("shown_category").alias("category"))
    found = held(recurring.detect(named, clock))
    per = F.when(F.col("cadence") == "weekly", "wk").when(F.col("cadence") == "annual", "yr").otherwise("mo")
    creep = F.when(F.col("price_creep"), F.concat(F.lit(" — price increased: was "), dollars(F.col("median_amount")), F.lit(", now "), dollars(F.col("last_amount")))).otherwise("")
    due = F.when(F.col("due_status") == "overdue", " — overdue").when(F.col("due_status").isNotNull(), " — due soon").otherwise("")
    charges = _lines(
        found, 3, [F.col("monthly_amount").desc(), "key"], "- ", F.col("name"), ": ~", dollars(F.col("monthly_amount")), "/", per, " (", F.col("category"), ", every ~", F.col("avg_gap_days").cast("string"),
        " days, last ", F.col("last_date").cast("string"), ", next ~", F.col("next_date").cast("string"), ")", creep, due,
    )
    told = households.join(found.select(*BY).distinct().join(clock, BY), BY, "left")
    clocked = F.coalesce(F.concat(F.lit("Due dates are relative to the newest transaction ("), F.col("today").cast("string"), F.lit(").")), F.lit("None detected."))

    name = F.coalesce(*(present(F.col(c)) for c in ("user_description", "merchant_name", "description")), F.lit("Card transaction"))
    skipped = F.when((F.col("amount") > 0) & ~F.col("counted"), " | not counted as spending").otherwise("")
    labelled = v.join(shown.select(*BY, "account_id", account_label().alias("label")), [*BY, "account_id"])
    last = _lines(labelled, 6, [F.col("date").desc(), F.col("id").desc()], F.col("date").cast("string"), " | ", F.col("label"), " | ", name, " | ", F.col("shown_category"), " | ", dollars(F.col("amount")), skipped)

    month = today[:8] + "01"
    budget = budget_walk(book, month)
    parts = [_heads(households, 1, *ACCOUNTS), listed, _heads(households, 2, *MONTHS, *note), months, _heads(told, 3, *RECURRING, clocked), charges, _heads(households, 6, *ROWS), last]
    out = parts[0] if budget is None else parts[0].unionByName(_envelope_lines(budget, month))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
