"""Recurring charges, and expected transactions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import apply_in_groups, stream_in_groups  # noqa: F401 (tests bound what is held of a group)
from ..functions.money import amount
from ..functions.tables import literal_rows
from ..functions.storage import held
from ..functions.text import description_tokens, merchant_key, normal_merchant, present, similarity
from .nearest import nearest
from .verdicts import RETURN_CATEGORY, TRANSFER_CATEGORY

BY = ["household_id"]
# Position, cadence, least and greatest gap, tolerance, days in which one is due soon, times a month, days looked back, days until stale.
CADENCES = [
    (0, "weekly", 5, 9, 2, 2, 52 / 12, 84, 14),
    (1, "monthly", 24, 32, 4, 7, 1.0, 190, 60),
    (2, "annual", 350, 380, 15, 30, 1 / 12, None, 60),
]
CREEP = 0.05
WINDOW_DAYS = {"weekly": 4, "monthly": 7, "annual": 30, "once": 7}
STALE_DAYS = {"weekly": 14, "monthly": 60, "annual": 60, "once": 14}
DUPLICATE_DAYS = {"weekly": 2, "monthly": 4, "annual": 15, "once": 0}
AMOUNT_TOLERANCE = 0.2
BIN_DAYS = 8
MAX_CYCLES = 200


def _by_cadence(cadence: Column, days: dict[str, int]) -> Column:
    out = F.lit(days["once"])
    for name in ("weekly", "monthly", "annual"):
        out = F.when(cadence == name, days[name]).otherwise(out)
    return out


def _modes(rows: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """keys and the most frequent non-empty value of each of some columns, all in one pass; among equals the one that reached that count first."""
    kinds = dict(rows.dtypes)
    told = F.posexplode(F.array(*(F.col(v).cast("string") for v in values))).alias("field", "value")
    counts = rows.select(*keys, "position", told).where("value != ''").groupBy(*keys, "field", "value").agg(F.count("*").alias("n"), F.max("position").alias("reached"))
    best = lambda k: F.max_by("value", F.when(F.col("field") == k, F.struct("n", -F.col("reached"))))
    return counts.groupBy(*keys).agg(*(best(k).cast(kinds[v]).alias(v) for k, v in enumerate(values)))


def detect(rows: DataFrame, today: str | DataFrame | None = None) -> DataFrame:
    """Charges that recur weekly, monthly or yearly, per household and normalised merchant.

    rows: household_id, id, account_id, merchant_name, description, transaction_date, amount, category.  today: a date, or a
    table of household_id and today; charges that are stale by then are left out.  All three
    cadences are tried at once (three copies of each merchant's rows) and the first that holds is kept.
    """
    specs = literal_rows(CADENCES, ["rank", "cadence", "min_gap", "max_gap", "gap_tol", "soon", "per_month", "look_back", "stale"], ["int", "string", "int", "int", "int", "int", "double", "int", "int"])
    key = [*BY, "key"]
    usable = rows.where((F.col("amount") > 0) & F.col("transaction_date").isNotNull() & ~F.coalesce(F.col("category").isin(TRANSFER_CATEGORY, RETURN_CATEGORY), F.lit(False)))
    usable = usable.withColumn("key", normal_merchant(F.coalesce(present(F.col("merchant_name")), F.col("description")))).where("key != ''")
    usable = usable.withColumn("day", F.unix_date("transaction_date")).withColumn("amount", F.col("amount").cast("double"))
    whole = Window.partitionBy(*key)
    usable = usable.withColumn("newest", F.max("day").over(whole)).withColumn("size", F.count("*").over(whole)).where("size >= 3")
    tried = usable.select("*", F.inline(specs)).where(F.col("look_back").isNull() | (F.col("newest") - F.col("day") <= F.col("look_back")))
    group = [*key, "rank"]
    win = Window.partitionBy(*group)
    tried = tried.withColumn("median_amount", F.percentile("amount", F.lit(0.5)).over(win)).withColumn("n", F.count("*").over(win))
    kept = tried.where(F.abs(F.col("amount") - F.col("median_amount")) <= 0.2 * F.col("median_amount")).withColumn("kept", F.count("*").over(win))
    kept = kept.where("n >= 3 and kept >= 3 and kept >= 0.8 * n")
    order = Window.partitionBy(*group).orderBy("day", "id")
    kept = kept.withColumn("gap", F.col("day") - F.lag("day").over(order)).withColumn("position", F.row_number().over(order))
    kept = kept.withColumn("median_gap", F.percentile("gap", F.lit(0.5)).over(win))
    fits = kept.groupBy(*group, "cadence", "min_gap", "max_gap", "gap_tol", "soon", "per_month", "stale", "median_amount", "median_gap").agg(
        F.count("*").alias("count"), F.count("gap").alias("gaps"), F.count_if(F.abs(F.col("gap") - F.col("median_gap")) <= F.col("gap_tol")).alias("near"), F.sum("gap").alias("gap_sum"),
        F.max("day").alias("last_day"), F.percentile("amount", F.lit(0.5)).alias("monthly_amount"), F.max_by("amount", F.struct("day", "amount")).alias("last_amount"),
    )
    fits = fits.where((F.col("median_gap") >= F.col("min_gap")) & (F.col("median_gap") <= F.col("max_gap")) & (F.col("near") >= F.ceil(F.col("gaps") * 2 / 3)))
    first = fits.withColumn("best", F.min("rank").over(whole)).where("rank = best")
    first = first.withColumn("next_day", F.col("last_day") + F.floor(F.col("median_gap") + 0.5).cast("int"))
    if isinstance(today, DataFrame):
        first = first.join(today.select(*BY, F.unix_date("today").alias("now")), BY)
    now = F.col("now") if isinstance(today, DataFrame) else F.unix_date(F.lit(today).cast("date"))
    if today is not None:
        first = first.where(now - F.col("next_day") <= F.col("stale"))
    status = F.when(F.col("next_day") < now, "overdue").when(F.col("next_day") - now <= F.col("soon"), "due-soon")
    hit = kept.join(first.select(*group), group, "left_semi")
    first = first.join(_modes(hit, ["merchant_name", "category", "account_id"], group), group, "left")
    return first.select(
        *key, F.coalesce("merchant_name", F.initcap("key")).alias("name"), F.coalesce("category", F.lit("Shopping and gear")).alias("category"), "account_id", F.round("monthly_amount", 2).alias("monthly_amount"),
        (F.col("monthly_amount") * F.col("per_month")).alias("monthly_equivalent"), "cadence", "count", F.date_from_unix_date("last_day").alias("last_date"), F.date_from_unix_date("next_day").alias("next_date"),
        F.floor(F.col("gap_sum") / F.col("gaps") + 0.5).alias("avg_gap_days"), F.round("last_amount", 2).alias("last_amount"), F.round("median_amount", 2).alias("median_amount"),
        (F.col("last_amount") > (1 + CREEP) * F.col("median_amount")).alias("price_creep"), status.alias("due_status"),
    )


def headline(recurring: DataFrame, ignored: DataFrame) -> DataFrame:
    """Monthly cost of what recurs, without ignored keys."""
    return recurring.join(ignored, [*BY, "key"], "left_anti").groupBy(*BY).agg(F.round(F.sum("monthly_equivalent"), 2).alias("monthly_cost"), F.count("*").alias("items"))


def roll_forward(due: Column, cadence: Column) -> Column:
    """The next due date; months and years clamp to their last day; null for a single one."""
    return F.when(cadence == "weekly", F.date_add(due, 7)).when(cadence == "monthly", F.add_months(due, 1)).when(cadence == "annual", F.add_months(due, 12))


def project(expected: DataFrame, through_month: str) -> DataFrame:
    """Each row's future due dates through a month, at most 200.  Clamped days stay clamped: the 31st, then the 28th, then the 28th."""
    last, due = F.last_day(F.lit(through_month).cast("date")), F.col("due_date")
    # A late day is cut by the shortest month it has passed; two years have every length.
    shortest = lambda k: F.array_min(F.transform(F.sequence(F.lit(1), F.least(k, F.lit(24))), lambda j: F.dayofmonth(F.last_day(F.add_months(F.trunc(due, "month"), j)))))
    of_month = lambda k: F.when(F.dayofmonth(due) <= 28, F.add_months(due, k)).otherwise(F.date_add(F.add_months(F.trunc(due, "month"), k), F.least(F.dayofmonth(due), shortest(k)) - 1))
    of_year = lambda k: F.when((F.month(due) == 2) & (F.dayofmonth(due) == 29), F.add_months(F.date_sub(due, 1), k * 12)).otherwise(F.add_months(due, k * 12))
    at = lambda k: F.when(F.col("cadence") == "weekly", F.date_add(due, k * 7)).when(F.col("cadence") == "monthly", of_month(k)).otherwise(of_year(k))
    room = F.when(F.col("cadence") == "weekly", F.datediff(last, "due_date") / 7).when(F.col("cadence") == "monthly", F.months_between(last, "due_date")).when(F.col("cadence") == "annual", F.months_between(last, "due_date") / 12).otherwise(0)
    steps = F.least(F.lit(MAX_CYCLES), F.greatest(F.ceil(room).cast("int"), F.lit(0)))
    dates = F.filter(F.transform(F.sequence(F.lit(1), steps), at), lambda d: d <= last)
    return expected.where("due_date is not null").where(steps > 0).select(*BY, "id", F.posexplode(dates).alias("cycle", "due_date"))


def status(today: str) -> Column:
    return F.when(F.col("status").isin("matched", "dismissed"), F.col("status")).when(F.col("due_date") < F.lit(today).cast("date"), "overdue").otherwise("pending")


def missed(today: str) -> Column:
    late = F.datediff(F.lit(today).cast("date"), "due_date") > _by_cadence(F.col("cadence"), STALE_DAYS)
    return F.coalesce((status(today) == "overdue") & late, F.lit(False))


def by_category(expected: DataFrame) -> DataFrame:
    rows = expected.where((F.col("status") == "pending") & present(F.col("category")).isNotNull())
    return rows.groupBy(*BY, "category").agg(amount(F.sum("amount")).alias("amount"))


def candidates(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of an expectation and a transaction that may be it: what ``match`` chooses from without making them.

    Both sides meet within a household in bins of BIN_DAYS that the expectation's window touches, and there by account; those that name
    no account meet amounts of the same size (steps of a quarter), so that a household's rows are never all paired.  The exact tests follow.
    """
    reach = _by_cadence(F.col("cadence"), WINDOW_DAYS)
    bin_of = lambda day: F.floor(day / BIN_DAYS)
    step_of = lambda c: F.floor(F.log(c) / math.log(1.25))
    e = expected.where((F.col("amount") > 0) & F.col("due_date").isNotNull()).select(
        *BY, F.col("id").alias("expected_id"), F.col("account_id").alias("e_account"), F.col("amount").cast("double").alias("e_amount"), "due_date", "cadence", description_tokens(F.col("description")).alias("e_tokens"), merchant_key(F.col("description")).alias("e_key"),
        F.explode(F.sequence(bin_of(F.unix_date("due_date") - reach), bin_of(F.unix_date("due_date") + reach))).alias("bin"),
    )
    said = F.coalesce(present(F.col("merchant_name")), F.col("description"), F.lit(""))
    # An amount within the tolerance of one above 0 is above 0.
    t = rows.where("date is not null and amount > 0").select(
        *BY, F.col("id").alias("tx_id"), F.col("account_id").alias("t_account"), F.col("amount").cast("double").alias("t_amount"), F.col("date").alias("tx_date"), description_tokens(said).alias("t_tokens"), merchant_key(said).alias("t_key"), bin_of(F.unix_date("date")).alias("bin")
    )
    # Steps are taken a little wide, so that rounding loses no pair.
    low, high = (step_of(F.col("e_amount") * (1 + way * (AMOUNT_TOLERANCE + 1e-6))) for way in (-1, 1))
    named = e.where("e_account is not null").join(t.withColumn("e_account", F.col("t_account")), [*BY, "e_account", "bin"])
    other = e.where("e_account is null").withColumn("step", F.explode(F.sequence(low, high))).join(t.withColumn("step", step_of(F.col("t_amount"))), [*BY, "bin", "step"])

    def fitting(both: DataFrame) -> DataFrame:
        both = both.withColumn("dist", F.abs(F.datediff("tx_date", "due_date")))
        return both.where(
            (F.abs(F.col("t_amount") - F.col("e_amount")) <= AMOUNT_TOLERANCE * F.col("e_amount")) & (F.col("dist") <= reach) & ((similarity(F.col("e_tokens"), F.col("t_tokens")) >= 0.4) | (F.col("e_key") == F.col("t_key")))
        ).select(*BY, "expected_id", "due_date", "tx_id", "tx_date", "dist")

    return fitting(named).unionByName(fitting(other))


#: A household whose bills' and transactions' wordings make more pairs isn't narrowed by them; a task remembers so many comparisons at once.
FEW_PAIRS = 50_000
#: So many rows, over all households, are walked as they are, each household held whole.
FEW_ROWS = 200_000
#: Days that one of 64 bits stands for.
BIT_DAYS = 32


def _worded(both: DataFrame) -> DataFrame:
    """The bills (reach is set) and transactions of ``both`` that some wording of the other side in their household is like, with the wording as key.

    All rows of households with more than FEW_PAIRS pairs of wordings stay.
    """
    texts = held(both.select(*BY, "said", F.col("reach").isNotNull().alias("bill")).distinct().withColumn("key", merchant_key(F.col("said"))))
    keys = texts.select(*BY, "bill", "key").distinct()
    many = keys.groupBy(*BY).agg((F.count_if("bill") * F.count_if(~F.col("bill"))).alias("pairs")).where(F.col("pairs") > FEW_PAIRS).select(*BY)
    # Two wordings that are alike share a word, or are equal.  The key has all words of its text.
    words = keys.join(many, BY, "left_anti").withColumn("words", description_tokens(F.col("key"))).withColumn("word", F.explode(F.concat("words", F.array(F.concat(F.lit("="), F.col("key"))))))
    side = lambda bill, n: words.where(F.col("bill") == bill).select(*BY, "word", F.col("key").alias(f"key_{n}"), F.col("words").alias(f"words_{n}"))
    alike = side(True, "e").join(side(False, "t"), [*BY, "word"]).where((F.col("key_e") == F.col("key_t")) | (similarity(F.col("words_e"), F.col("words_t")) >= 0.4))
    useful = alike.select(*BY, F.inline(F.array(F.struct(F.lit(True).alias("bill"), F.col("key_e").alias("key")), F.struct(F.lit(False).alias("bill"), F.col("key_t").alias("key"))))).distinct().unionByName(keys.join(many, BY, "left_semi"))
    kept = held(texts.join(useful, [*BY, "bill", "key"], "left_semi"))
    return both.withColumn("bill", F.col("reach").isNotNull()).join(kept, [*BY, "bill", "said"]).drop("bill", "said")


def match(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """One-to-one matches of expectations and transactions, nearest first.

    Greedy in a total order over the pairs of ``candidates``, which aren't made: each household is one walk along its days (``nearest``).  Of more than
    FEW_ROWS rows only those that wordings leave go on it, and bills that name an account only where that account has such rows about their time, told by
    a bit for every BIT_DAYS days (modulo 64: too many stay, none is lost).
    """
    reach, most = _by_cadence(F.col("cadence"), WINDOW_DAYS), max(WINDOW_DAYS.values())
    bit = lambda day: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(day / BIT_DAYS), F.lit(64)).cast("int"))
    shaped = lambda day: (*BY, F.unix_date(day).alias("day"), F.col("account_id").cast("string").alias("account"), F.col("amount").cast("double").alias("amount"))
    bills = expected.where((F.col("amount") > 0) & F.col("due_date").isNotNull()).select(*shaped("due_date"), F.col("id").alias("expected_id"), reach.alias("reach"), F.coalesce("description", F.lit("")).alias("said"))
    # An amount within the tolerance of one above 0 is above 0.
    paid = rows.where("date is not null and amount > 0").select(*shaped("date"), F.col("id").alias("tx_id"), F.coalesce(present(F.col("merchant_name")), F.col("description"), F.lit("")).alias("said"))
    both = held(bills.unionByName(paid, allowMissingColumns=True))
    columns = [*BY, "day", "expected_id", "tx_id", "account", "amount", "reach", "key"]
    few = both.count() <= FEW_ROWS
    if few:
        walk = both.withColumn("key", merchant_key(F.col("said"))).select(*columns, F.lit(True).alias("whole"))
    else:
        both = _worded(both)
        named = F.col("reach").isNotNull() & F.col("account").isNotNull()
        when = both.where("reach is null and account is not null").groupBy(*BY, "account").agg(F.bit_or(bit(F.col("day"))).alias("_when"))
        asked = bit(F.col("day") - F.col("reach")).bitwiseOR(bit(F.col("day"))).bitwiseOR(bit(F.col("day") + F.col("reach")))  # no reach skips a bit
        near = both.where(named).join(when, [*BY, "account"]).where(asked.bitwiseAND(F.col("_when")) != 0)
        walk = held(both.where(~named).select(*columns).unionByName(near.select(*columns)))
        same = held(walk.groupBy(*BY, "expected_id", "tx_id").agg(F.count("*").alias("n")).where("n > 1").select(*BY, F.lit(True).alias("_same")).distinct())
        walk = walk.join(same, BY, "left").select(*columns, F.coalesce("_same", F.lit(False)).alias("whole"))
    kinds = dict(walk.dtypes)
    return stream_in_groups(walk, BY, ["day"], nearest(most, AMOUNT_TOLERANCE, FEW_PAIRS), ", ".join(f"{c} {kinds[c]}" for c in (*BY, "expected_id", "tx_id")), spread=not few)


def add(expected: DataFrame, new: DataFrame) -> DataFrame:
    """``expected`` with the rows of ``new`` that nothing pending covers already."""
    taken = duplicates(new.select(*BY, "id", "recurring_key", "due_date", "cadence"), expected).select(*BY, "id")
    return expected.unionByName(new.join(taken, [*BY, "id"], "left_anti").select(*expected.columns))


def settle(expected: DataFrame, matched: DataFrame, dismissed: DataFrame) -> DataFrame:
    """``expected`` with pending rows (household_id, id) marked as matched or dismissed, by hand or by ``match``.

    What recurs and was matched is put in again for its next date, with no id yet, unless something pending covers that.
    """
    mark = lambda df, name: df.select(*BY, "id").distinct().withColumn(f"_{name}", F.lit(True))
    rows = expected.join(mark(matched, "matched"), [*BY, "id"], "left").join(mark(dismissed, "dismissed"), [*BY, "id"], "left")
    open_ = F.col("status") == "pending"
    rows = rows.withColumn("_now", open_ & F.coalesce("_matched", F.lit(False))).withColumn("status", F.when(F.col("_now"), "matched").when(open_ & F.coalesce("_dismissed", F.lit(False)), "dismissed").otherwise(F.col("status")))
    kept = rows.select(*expected.columns)
    following = rows.where("_now").withColumn("due_date", roll_forward(F.col("due_date"), F.col("cadence"))).where("due_date is not null").withColumn("status", F.lit("pending"))
    taken = duplicates(following.select(*expected.columns), kept).select(*BY, "id")
    fresh = following.join(taken, [*BY, "id"], "left_anti").withColumn("id", F.lit(None).cast(dict(expected.dtypes)["id"]))
    return kept.unionByName(fresh.select(*expected.columns))


#: Days before today in which a transaction can still settle a bill.
LOOKBACK_DAYS = 95


def settle_all(expected: DataFrame, rows: DataFrame, today: str) -> DataFrame:
    """``expected`` (with matched_tx_id and origin) after matching and rolling forward until nothing changes.

    What recurs and was matched goes on at its next date, and that is matched too, so that a backlog of cycles settles in one call.  Only dates that
    were put in by the round before are matched in the next: of the others, what they could be was taken.  origin is the id of the row
    that a next date goes back to; its own id is a hash of it.  Transactions that a settled row claims are out; a null matched_tx_id claims none.
    """
    day = F.lit(today).cast("date")
    kind = dict(rows.dtypes)["id"]
    table = expected if "matched_tx_id" in expected.columns else expected.withColumn("matched_tx_id", F.lit(None).cast(kind))
    table = held(table.withColumn("origin", F.col("id")))
    claimed = table.where("status = 'matched' and matched_tx_id is not null").select(*BY, F.col("matched_tx_id").alias("id"))
    free = held(rows.where(F.col("date").between(F.date_sub(day, LOOKBACK_DAYS), day)).join(claimed, [*BY, "id"], "left_anti"))
    fresh = table.where((F.col("status") == "pending") & F.col("due_date").between(F.date_sub(day, LOOKBACK_DAYS + 31), F.date_add(day, 31)))
    for _ in range(LOOKBACK_DAYS // 7 + 2):  # each round takes a later cycle of what recurs
        taken = held(match(fresh.drop("matched_tx_id"), free))
        if taken.isEmpty():
            break
        marks = taken.select(*BY, F.col("expected_id").alias("id"), F.col("tx_id").alias("_tx"))
        both = table.join(marks, [*BY, "id"], "left")
        now = held(both.select(*(F.when(F.col("_tx").isNotNull(), F.lit("matched")).otherwise(F.col(c)).alias(c) if c == "status" else F.coalesce("_tx", c).alias(c) if c == "matched_tx_id" else F.col(c) for c in table.columns), F.col("_tx").isNotNull().alias("_now")))
        onward = now.where("_now").withColumn("due_date", roll_forward(F.col("due_date"), F.col("cadence"))).where("due_date is not null")
        onward = held(onward.withColumn("status", F.lit("pending")).withColumn("matched_tx_id", F.lit(None).cast(kind)).withColumn("id", F.abs(F.xxhash64("origin", "due_date")).cast(dict(expected.dtypes)["id"])).select(*table.columns))
        covered = duplicates(onward, now).select(*BY, "id")
        fresh = held(onward.join(covered, [*BY, "id"], "left_anti"))
        table = held(now.select(*table.columns).unionByName(fresh))
        free = held(free.join(taken.select(*BY, F.col("tx_id").alias("id")), [*BY, "id"], "left_anti"))
    return table


def duplicates(fields: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows of ``fields`` that an expectation pending already covers: the same recurring key, due within days of it.

    Rows don't meet, only the days of a key do, each once and in order: a day's nearest pending ones before and after it tell.
    """
    key = [*BY, "recurring_key"]
    asked = fields.where("recurring_key is not null and due_date is not null")
    pending = existing.where("status = 'pending' and recurring_key is not null and due_date is not null")
    days = pending.select(*key, "due_date", F.lit(True).alias("held")).unionByName(asked.select(*key, "due_date", F.lit(False).alias("held"))).groupBy(*key, "due_date").agg(F.max("held").alias("held"))
    nearest = lambda order: F.last(F.when(F.col("held"), F.col("due_date")), ignorenulls=True).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    away = F.least(F.datediff("due_date", nearest(F.col("due_date").asc())), F.datediff(nearest(F.col("due_date").desc()), "due_date"))
    near = F.col("_away") <= _by_cadence(F.col("cadence"), DUPLICATE_DAYS)
    return asked.join(days.select(*key, "due_date", away.alias("_away")).where("_away is not null"), [*key, "due_date"]).where(near).select(*fields.columns).distinct()
