"""Envelope budgets: what each category has available in a month, with or without rollover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import amount, cents
from .verdicts import MECHANISMS

BY = ["household_id"]
MAX_WALK_MONTHS = 600


def walk(assignments: DataFrame, spending: DataFrame, settings: DataFrame, month: str) -> DataFrame:
    """A row per household and category in play in the viewed month (its first day).

    assignments: household_id, category, month, assigned, target_override; spending: household_id, category, month, spent;
    settings: household_id, category, target, target_kind, target_date, rollover.  A category's money begins in its first
    month with a non-zero assignment (at most 600 months back); with rollover what is available runs on, so the walk is
    one sum per category and needs no spine of months.
    """
    view = F.lit(month).cast("date")
    floor = F.add_months(view, -(MAX_WALK_MONTHS - 1))
    first = F.trunc("month", "month")
    given = assignments.withColumn("month", first).where(F.col("month") <= view).groupBy(*BY, "category", "month").agg(F.sum(F.coalesce("assigned", F.lit(0))).alias("assigned"), F.max("target_override").alias("override"))
    rows_used = assignments.withColumn("month", first).where((F.col("month") <= view) & (F.coalesce("assigned", F.lit(0)) != 0)).groupBy(*BY, "category").agg(F.min("month").alias("begins"))
    used = spending.withColumn("month", first).where(F.col("month") <= view).groupBy(*BY, "category", "month").agg(F.sum("spent").alias("spent"))
    both = given.join(used, [*BY, "category", "month"], "full_outer").na.fill(0, ["assigned", "spent"])
    facts = both.join(rows_used, [*BY, "category"], "left").withColumn("begins", F.greatest(F.coalesce("begins", view), floor))
    now, live = F.col("month") == view, F.col("month") >= F.col("begins")
    sums = facts.groupBy(*BY, "category").agg(
        F.sum(F.when(now, F.col("assigned"))).alias("assigned"), F.sum(F.when(now, F.col("spent"))).alias("spent"), F.max(F.when(now, F.col("override"))).alias("target_override"),
        F.sum(F.when(live & ~now, F.col("assigned") - F.col("spent"))).alias("before"), F.max(F.when(now, 1)).alias("seen"), F.max(F.when(F.col("override").isNotNull() | (F.col("assigned") != 0), 1)).alias("ever"),
    )
    named = given.select(*BY, "category").union(settings.select(*BY, "category")).union(used.where(now).select(*BY, "category")).distinct()
    full = named.join(sums, [*BY, "category"], "left").join(settings, [*BY, "category"], "left").na.fill(0, ["assigned", "spent", "before"])
    rolled = F.when(F.coalesce("rollover", F.lit(True)), F.col("before")).otherwise(0)
    return full.select(
        *BY, "category", amount(F.col("assigned")).alias("assigned"), amount(rolled).alias("rolled_over"), amount(F.col("spent")).alias("spent"), amount(F.col("assigned") + rolled - F.col("spent")).alias("available"),
        amount(F.col("target")).alias("target"), F.coalesce("target_kind", F.lit("monthly")).alias("target_kind"), "target_date", F.coalesce("rollover", F.lit(True)).alias("rollover"), amount(F.col("target_override")).alias("target_override"),
    )


def effective_target() -> Column:
    return F.coalesce("target_override", "target")


def months_until(date: Column, month: str) -> Column:
    """Months to a date's month, the viewed one included; 1 at least."""
    gap = F.months_between(F.trunc(date, "month"), F.lit(month).cast("date")).cast("int") + 1
    return F.greatest(F.coalesce(gap, F.lit(1)), F.lit(1))


def target_need(month: str) -> Column:
    """What a walked row still needs this month."""
    override, target = F.col("target_override"), F.col("target")
    left = F.when(override.isNotNull(), override - F.col("assigned")).when(target.isNull(), 0.0).when(
        F.col("target_kind") == "by_date", (target - F.col("rolled_over")) / months_until(F.col("target_date"), month) - F.col("assigned")
    ).otherwise(target - F.col("assigned"))
    return F.when(left > 0, cents(left)).otherwise(0.0)


def pace(today: str) -> Column:
    """How far a month's spending is ahead of an even pace, where it is so by over a tenth of what is assigned; else null."""
    day = F.lit(today).cast("date")
    expected = F.dayofmonth(day) / F.dayofmonth(F.last_day(day)) * F.col("assigned")
    ahead = (F.col("assigned") > 0) & (F.col("spent") > 0) & (F.col("spent") > expected + 0.1 * F.col("assigned"))
    return F.when(ahead, cents(F.col("spent") - expected))


def totals(rows: DataFrame) -> DataFrame:
    """Sums over the budgeted rows of each household."""
    budgeted = rows.where((F.col("assigned") != 0) | (F.col("rolled_over") != 0) | effective_target().isNotNull())
    return budgeted.groupBy(*BY).agg(*(F.round(F.sum(c), 2).alias(c) for c in ("assigned", "rolled_over", "spent", "available")), F.round(F.sum(F.coalesce(effective_target(), F.lit(0.0))), 2).alias("target"))


def ready_to_assign(income: DataFrame, sums: DataFrame) -> DataFrame:
    """Income less what is assigned; null where the income is unknown."""
    return sums.join(income, BY, "left").select(*BY, F.round(F.col("income") - F.col("assigned"), 2).alias("ready"))


def topped_up(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Walked ``rows`` with a row of zeros for each of ``names`` (household_id, category) that has none."""
    fill = names.select(*BY, "category").distinct().join(rows.select(*BY, "category"), [*BY, "category"], "left_anti")
    zero = {"target_kind": F.lit("monthly"), "rollover": F.lit(True)} | {c: F.lit(0.0) for c in ("assigned", "rolled_over", "spent", "available")}
    return rows.unionByName(fill.select(*(F.col(c) if c in fill.columns else zero.get(c, F.lit(None)).cast(dict(rows.dtypes)[c]).alias(c) for c in rows.columns)))


def groups(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """Sums of each group of categories: a parent with its children, or a category alone.  tree: household_id, name, parent."""
    placed = rows.join(tree.select(*BY, F.col("name").alias("category"), "parent"), [*BY, "category"], "left").withColumn("group", F.coalesce("parent", "category"))
    return placed.groupBy(*BY, "group").agg(*(F.round(F.sum(c), 2).alias(c) for c in ("assigned", "rolled_over", "spent", "available")), F.count("*").alias("members"))


def fund_needs(rows: DataFrame, tree: DataFrame, month: str) -> DataFrame:
    """household_id, category and need of what can take money: no mechanism category and no parent."""
    parents = tree.where("parent is not null").select(*BY, F.col("parent").alias("category")).distinct()
    able = rows.where(~F.col("category").isin(MECHANISMS)).join(parents, [*BY, "category"], "left_anti")
    return able.select(*BY, "category", target_need(month).alias("need")).where("need > 0")


def auto_fill(source: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows that copy a month's assignments: budgetable categories with a sum, without an assignment yet (skipped otherwise)."""
    wanted = source.groupBy(*BY, "category").agg(F.sum("assigned").alias("assigned")).where((F.col("assigned") != 0) & ~F.col("category").isin(MECHANISMS))
    taken = existing.where("assigned != 0").select(*BY, "category").distinct().withColumn("skipped", F.lit(True))
    return wanted.join(taken, [*BY, "category"], "left").select(*BY, "category", amount(F.col("assigned")).alias("assigned"), F.coalesce("skipped", F.lit(False)).alias("skipped"))


def move(rows: DataFrame, source: str, target: str, sum_: float) -> DataFrame:
    """Both legs of moving money between two categories of every household that has the first."""
    if not sum_ > 0 or not source or not target or source == target:
        return rows.sparkSession.createDataFrame([], "household_id int, category string, assigned double")
    held = rows.groupBy(*BY).agg(F.sum(F.when(F.col("category") == source, F.col("assigned"))).alias("a"), F.sum(F.when(F.col("category") == target, F.col("assigned"))).alias("b")).where("a is not null")
    legs = F.array(F.struct(F.lit(source).alias("category"), cents(F.col("a") - sum_).alias("assigned")), F.struct(F.lit(target).alias("category"), cents(F.coalesce("b", F.lit(0)) + sum_).alias("assigned")))
    return held.select(*BY, F.inline(legs))


def assignment_edits(rows: DataFrame, month: str, position: int = 0) -> DataFrame:
    """Rows of ``auto_fill`` that aren't skipped, of ``move``, or needs with new totals (household_id, category, assigned) as edits for ``assigned``: a total of zero is written, not deleted."""
    wanted = rows.where(~F.col("skipped")) if "skipped" in rows.columns else rows
    return wanted.select(*BY, "category", F.lit(month).cast("date").alias("month"), F.lit(position).alias("position"), F.lit("fund").alias("action"), F.col("assigned").cast("string").alias("value"))


def assigned(assignments: DataFrame, edits: DataFrame) -> DataFrame:
    """``assignments`` after ``edits`` (household_id, category, month, position, action, value), in the order of their positions.

    assign sets what is assigned (blank: 0), fund sets it to a total, override sets the month's own target (blank: none).  What is no
    number changes nothing, nor does a negative target.  Assigning 0 or clearing a target deletes a row with nothing else in it; a
    total of 0 is kept as a row.  Both columns have a last edit each and only the last edit of all can delete, so edits of a row need
    no walk.  Rows of ``assignments`` are one for each household, category and month.
    """
    keys = [*BY, "category", "month"]
    kind = dict(assignments.dtypes)["assigned"]
    said = F.trim(F.coalesce("value", F.lit("")))
    number, own = said.try_cast("decimal(14,2)"), F.col("action") == "override"
    read = edits.withColumn("number", F.when((said == "") & ~own, 0).otherwise(number)).where(F.when(own, (said == "") | (F.col("number") >= 0)).otherwise(F.col("action").isin("assign", "fund") & F.col("number").isNotNull()))
    by = F.struct("position", "action")
    last = read.groupBy(*keys).agg(
        F.max_by(F.struct("number"), F.when(own, by)).alias("target"), F.max_by(F.struct("number"), F.when(~own, by)).alias("sum"), F.max_by("action", by).alias("last"),
    )
    both = assignments.withColumn("_held", F.lit(True)).join(last, keys, "full_outer")
    sum_ = F.when(F.col("sum").isNotNull(), F.col("sum.number").cast(kind)).otherwise(F.coalesce("assigned", F.lit(0).cast(kind)))
    target = F.when(F.col("target").isNotNull(), F.col("target.number").cast(kind)).otherwise(F.col("target_override"))
    after = both.withColumn("assigned", F.when(F.col("last").isNull(), F.col("assigned")).otherwise(sum_)).withColumn("target_override", target)
    return after.where((F.col("assigned") != 0) | F.col("target_override").isNotNull() | (F.col("last") == "fund") | F.col("last").isNull()).select(*assignments.columns)


def planned(settings: DataFrame, edits: DataFrame) -> DataFrame:
    """``settings`` after ``edits`` (household_id, category, position, action, value), in the order of their positions.

    rollover is on for the value true; a kind is by_date with the date in the value, or monthly.  Turning rollover on deletes a row
    with neither target nor date and makes none; everything else makes a row where there is none.  A deletion forgets what was set
    before it, so what holds is the last edit of each kind after the last deletion.
    """
    keys = [*BY, "category"]
    on = (F.col("action") == "rollover") & F.col("value").eqNullSafe(F.lit("true"))
    of_kind = F.col("action") == "by_date", F.col("action") == "monthly"
    date = F.struct(F.when(of_kind[0], F.col("value").try_cast("date")).alias("d"))
    held = settings.select(*keys, F.col("target").isNotNull().alias("_target"), F.col("target_date").alias("_date"))
    order = Window.partitionBy(*keys).orderBy("position")
    told = edits.where(F.col("action").isin("rollover", "by_date", "monthly")).join(held, keys, "left").withColumn("dated", F.last(F.when(of_kind[0] | of_kind[1], date), ignorenulls=True).over(order))
    bare = ~F.coalesce("_target", F.lit(False)) & F.when(F.col("dated").isNull(), F.col("_date").isNull()).otherwise(F.col("dated.d").isNull())
    told = told.withColumn("gone", F.max(F.when(on & bare, F.col("position"))).over(Window.partitionBy(*keys)))
    live = F.col("gone").isNull() | (F.col("position") > F.col("gone"))
    last = told.groupBy(*keys).agg(
        F.max_by(F.struct(F.when(of_kind[0], "by_date").otherwise("monthly").alias("kind"), date.getField("d").alias("d")), F.when(live & (of_kind[0] | of_kind[1]), F.col("position"))).alias("_kind"),
        F.max_by(on, F.when(live & (F.col("action") == "rollover"), F.col("position"))).alias("_on"), F.max(F.when(F.col("gone").isNotNull(), True)).alias("_gone"),
        F.max(F.when(live & ~on, True)).alias("_made"),
    )
    both = settings.withColumn("_held", F.lit(True)).join(last, keys, "full_outer")
    kept = F.col("_held") & F.col("_gone").isNull()
    both = both.where(F.coalesce(kept, F.lit(False)) | F.col("_made"))
    now = {
        "target": F.when(kept, F.col("target")), "rollover": F.coalesce("_on", F.when(kept, F.col("rollover")), F.lit(True)),
        "target_kind": F.when(F.col("_kind").isNotNull(), F.col("_kind.kind")).otherwise(F.coalesce(F.when(kept, F.col("target_kind")), F.lit("monthly"))),
        "target_date": F.when(F.col("_kind").isNotNull(), F.col("_kind.d")).otherwise(F.when(kept, F.col("target_date"))),
    }
    return both.select(*(now.get(c, F.col(c)).alias(c) for c in settings.columns))
