"""Statement rows: parsing, ids, what to import, and reconciliation with what a feed delivered."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.grouped import apply_in_groups
from ..functions.money import parse_date, parse_money
from ..functions.shipping import ship
from ..functions.storage import held
from ..functions.text import description_tokens, normal_description, present, similarity
from .matching import match

BY = ["household_id", "account_id"]
ID_PREFIX = "csv:"
RECONCILE_DAYS = 4
LEAST_SIMILARITY, CLOSE_ABSOLUTE, CLOSE_RATIO = 0.6, 15.0, 0.3


@F.pandas_udf(StringType())
def fnv1a64(texts: pd.Series) -> pd.Series:
    """64-bit FNV-1a over UTF-16 units, as 16 hex digits (an id's wire format); all texts of a batch a unit at a time."""
    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    size = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-size, kind="stable")
    first = (np.cumsum(size) - size)[order]
    flat, value = np.concatenate([*units, np.empty(0, np.uint16)]).astype(np.uint64), np.full(len(units), 0xCBF29CE484222325, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size[order], -k, "left"))  # texts with more than k units
            value[:n] = (value[:n] ^ flat[first[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty(len(units), object)
    out[order] = [f"{v:016x}" for v in value.tolist()]
    return pd.Series(out, index=texts.index)


def signed_amount(out_positive: bool = False) -> Column:
    """Money out is positive: debit less credit where a row has them, else its one amount by the file's sign."""
    single = parse_money(F.col("amount_cell"))
    two = F.abs(parse_money(F.col("debit_cell"))) - F.abs(parse_money(F.col("credit_cell")))
    return F.when(F.col("amount_cell").isNull(), two).otherwise(single if out_positive else -single)


def built(cells: DataFrame, existing: DataFrame | None = None, overlap: DataFrame | None = None, out_positive: bool = False) -> DataFrame:
    """Every row of statements with its date, amount, external id and problems.

    cells: household_id, account_id, row, date_cell, description_cell, and amount_cell or debit_cell and credit_cell.
    existing: household_id, account_id, external_id; overlap: household_id, account_id, overlap_from.  reason is null for
    rows that can be imported.
    """
    ship(cells.sparkSession)
    for name in ("amount_cell", "debit_cell", "credit_cell"):
        if name not in cells.columns:
            cells = cells.withColumn(name, F.lit(None).cast("string"))
    text = F.trim(F.coalesce("description_cell", F.lit("")))
    rows = cells.select(*BY, "row", parse_date(F.col("date_cell")).alias("date"), signed_amount(out_positive).alias("value"), text.alias("description"))
    problems = F.concat_ws(", ", F.when(F.col("date").isNull(), "unparseable date"), F.when(F.col("value").isNull(), "unparseable amount"), F.when(F.col("description") == "", "empty description"))
    rows = rows.withColumn("reason", F.when(problems != "", problems).when(F.abs("value") < 0.005, "zero amount")).withColumn("amount", F.col("value").cast("decimal(14,2)"))
    key = F.concat_ws("|", F.col("date").cast("string"), F.col("amount").cast("string"), normal_description(F.col("description")))
    rows = rows.withColumn("key", F.when(F.col("reason").isNull(), key))
    order = Window.partitionBy(*BY, "key").orderBy("row")
    rows = rows.withColumn("ordinal", F.row_number().over(order) - 1).withColumn("external_id", F.when(F.col("reason").isNull(), F.concat(F.lit(ID_PREFIX), fnv1a64("key"), F.lit(":"), F.col("ordinal").cast("string"))))
    if existing is not None:
        rows = rows.join(existing.select(*BY, "external_id").distinct().withColumn("duplicate", F.lit(True)), [*BY, "external_id"], "left")
    else:
        rows = rows.withColumn("duplicate", F.lit(False))
    rows = rows.join(overlap.select(*BY, "overlap_from"), BY, "left") if overlap is not None else rows.withColumn("overlap_from", F.lit(None).cast("date"))
    return rows.select(*BY, "row", "date", "amount", "description", "external_id", "ordinal", "reason", F.coalesce("duplicate", F.lit(False)).alias("duplicate"), F.coalesce(F.col("date") >= F.col("overlap_from"), F.lit(False)).alias("overlap"), "overlap_from")


def import_plan(rows: DataFrame) -> DataFrame:
    """Per account: what to do with a statement (import, audit, both, empty) and counts."""
    good = F.col("reason").isNull()
    out = rows.groupBy(*BY).agg(
        F.count_if(good).alias("usable"), F.count_if(good & F.col("overlap")).alias("overlapping"), F.count_if(good & F.col("duplicate") & ~F.col("overlap")).alias("duplicates"),
        F.count_if(good & ~F.col("duplicate") & ~F.col("overlap")).alias("new"), F.count_if(~good).alias("skipped"), F.max("overlap_from").alias("overlap_from"),
    )
    verdict = F.when(F.col("usable") == 0, "empty").when(F.col("overlap_from").isNull() | (F.col("overlapping") == 0), "import").when(F.col("overlapping") == F.col("usable"), "audit").otherwise("both")
    return out.withColumn("verdict", verdict).drop("overlap_from")


def reconcile(statement: DataFrame, feed: DataFrame) -> DataFrame:
    """Every row of both sides with its outcome: matched, mismatch (amounts differ), statement_only or feed_only.

    Both sides: household_id, account_id, id, date, amount, description.  Equal amounts within four days are matched one
    to one first; what is left meets by similar wording, paired in order.  Rows further apart than RECONCILE_DAYS never
    meet, so gaps of that length split an account's rows of an amount, and then its leftovers, into stretches: the groups.
    Stretches of one side, and of one row on each side where amounts are equal, are settled in the JVM.
    """
    kinds = dict(statement.dtypes)
    side = lambda df, n: df.select(*BY, "id", "date", F.col("amount").cast("double").alias("amount"), F.coalesce("description", F.lit("")).alias("description"), F.lit(n).alias("side"))
    names = [*BY, "id", "date", "amount", "description", "side"]

    def in_stretches(df: DataFrame, keys: list[str]) -> DataFrame:
        """``df`` with stretch, n (its rows) and told (those of the statement)."""
        order = Window.partitionBy(*keys).orderBy("date", "side", "id")
        new = df.withColumn("new", F.coalesce((F.datediff("date", F.lag("date").over(order)) > RECONCILE_DAYS).cast("int"), F.lit(0)))
        cut = new.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new")
        whole = Window.partitionBy(*keys, "stretch")
        return cut.withColumn("n", F.count("*").over(whole)).withColumn("told", F.count_if(F.col("side") == "statement").over(whole))

    def split(rows: list[tuple], own: int) -> tuple[list[tuple], list[tuple]]:
        """Both sides as day, description, amount, id as text, id and what follows; rows begin with ``own`` columns of keys."""
        sides: dict[str, list[tuple]] = {"statement": [], "feed": []}
        for row in rows:
            id_, date, amount, description, name = row[own : own + 5]
            sides[name].append((date.toordinal(), description, amount, str(id_), id_, *row[own + 5 :]))
        return tuple(sorted(sides[n], key=lambda r: r[:4]) for n in ("statement", "feed"))

    def equal(rows: list[tuple]) -> list[tuple]:
        """Matches, and with no outcome the rows that are left."""
        a, b = split(rows, 4)
        pairs = match([(r[0], 0, k) for k, r in enumerate(a)], [(r[0], 1, k) for k, r in enumerate(b)], RECONCILE_DAYS)
        out = [(a[i][4], b[j][4], "matched", float(abs(a[i][0] - b[j][0])), 0.0, *rows[0][:2], None, None, None, None, None) for i, j in pairs]
        used = {a[i][3] for i, _ in pairs}, {b[j][3] for _, j in pairs}
        return out + [(None, None, None, None, None, *r[:2], *r[4:9]) for r in rows if str(r[4]) not in used[r[8] == "feed"]]

    def similar(rows: list[tuple]) -> list[tuple]:
        a, b = split(rows, 3)
        days, sets, used, out = [y[0] for y in b], [set(y[5] or ()) for y in b], set(), []
        for x in a:
            best, found, words = 0.0, None, set(x[5] or ())
            for k in range(bisect_left(days, x[0] - RECONCILE_DAYS), bisect_right(days, x[0] + RECONCILE_DAYS)):
                gap = abs(x[2] - b[k][2])
                if k in used or (gap > CLOSE_ABSOLUTE and gap / max(abs(x[2]), abs(b[k][2]), 0.01) > CLOSE_RATIO):
                    continue
                alike = len(words & sets[k]) / len(words | sets[k]) if words and sets[k] else 0.0
                if alike >= LEAST_SIMILARITY and alike > best:
                    best, found = alike, k
            if found is None:
                out.append((x[4], None, "statement_only", None, None))
            else:
                used.add(found)
                out.append((x[4], b[found][4], "mismatch", float(abs(x[0] - b[found][0])), round(x[2] - b[found][2], 2)))
        out += [(None, y[4], "feed_only", None, None) for k, y in enumerate(b) if k not in used]
        return [(*o, *rows[0][:2]) for o in out]

    schema = f"statement_id {kinds['id']}, feed_id {kinds['id']}, outcome string, gap_days double, difference double, household_id int, account_id {kinds['account_id']}"
    both = side(statement, "statement").unionByName(side(feed, "feed")).where("date is not null and amount is not null")
    first = held(in_stretches(both.withColumn("cents", F.rint(F.col("amount") * 100).cast("long")), [*BY, "cents"]))
    one_side = (F.col("told") == 0) | (F.col("told") == F.col("n"))
    told = F.col("side") == "statement"
    pairs = first.where(~one_side & (F.col("n") == 2)).groupBy(*BY, "cents", "stretch").agg(F.max(F.when(told, F.col("id"))).alias("statement_id"), F.max(F.when(~told, F.col("id"))).alias("feed_id"), F.datediff(F.max("date"), F.min("date")).cast("double").alias("gap_days"))
    hard = held(apply_in_groups(first.where(~one_side & (F.col("n") > 2)).select(*BY, "cents", "stretch", *names[2:]), [*BY, "cents", "stretch"], equal, f"{schema}, id {kinds['id']}, date {kinds['date']}, amount double, description string, side string"))
    left = held(in_stretches(first.where(one_side).select(*names).unionByName(hard.where("outcome is null").select(*names)), BY))
    alone = left.where(one_side).select(F.when(told, F.col("id")).alias("statement_id"), F.when(~told, F.col("id")).alias("feed_id"), F.concat("side", F.lit("_only")).alias("outcome"), F.lit(None).cast("double").alias("gap_days"), F.lit(None).cast("double").alias("difference"), *BY)
    mixed = left.where(~one_side).select(*BY, "stretch", *names[2:], description_tokens(F.col("description")).alias("tokens"))
    matched = pairs.select("statement_id", "feed_id", F.lit("matched").alias("outcome"), "gap_days", F.lit(0.0).alias("difference"), *BY).unionByName(hard.where("outcome is not null").select(*alone.columns))
    return matched.unionByName(alone).unionByName(apply_in_groups(mixed, [*BY, "stretch"], similar, schema))


def description_similarity(a: Column, b: Column) -> Column:
    return similarity(description_tokens(a), description_tokens(b))


def upsert(held: DataFrame, new: DataFrame, keys: list[str], sent: list[str], arrival: str | None = None) -> DataFrame:
    """``held`` with the rows of ``new`` by key: the columns in ``sent`` are overwritten, the others are kept.

    Of several new rows with a key the first counts: by the column ``arrival``, where rows say in what order they came, then by what is sent.
    """
    order = [arrival, *sent] if arrival else sent
    fresh = new.groupBy(*keys).agg(F.min_by(F.struct(*sent), F.struct(*order)).alias("_sent"))
    both = held.join(fresh, keys, "full_outer")
    return both.select(*((F.when(F.col("_sent").isNotNull(), F.col(f"_sent.{c}")).otherwise(F.col(c)).alias(c) if c in sent else F.col(c)) for c in held.columns))


def changed_snapshots(accounts: DataFrame, pulled: DataFrame, on: str) -> DataFrame:
    """A snapshot per account whose balance moved.  pulled: household_id (where ids are unique within a household only), account_id, balance."""
    keys = [k for k in BY if k in pulled.columns]
    moved = pulled.join(accounts.select(*keys, "current_balance"), keys).where(~F.col("balance").eqNullSafe(F.col("current_balance")))
    return moved.select(*keys, F.lit(on).cast("date").alias("captured_on"), "balance")


def search(rows: DataFrame, query: str = "", least: float | None = None, most: float | None = None, start: str | None = None, end: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of rows whose wording holds the query and whose absolute amount and date are in range, newest first, with has_more."""
    wanted = query.translate({ord(c): None for c in ',()"'}).lower().strip()
    if wanted:
        said = F.concat_ws("\n", "description", "merchant_name", "user_description")
        rows = rows.where(F.lower(said).contains(wanted))
    if least is not None and most is not None and least > most:
        least, most = most, least
    for bound, test in ((least, lambda c, v: c >= v), (most, lambda c, v: c <= v)):
        if bound is not None:
            rows = rows.where(test(F.abs("amount"), bound))
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    page = rows.orderBy(F.col("date").desc(), F.col("id").desc()).offset(offset).limit(limit + 1)
    order = Window.orderBy(F.col("date").desc(), F.col("id").desc())  # one page of rows
    ranked = page.withColumn("n", F.row_number().over(order)).withColumn("has_more", F.max("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit)
    return ranked.where(F.col("n") <= limit)


def coverage(rows: DataFrame) -> DataFrame:
    """first and last date, count, and counts by source of each account; rows without a date count too."""
    parts = rows.where("account_id is not null").groupBy(*BY, F.coalesce(present(F.col("source")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    sources = F.array_sort(F.collect_list(F.concat_ws("=", "source", F.col("n").cast("string"))))  # a handful of sources
    return parts.groupBy(*BY).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("count"), F.array_join(sources, ",").alias("sources"))


def coverage_gaps(accounts: DataFrame, rows: DataFrame, reach: int = 88, grace: int = 7) -> DataFrame:
    """Feed accounts whose first row falls in what the feed could first reach.  accounts: account_id, created_on."""
    first = rows.groupBy(*BY).agg(F.min("date").alias("served_from"))
    both = accounts.select(*BY, "created_on").join(first, BY)
    return both.where((F.col("served_from") >= F.date_sub("created_on", reach)) & (F.col("served_from") <= F.date_add("created_on", grace))).select("household_id", "account_id", "served_from")


def statement_totals(rows: DataFrame) -> DataFrame:
    """Per account of ``built`` rows that can be imported: money out and in, and the first and last date, by which a feed is read to compare."""
    # No filter: it would be pushed below what parses the cells, and parse them again.
    good = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    narrow = rows.select(*BY, good("amount").alias("amount"), good("date").alias("date"))
    part = lambda sign: F.sum(F.greatest(sign * F.col("amount"), F.lit(0))).cast("double")
    out = narrow.groupBy(*BY).agg(part(1).alias("money_out"), part(-1).alias("money_in"), F.min("date").alias("first"), F.max("date").alias("last"))
    return out.where("first is not null")


def search_amount(text: Column) -> Column:
    """What a user types as a bound, without sign, $ or separators; null for no bound."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[$,\s]", "")
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.abs(plain.cast("double")))


def search_date(text: Column) -> Column:
    """A whole date of the years 1990 to 2100 as it was typed, else null: a year that is still being typed is no bound."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.substring(text, 1, 4).between("1990", "2100"), text)
