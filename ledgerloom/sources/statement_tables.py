"""The table of a printed statement: where its columns are and what they hold (a layout), and its rows by a layout.

Lines of ``statement_runs.lined`` runs are read file by file in windows: a heading's sign, the region between anchors and the row that a
wrapped description belongs to are last values over the lines before, so a file is never folded in one row.  Columns are found by
a sweep over the extents of a sample's runs: the gaps that no run reaches into.

A layout is a row of keys, boundaries (parts of the page's width), roles (one for each column: date, date2, description, debit,
credit, amount or ignore), date_role, amount_mode (signed, debitcredit), out_positive, start_anchor, stop_anchor, section_signs (null: decided by the
file) and pages (null: all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import parse_money
from ..functions.storage import held
from .statement_runs import flexible_date, looks_like_date, looks_like_money, plain_minus, section

#: Points of a gap between columns, at least.
GAP = 8
#: Lines after a heading in which its rows are counted, and rows that show what columns hold.
NEAR_LINES, SAMPLE_ROWS = 60, 40
HEADING_CHARS, ANCHOR_CHARS = 120, 60
#: Part of a column's cells that must agree on dates or money.
VOTE = 0.6
#: A wrapped description starts within so many points of its row's, and so many line heights below the line before.
WRAP_X, WRAP_HEIGHTS = 12.0, 1.8

# Words of column headings, in the order in which they are tried.
HEADING_ROLES = [
    (r"(?i)\btrans(action)?\s*date\b|\bpost(ing|ed)?\s*date\b|\bdate\b", "date"),
    (r"(?i)\bdescription\b|\bmerchant\b|\bpayee\b|\bdetails?\b|\btransaction\b", "description"),
    (r"(?i)\bdebit\b|\bcharges?\b|\bwithdrawals?\b", "debit"),
    (r"(?i)\bcredit\b|\bpayments?\b|\bdeposits?\b", "credit"),
    (r"(?i)\bamount\b", "amount"),
]
HEADING_MONEY = r"(?i)\bamount\b|\bdebit\b|\bcredit\b|\bcharges?\b|\bpayments?\b|\bdeposits?\b|\bwithdrawals?\b"
TOTAL = r"(?i)^total\b"


def _text(runs: Column) -> Column:
    """Runs from left to right, by one space."""
    return F.trim(F.regexp_replace(F.array_join(F.transform(runs, lambda r: r["text"]), " "), r"\s+", " "))


def page_lines(placed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, line, width, y, height, runs (from left to right), text, and whether some run is a date, or money.

    placed: ``lined`` runs with the width of their page.
    """
    run = F.struct(F.col("x").cast("double").alias("x"), F.col("text"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    flagged = placed.withColumn("a_date", looks_like_date(F.col("text"))).withColumn("a_sum", looks_like_money(F.col("text")))
    lines = flagged.groupBy(*keys, "page", "line").agg(
        F.max("width").cast("double").alias("width"), F.avg("y").alias("y"), F.max(F.coalesce(F.nullif("h", F.lit(0.0)), F.lit(10.0))).alias("height"),
        F.array_sort(F.collect_list(run)).alias("runs"), F.coalesce(F.max("a_date"), F.lit(False)).alias("dated"), F.coalesce(F.max("a_sum"), F.lit(False)).alias("priced"),
    )
    return lines.withColumn("text", _text(F.col("runs")))


def _celled(runs: Column, boundaries: Column, width: Column) -> Column:
    """Runs with the column that their middle is in."""
    return F.transform(runs, lambda r: F.struct(r["x"].alias("x"), r["text"].alias("text"), F.size(F.filter(boundaries, lambda b: r["x"] + r["w"] / 2 >= b * width)).alias("cell")))


# ---- finding the columns ----------------------------------------------------------------------------------------


def _sample(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Of each file with a heading that rows follow, that heading (rank 1) and the first rows below it."""
    by = Window.partitionBy(*keys).orderBy("page", "line")
    row = F.col("dated") & F.col("priced")
    heading = F.col("text").rlike(r"(?i)\bdate\b") & F.col("text").rlike(HEADING_MONEY) & (F.length("text") <= HEADING_CHARS) & ~F.col("dated") & ~F.col("priced")
    told = lines.select("*", row.alias("row"), heading.alias("heading"), F.row_number().over(by).alias("n"), F.count_if(row).over(by.rowsBetween(1, NEAR_LINES)).alias("below"))
    best = F.max(F.when(F.col("heading") & (F.col("below") > 0), F.struct("below", (-F.col("n")).alias("first"), F.col("width").alias("of")))).over(Window.partitionBy(*keys))
    kept = told.withColumn("best", best).where(F.col("best").isNotNull() & ((F.col("n") == -F.col("best.first")) | (F.col("row") & (F.col("n") > -F.col("best.first")))))
    ranked = kept.withColumn("width", F.col("best.of")).withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= 1 + SAMPLE_ROWS).select(*keys, "rank", "width", "runs", "text")


def _boundaries(sample: DataFrame, keys: list[str]) -> DataFrame:
    """The middles of the gaps between the extents of all runs: a sweep from the left with the furthest end so far."""
    ends = sample.select(*keys, "width", F.explode("runs").alias("r")).select(
        *keys, "width", F.greatest(F.floor("r.x"), F.lit(0)).alias("left"), F.least(F.ceil(F.col("r.x") + F.col("r.w")), F.ceil("width")).alias("right")
    )
    before = Window.partitionBy(*keys).orderBy("left", "right").rowsBetween(Window.unboundedPreceding, -1)
    swept = ends.where("left <= right").withColumn("free", F.max("right").over(before) + 1).where(F.col("left") - F.col("free") >= GAP)
    return swept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.round((F.col("free") + F.col("left")) / 2 / F.col("width"), 4))).alias("boundaries"))


def layouts(placed: DataFrame, keys: list[str]) -> DataFrame:
    """A layout for each file in which one can be found.

    Of lines that name a date and money, but have none, the one with the most rows in the next lines heads the table; files without one, or
    whose runs leave no gap, are refused: no row.  Dates and money need the vote of a column's cells; headings tell two columns of money apart.
    """
    sample = held(_sample(page_lines(placed, keys), keys))
    cut = sample.join(_boundaries(sample, keys), keys)
    runs = cut.select(*keys, "rank", F.explode(_celled(F.col("runs"), F.col("boundaries"), F.col("width"))).alias("r"))
    cells = runs.groupBy(*keys, "rank", "r.cell").agg(_text(F.array_sort(F.collect_list("r"))).alias("text")).where("text <> ''")
    body, a_date, a_sum = F.col("rank") > 1, looks_like_date(F.col("text")), looks_like_money(F.col("text"))
    columns = cells.groupBy(*keys, "cell").agg(
        F.count_if(body).alias("n"), F.count_if(body & a_date).alias("dates"), F.count_if(body & ~a_date & a_sum).alias("sums"), F.count_if(body & ~a_date & ~a_sum).alias("words"),
        F.avg(F.when(body, F.length("text"))).alias("length"), F.max(F.when(~body, F.col("text"))).alias("heading"),
    )
    file, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("cell")
    named = F.coalesce(*(F.when(F.col("heading").rlike(p), role) for p, role in HEADING_ROLES))
    kinds = columns.withColumn("date", (F.col("n") > 0) & (F.col("dates") >= VOTE * F.col("n"))).withColumn("money", ~F.col("date") & (F.col("n") > 0) & (F.col("sums") >= VOTE * F.col("n"))).withColumn("named", named)
    first = lambda role: F.min(F.when(F.col("money") & (F.col("named") == role), F.col("cell"))).over(file)
    ranked = kinds.select("*", F.count_if("date").over(order).alias("d"), F.count_if("money").over(order).alias("m"), F.count_if("money").over(file).alias("of"), first("debit").alias("out"), first("credit").alias("in"))
    both = F.col("out").isNotNull() & F.col("in").isNotNull()
    pair = F.when(F.col("m") > 2, "ignore").when(both, F.when(F.col("cell") == F.col("out"), "debit").when(F.col("cell") == F.col("in"), "credit")).when(F.col("m") == 1, "debit").when(F.col("m") == 2, "credit")
    role = F.coalesce(F.when(F.col("date"), F.when(F.col("d") == 1, "date").otherwise("date2")).when(F.col("money"), F.when(F.col("of") == 1, "amount").otherwise(pair)), F.lit("ignore"))
    text = F.when((F.col("role") == "ignore") & (F.col("words") > 0), F.struct("length", (-F.col("cell")).alias("left")))
    widest = ranked.withColumn("role", role).withColumn("widest", F.max(text).over(file))
    final = widest.select(*keys, "cell", F.when((F.col("role") == "ignore") & (F.col("cell") == -F.col("widest.left")), "description").otherwise(F.col("role")).alias("role"))
    roles = final.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "role"))).alias("by"))
    heads = cut.where("rank = 1").select(*keys, "boundaries", F.substring("text", 1, ANCHOR_CHARS).alias("start_anchor"))
    filled = heads.join(roles, keys).withColumn("roles", F.transform(F.sequence(F.lit(0), F.size("boundaries")), lambda k: F.coalesce(F.try_element_at("by", k), F.lit("ignore"))))
    has = lambda role: F.array_contains("roles", role)
    return filled.select(
        *keys, "boundaries", "roles", F.when(has("date2"), "date2").otherwise("date").alias("date_role"), F.when(has("debit") & has("credit"), "debitcredit").otherwise("signed").alias("amount_mode"), F.lit(True).alias("out_positive"),
        "start_anchor", F.lit("").alias("stop_anchor"), F.lit(None).cast("boolean").alias("section_signs"), F.lit(None).cast("array<int>").alias("pages"),
    )


# ---- reading the rows -------------------------------------------------------------------------------------------


def _told(placed: DataFrame, keys: list[str], layout: DataFrame, windows: DataFrame) -> DataFrame:
    """Lines with what they are: start, stop, row, wrapped (a row's description goes on), and section; row_no counts rows."""
    at = F.col
    lines = page_lines(placed, keys).drop("dated", "priced").join(layout, keys).where(at("pages").isNull() | F.array_contains("pages", at("page")))
    lines = lines.withColumn("runs", _celled(at("runs"), at("boundaries"), at("width"))).join(windows.select(*keys, "first", "last"), keys, "left")
    place = lambda role: F.array_position("roles", role) - 1
    of = lambda role: F.filter("runs", lambda r: r["cell"] == place(role))
    texts = lines.select(
        *keys, "page", "line", "y", "height", "text", "date_role", "amount_mode", "out_positive", "start_anchor", "stop_anchor", "section_signs", "first", "last", *(_text(of(F.lit(r))).alias(f"{r}_text") for r in ("description", "debit", "credit", "amount")), _text(of(at("date_role"))).alias("date_text"),
        F.array_min(F.transform(of(F.lit("description")), lambda r: r["x"])).alias("left"),
        (~F.exists("runs", lambda r: (r["cell"] != place(F.lit("description"))) & (F.trim(r["text"]) != ""))).alias("alone"),
    )
    says = lambda anchor: F.coalesce((at(anchor) != "") & F.contains(F.lower("text"), F.lower(anchor)), F.lit(False))
    money = looks_like_money(at("debit_text")) | looks_like_money(at("credit_text")) | looks_like_money(at("amount_text"))
    texts = held(texts)  # what follows names each of these texts many times
    lines = texts.select("*", flexible_date(at("date_text"), at("first"), at("last")).alias("date"), money.alias("priced"), says("start_anchor").alias("start"), (~says("start_anchor") & says("stop_anchor")).alias("stop"))

    by = Window.partitionBy(*keys).orderBy("page", "line")
    last = lambda c: F.last(c, ignorenulls=True).over(by)
    inside = F.coalesce(last(F.when(at("start"), True).when(at("stop"), False)), F.coalesce(at("start_anchor") == "", F.lit(True))) & ~at("start") & ~at("stop")
    lines = lines.withColumn("inside", inside).withColumn("row", at("inside") & at("date").isNotNull() & at("priced"))
    down = at("y") - F.lag("y").over(by)
    fits = at("inside") & at("date").isNull() & ~at("priced") & (at("description_text") != "") & at("alone") & (at("page") == F.lag("page").over(by)) & (down > 0) & (down < at("height") * WRAP_HEIGHTS)
    lines = lines.withColumn("beside", last(F.when(at("row"), F.struct("left"))))
    lines = lines.withColumn("fits", F.coalesce(fits & (F.abs(at("left") - at("beside.left")) <= WRAP_X), F.lit(False)))
    lines = lines.withColumn("ends", F.count_if(~at("row") & ~at("fits")).over(by))
    lines = lines.withColumn("wrapped", F.coalesce(at("fits") & (at("ends") == last(F.when(at("row"), at("ends")))), F.lit(False)))
    mark = F.when(at("stop"), "none").when(~at("start") & ~at("row") & ~at("wrapped"), F.when(F.trim("text").rlike(TOTAL), "none").otherwise(section(at("text"))))
    return lines.withColumn("section", F.nullif(last(mark), F.lit("none"))).withColumn("row_no", F.count_if("row").over(by))


def table_rows(placed: DataFrame, keys: list[str], layout: DataFrame, windows: DataFrame) -> DataFrame:
    """keys, row, page, line, date_cell, description_cell, debit_cell, credit_cell, amount_cell, section and flipped, as ``importing.built`` takes them.

    A line within the anchors is a row if its date and some money can be read.  The single amount under headings of both directions is
    turned where the heading says so, unless most of those amounts have that sign already.  windows: ``year_windows``.
    """
    told = _told(placed, keys, layout, windows).where("row or wrapped")
    head = lambda c: F.max(F.when(F.col("row"), F.col(c))).alias(c)
    words = F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "description_text"))), lambda r: r["description_text"])
    rows = told.groupBy(*keys, "row_no").agg(*(head(c) for c in ("page", "line", "date", "section", "amount_mode", "out_positive", "section_signs", "debit_text", "credit_text", "amount_text")), F.trim(F.array_join(words, " ")).alias("description"))
    pair, file = F.col("amount_mode") == "debitcredit", Window.partitionBy(*keys)
    side = lambda c: parse_money(plain_minus(F.col(c))).cast("decimal(14,2)")
    # Read before the windows, so that they aren't read again for each use.
    rows = rows.select("*", side("amount_text").alias("value"), (side("debit_text") - side("credit_text")).alias("net"))
    turns = ~pair & (F.col("section") == F.when(F.col("out_positive"), "in").otherwise("out")) & F.coalesce(F.col("value") != 0, F.lit(False))
    rows = rows.withColumn("turns", F.coalesce(turns, F.lit(False)))
    n, agree = F.count_if("turns").over(file), F.count_if(F.col("turns") & (F.col("value") < 0)).over(file)
    saw = lambda way: F.coalesce(F.max(F.col("section") == way).over(file), F.lit(False))
    auto = F.col("section_signs").isNull() & saw("in") & saw("out") & (agree <= n / 2)
    rows = rows.withColumn("flipped", F.col("turns") & (F.coalesce(F.col("section_signs"), F.lit(False)) | auto))
    cell = lambda c, sign: F.when(pair, F.when(F.col("net").isNull(), F.trim(plain_minus(F.col(c)))).when(F.col("net") * sign > 0, (F.col("net") * sign).cast("decimal(14,2)").cast("string")).otherwise(""))
    amount = F.when(~pair, F.when(F.col("flipped"), (-F.col("value")).cast("decimal(14,2)").cast("string")).otherwise(plain_minus(F.col("amount_text"))))
    return rows.select(*keys, F.col("row_no").alias("row"), "page", "line", F.col("date").cast("string").alias("date_cell"), F.col("description").alias("description_cell"), cell("debit_text", 1).alias("debit_cell"), cell("credit_text", -1).alias("credit_cell"), amount.alias("amount_cell"), "section", "flipped")


def layout_fits(placed: DataFrame, keys: list[str], layout: DataFrame, windows: DataFrame) -> DataFrame:
    """keys, rows, anchor_found and suspect (no anchor, or no rows: the layout is not this file's) of each file with a layout."""
    told = _told(placed, keys, layout, windows).groupBy(*keys).agg(F.max("row_no").alias("rows"), F.max(F.col("start") | F.coalesce(F.col("start_anchor") == "", F.lit(True))).alias("anchor_found"))
    return told.withColumn("suspect", ~F.col("anchor_found") | (F.col("rows") == 0))
