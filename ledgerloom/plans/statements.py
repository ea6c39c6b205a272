"""Printed statements as queries, with their SQL: finding the table's columns, and reading its rows by them.

Each household's orders are dealt to three accounts, whose statements of a month have one of three layouts: one unsigned amount under
headings of both directions, withdrawals beside deposits, and two dates with signed amounts under headings.  Some descriptions go on in
the next one or two lines, tables cross pages (a page's foot between a last row and its second line cuts that off), and every eighth household's statements have
no column headings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import amount
from ..functions.storage import held
from ..operators import importing
from ..sources import statement_runs, statement_tables
from . import fixture
from .oracles import _q

KEYS = ["household_id", "account_id", "month"]
PAGE_ROWS, PITCH, TOP = 4, 44, 100
col, lit = F.col, F.lit

#: Rows, headings (kind 0) and totals (kind 2) of each statement; what is printed, and in which place.
_ROWS = """SELECT CAST(c_nationkey AS INT) AS household_id, o_custkey % 3 AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate AS DATE) AS date, o_orderkey AS id, 'Vendor ' || CAST(o_orderkey % 50 AS STRING) AS description,
 CAST(floor(o_totalprice) AS BIGINT) + 1 AS dollars, (c_nationkey + o_custkey % 3) % 3 AS layout, CASE WHEN o_orderkey % 3 = 0 THEN 'in' ELSE 'out' END AS way, CASE WHEN (c_nationkey + o_custkey % 3) % 3 = 1 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS part FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
fixture.ALL["statement_items"] = f"""SELECT *, row_number() OVER (PARTITION BY household_id, account_id, month ORDER BY part, kind, date, id) - 1 AS slot FROM (
 SELECT *, 1 AS kind FROM ({_ROWS}) AS r UNION ALL SELECT household_id, account_id, month, min(date), CAST(-1 AS BIGINT), '', sum(dollars), layout, way, part, k FROM ({_ROWS}) AS q CROSS JOIN (VALUES (0), (2)) AS kinds(k) WHERE layout <> 1 GROUP BY household_id, account_id, month, layout, way, part, k) AS t"""


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Positioned text of all statements, with the width of their pages."""
    items = fixture.load(s, d, "statement_items").withColumn("page", F.floor(col("slot") / PAGE_ROWS).cast("int") + 1)

    def run(x: object, y: object, text: object, width: object = None) -> Column:
        text = text if isinstance(text, Column) else lit(text)
        number = lambda v: (v if isinstance(v, Column) else lit(v)).cast("double")
        return F.struct("page", number(x).alias("x"), number(y).alias("y"), number(5 * F.length(text) if width is None else width).alias("w"), lit(9.0).alias("h"), text.alias("text"), lit(600.0).alias("width"))

    first, second, pair = col("layout") == 0, col("layout") == 1, col("layout") == 2
    y, left = TOP + PITCH * (col("slot") % PAGE_ROWS), F.when(pair, 180).otherwise(150)
    money = F.concat(F.when(pair & (col("way") == "in"), "-$").otherwise("$"), F.format_number("dollars", 2))
    date = F.when(col("id") % 3 == 0, F.date_format("date", "MMM d")).when(col("id") % 3 == 1, F.date_format("date", "d MMMM")).otherwise(F.date_format("date", "M/d/yyyy"))
    end = F.when(second & (col("way") == "out"), 440).otherwise(560)
    row = F.array(run(40, y, date), run(left, y, col("description")), run(end - 5 * F.length(money), y, money))
    posted = F.array(run(110, y, F.date_format(F.date_add("date", 1), "M/d/yyyy")))
    wraps = F.concat(F.when(col("id") % 4 == 1, F.array(run(left + 2, y + 13.2, F.concat(lit("Ref "), col("id").cast("string"))))).otherwise(F.array()), F.when(col("id") % 8 == 5, F.array(run(left, y + 26.4, "Corner of Main Street"))).otherwise(F.array()))
    heading = F.when(first, F.when(col("way") == "in", "Deposits and Credits").otherwise("Electronic Withdrawals")).otherwise(F.when(col("way") == "in", "Payments and Credits").otherwise("Purchases"))
    printed = F.when(col("kind") == 0, F.array(run(40, y, heading))).when(col("kind") == 2, F.array(run(40, y, "Total of these"), run(560 - 5 * F.length(money), y, money))).otherwise(F.concat(row, F.when(pair, posted).otherwise(F.array()), wraps))
    names = F.when(first, F.array(run(40, 60, "Date", 20), run(150, 60, "Description", 55), run(525, 60, "Amount", 35))).when(
        second, F.array(run(40, 60, "Date", 20), run(150, 60, "Description", 55), run(380, 60, "Withdrawals", 55), run(520, 60, "Deposits", 40))
    ).otherwise(F.array(run(40, 60, "Trans Date", 50), run(110, 60, "Post Date", 45), run(180, 60, "Description", 55), run(525, 60, "Amount", 35)))
    foot = F.array(run(220, TOP + PITCH * (PAGE_ROWS - 1) + 17.5, "Additional Information on the next page", 195))
    title = F.concat(lit("Statement for "), F.date_format("month", "MMM d"), lit(" - "), F.date_format(F.last_day("month"), "MMM d, yyyy"))
    # A page's own text comes with its first slot, so that the items are read once.
    top = lambda when, runs: F.when(when, runs).otherwise(F.array())
    opens = col("slot") % PAGE_ROWS == 0
    return items.select(*KEYS, F.inline(F.concat(printed, top(opens & (col("household_id") % 8 != 7), names), top(opens, foot), top(col("slot") == 0, F.array(run(40, 20, title))))))


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    placed = held(statement_runs.lined(_runs(s, d), KEYS))
    return placed, held(statement_tables.layouts(placed, KEYS)), statement_runs.year_windows(placed, KEYS)


def queries() -> dict:
    def layouts(s: SparkSession, d: str) -> DataFrame:
        found = statement_tables.layouts(held(statement_runs.lined(_runs(s, d), KEYS)), KEYS)
        return found.select(*KEYS, F.array_join(F.transform("boundaries", lambda b: F.format_string("%.4f", b)), " ").alias("boundaries"), F.array_join("roles", " ").alias("roles"), "date_role", "amount_mode", "start_anchor")

    def table_rows(s: SparkSession, d: str) -> DataFrame:
        placed, layout, windows = _parts(s, d)
        return statement_tables.table_rows(placed, KEYS, layout, windows).select(*KEYS, "row", "page", "date_cell", "description_cell", "debit_cell", "credit_cell", "amount_cell", "section", "flipped")

    def imported(s: SparkSession, d: str) -> DataFrame:
        placed, layout, windows = _parts(s, d)
        rows = statement_tables.table_rows(placed, KEYS, layout, windows).withColumn("row", 1000 * (12 * F.year("month") + F.month("month")) + col("row"))
        return importing.built(rows, out_positive=True).select("household_id", "account_id", "row", "date", amount(col("amount")).alias("amount"), "description", "reason")

    def fits(s: SparkSession, d: str) -> DataFrame:
        """Each account's first layout on all its statements."""
        placed, layout, windows = _parts(s, d)
        own = layout.groupBy("household_id", "account_id").agg(F.min_by(F.struct(*(c for c in layout.columns if c not in KEYS)), "month").alias("l")).select("household_id", "account_id", "l.*")
        saved = placed.select(*KEYS).distinct().join(own.withColumn("start_anchor", F.when(col("account_id") == 1, "Another heading").otherwise(col("start_anchor"))), ["household_id", "account_id"])
        return statement_tables.layout_fits(placed, KEYS, saved, windows).groupBy("household_id", "account_id").agg(F.count("*").alias("statements"), F.count_if("anchor_found").alias("found"), F.count_if(~col("anchor_found") & col("suspect")).alias("lost"))

    return {"A24_layouts": layouts, "A25_table_rows": table_rows, "A25_J01_printed_import": imported, "A25_layout_fits": fits}


def _sql() -> dict[str, str]:
    said = "CASE id % 3 WHEN 0 THEN strftime(date, '%b %-d') WHEN 1 THEN strftime(date, '%-d %B') ELSE strftime(date, '%-m/%-d/%Y') END"
    parts = f"""it AS (SELECT *, CAST(row_number() OVER (PARTITION BY household_id, account_id, month ORDER BY slot) AS INT) AS n, CASE WHEN layout = 2 AND way = 'in' THEN '-' ELSE '' END || '$' || format('{{:,}}', dollars) || '.00' AS money, 40 + 5 * length({said}) AS d1, 110 + 5 * length(strftime(date + 1, '%-m/%-d/%Y')) AS d2, 5 * length(description) AS words
 FROM statement_items WHERE kind = 1 AND household_id % 8 <> 7),
pg AS (SELECT DISTINCT household_id, account_id, month, slot // {PAGE_ROWS} AS page FROM statement_items WHERE household_id % 8 <> 7),
ln AS (SELECT household_id, account_id, month, slot // {PAGE_ROWS} AS page, {TOP} + {PITCH} * (slot % {PAGE_ROWS}) AS y, CASE kind WHEN 1 THEN 'row' ELSE '' END AS what FROM statement_items UNION ALL SELECT household_id, account_id, month, slot // {PAGE_ROWS}, {TOP} + {PITCH} * (slot % {PAGE_ROWS}) + 13.2, '' FROM it WHERE id % 4 = 1
 UNION ALL SELECT household_id, account_id, month, slot // {PAGE_ROWS}, {TOP} + {PITCH} * (slot % {PAGE_ROWS}) + 26.4, '' FROM it WHERE id % 8 = 5 UNION ALL SELECT *, 60, 'heading' FROM pg UNION ALL SELECT *, {TOP + PITCH * (PAGE_ROWS - 1) + 17.5}, '' FROM pg),
hd AS (SELECT household_id, account_id, month, arg_max(page, (below, -page)) AS page FROM (SELECT *, count(*) FILTER (WHERE what = 'row') OVER (PARTITION BY household_id, account_id, month ORDER BY page, y ROWS BETWEEN 1 FOLLOWING AND {statement_tables.NEAR_LINES} FOLLOWING) AS below FROM ln) WHERE what = 'heading' AND below > 0 GROUP BY 1, 2, 3),
sm AS (SELECT * FROM it JOIN (SELECT household_id, account_id, month, page AS top FROM hd) USING (household_id, account_id, month) WHERE slot // {PAGE_ROWS} >= top QUALIFY row_number() OVER (PARTITION BY household_id, account_id, month ORDER BY slot) <= {statement_tables.SAMPLE_ROWS}),
ex AS (SELECT household_id, account_id, month, layout, greatest(CASE WHEN layout = 2 THEN 90 ELSE 60 END, max(d1)) AS d1, greatest(155, max(d2)) AS d2, CASE WHEN layout = 2 THEN 180 ELSE 150 END AS l, CASE WHEN layout = 2 THEN 180 ELSE 150 END + greatest(55, max(words)) AS r,
 least(525, 560 - 5 * max(length(money))) AS m, coalesce(least(380, 440 - 5 * max(length(money)) FILTER (WHERE way = 'out')), 380) AS w, coalesce(least(520, 560 - 5 * max(length(money)) FILTER (WHERE way = 'in')), 520) AS c, CASE WHEN bool_or(way = 'out') THEN 440 ELSE 435 END AS we, bool_or(way = 'in') AS has_in, bool_or(way = 'out') AS has_out
 FROM sm GROUP BY household_id, account_id, month, layout)"""
    cut = lambda a, b: f"printf('%.4f', round(({a} + 1 + {b}) / 2.0 / 600, 4))"
    layouts = f"""lay AS (SELECT household_id, account_id, month, layout, has_in, has_out, CASE layout WHEN 0 THEN concat_ws(' ', {cut("d1", "l")}, {cut("r", "m")}) WHEN 1 THEN concat_ws(' ', {cut("d1", "l")}, {cut("r", "w")}, {cut("we", "c")}) ELSE concat_ws(' ', {cut("d1", "110")}, {cut("d2", "l")}, {cut("r", "m")}) END AS boundaries,
 CASE WHEN layout = 0 THEN 'date description amount' WHEN layout = 2 THEN 'date date2 description amount' WHEN has_in AND has_out THEN 'date description debit credit' WHEN has_out THEN 'date description amount ignore' ELSE 'date description ignore amount' END AS roles,
 CASE WHEN layout = 2 THEN 'date2' ELSE 'date' END AS date_role, CASE WHEN layout = 1 AND has_in AND has_out THEN 'debitcredit' ELSE 'signed' END AS amount_mode, CASE layout WHEN 0 THEN 'Date Description Amount' WHEN 1 THEN 'Date Description Withdrawals Deposits' ELSE 'Trans Date Post Date Description Amount' END AS start_anchor FROM ex)"""
    # A column of money that has none in the sample isn't read, so what is printed there is no row.  Signs are decided by all of a file's rows.
    table = f"""tr AS (SELECT it.* EXCLUDE (n), CAST(row_number() OVER file AS INT) AS n, amount_mode, CASE WHEN layout = 2 THEN date + 1 ELSE date END AS said, description || CASE WHEN id % 4 = 1 THEN ' Ref ' || id ELSE '' END || CASE WHEN id % 8 = 5 AND slot % {PAGE_ROWS} <> {PAGE_ROWS - 1} THEN ' Corner of Main Street' ELSE '' END AS whole,
 layout = 0 AND way = 'in' AND bool_or(way = 'out') OVER (PARTITION BY household_id, account_id, month) AS flipped FROM it JOIN lay USING (household_id, account_id, month, layout) WHERE layout <> 1 OR CASE way WHEN 'in' THEN has_in ELSE has_out END WINDOW file AS (PARTITION BY household_id, account_id, month ORDER BY slot))"""
    then = ", ".join((parts, layouts, table))
    pair = "amount_mode = 'debitcredit'"
    return {
        "A24_layouts": _q("SELECT household_id, account_id, month, boundaries, roles, date_role, amount_mode, start_anchor FROM lay", "statement_items", then=", ".join((parts, layouts))),
        "A25_table_rows": _q(
            f"SELECT household_id, account_id, month, n AS row, CAST(slot // {PAGE_ROWS} + 1 AS INT) AS page, strftime(said, '%Y-%m-%d') AS date_cell, whole AS description_cell, CASE WHEN {pair} THEN CASE WHEN way = 'out' THEN dollars || '.00' ELSE '' END END AS debit_cell, CASE WHEN {pair} THEN CASE WHEN way = 'in' THEN dollars || '.00' ELSE '' END END AS credit_cell, CASE WHEN NOT {pair} THEN CASE WHEN flipped THEN '-' || dollars || '.00' ELSE money END END AS amount_cell, CASE WHEN layout <> 1 THEN way END AS section, flipped FROM tr",
            "statement_items", then=then,
        ),
        "A25_J01_printed_import": _q(
            f"SELECT household_id, account_id, 1000 * (12 * year(month) + month(month)) + n AS row, CAST(said AS DATE) AS date, CAST(CASE WHEN flipped OR (layout = 2 AND way = 'in') OR ({pair} AND way = 'in') THEN -dollars ELSE dollars END AS DOUBLE) AS amount, whole AS description, CAST(NULL AS VARCHAR) AS reason FROM tr",
            "statement_items", then=then,
        ),
        "A25_layout_fits": _q("SELECT household_id, account_id, count(*) AS statements, CASE WHEN account_id = 1 THEN 0 ELSE count(*) END AS found, CASE WHEN account_id = 1 THEN count(*) ELSE 0 END AS lost FROM (SELECT DISTINCT household_id, account_id, month FROM lay) GROUP BY 1, 2", "statement_items", then=", ".join((parts, layouts))),
    }


SQL = _sql()
