"""Statements as positioned text: runs become lines, lines become cells, and dates without a year get the statement's.

A run is a row of a file: page, x, y, w, h and text.  Pages are grouped by file and page, files by their keys; nothing larger
than a page is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: Points that runs of one line are apart at most, and how far from it rounding of a mean can't reach.
Y_TOLERANCE, Y_MARGIN = 3.0, 1e-6
#: Days that a statement's dates may lie outside its period, and a period's greatest length.
PAD_DAYS, LONGEST_PERIOD = 45, 200
#: Days before and after the middle one of the printed dates, where no period is found.
BEFORE_MEDIAN, AFTER_MEDIAN = 120, 45

# Names of months.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
# Shapes of dates, amounts and section headings.
_NAMES = "|".join(MONTHS)
MONTH_DAY = rf"(?i)^({_NAMES})\.?\s+(\d{{1,2}})(?:\s*,?\s*(\d{{4}}))?$"
DAY_MONTH = rf"(?i)^(\d{{1,2}})\s+({_NAMES})\.?(?:\s*,?\s*(\d{{4}}))?$"
MONEY = r"^[-+(]?\s*\$?\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s*\)?$|^[-+(]?\s*\$?\s*\d+\.\d{2}\s*\)?$"
_DATED = r"[A-Za-z]{3,9}\.?\s*\d{1,2},?\s*\d{2,4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}"
_TO = r"\s*(?:-|–|—|to|through|thru)\s*"
SPAN = r"(?i)[-–—]|to|thr"  # in all periods, and in few other lines
PERIOD = rf"(?i)({_DATED}){_TO}({_DATED})"
OPEN_PERIOD = rf"(?i)([A-Za-z]{{3,9}}\.?\s*\d{{1,2}}){_TO}({_DATED})"
SECTION_IN = r"(?i)\b(deposits?|credits?|additions)\b"
SECTION_OUT = r"(?i)\b(withdrawals?|debits?|purchases?|checks?|fees?|charges?|payments?)\b"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(text: Column, pattern: str) -> Column:
    return F.struct(*(F.regexp_extract(text, pattern, k).alias(f"p{k}") for k in (1, 2, 3)))


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(known, F.lower(name))


def _full_year(text: Column) -> Column:
    return F.when(F.length(text) == 2, text.try_cast("int") + F.when(text >= "70", 1900).otherwise(2000)).otherwise(text.try_cast("int"))


def numeric_date(text: Column) -> Column:
    """ISO, or month/day/year with / . or -."""
    us = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2}|\d{4})$"
    by_us = lambda t: _bound(_parts(t, us), lambda p: _date(_full_year(p["p3"]), p["p1"], p["p2"]))
    return _bound(text, lambda t: F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")).when(t.rlike(us), by_us(t)))


def dated(text: Column) -> Column:
    """A date that names its year (two or four digits): by the month's name, or in numbers."""
    named = r"(?i)^([A-Z]{3,9})\.?\s*(\d{1,2})\s*,?\s*(\d{2,4})$"
    by_name = lambda t: _bound(_parts(t, named), lambda p: _date(_full_year(p["p3"]), _month(p["p1"]), p["p2"]))
    return _bound(F.trim(text), lambda t: F.when(t.rlike(named), by_name(t)).otherwise(numeric_date(t)))


def infer_year(month: Column, day: Column, first: Column, last: Column) -> Column:
    """The date of a month and day in the year that puts it in, or else nearest to, first to last; of equals the earlier."""
    years = F.sequence(F.year(first) - 1, F.year(last) + 1)
    dates = F.filter(F.transform(years, lambda y: _date(y, month, day)), lambda d: d.isNotNull())
    away = lambda d: F.greatest(F.datediff(first, d), F.datediff(d, last), F.lit(0))
    return F.array_min(F.transform(dates, lambda d: F.struct(away(d).alias("away"), d.alias("date"))))["date"]


def flexible_date(text: Column, first: Column, last: Column) -> Column:
    """Any date a statement prints; one without a year gets that of the window from first to last."""

    def named(t: Column, pattern: str, m: str, d: str) -> Column:
        return _bound(_parts(t, pattern), lambda p: F.when(p["p3"] != "", _date(p["p3"], _month(p[m]), p[d])).otherwise(infer_year(_month(p[m]), p[d], first, last)))

    return _bound(F.trim(F.coalesce(text, F.lit(""))), lambda t: F.when(t.rlike(MONTH_DAY), named(t, MONTH_DAY, "p1", "p2")).when(t.rlike(DAY_MONTH), named(t, DAY_MONTH, "p2", "p1")).otherwise(numeric_date(t)))


def plain_minus(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[−–—]", "-")


def looks_like_money(text: Column) -> Column:
    """Digits with cents, separators, a sign or $; a bare whole number is a year or a count."""
    text = F.trim(plain_minus(text))
    return text.rlike(MONEY) & ~text.rlike(r"^\d+$")


def looks_like_date(text: Column) -> Column:
    text = F.trim(F.coalesce(text, F.lit("")))
    return text.rlike(MONTH_DAY) | text.rlike(DAY_MONTH) | numeric_date(text).isNotNull()


def section(text: Column) -> Column:
    """in or out for a heading of words only that says so, else null."""
    text = F.trim(F.coalesce(text, F.lit("")))
    heading = (text != "") & (F.length(text) <= 80) & ~text.rlike(r"\d")
    return F.when(heading & text.rlike(SECTION_IN), "in").when(heading & text.rlike(SECTION_OUT), "out")


def _line_numbers(ys: list[float]) -> list[int]:
    """Lines of one page's heights, sorted: a run joins the line before while it is near that line's mean height."""
    out, line, mean, n = [], -1, 0.0, 0
    for y in ys:
        if n and abs(y - mean) <= Y_TOLERANCE:
            n += 1
            mean = (mean * (n - 1) + y) / n
        else:
            line, mean, n = line + 1, y, 1
        out.append(line)
    return out


def _page_starts(batch: pa.RecordBatch, page: list[str]) -> np.ndarray:
    """Places of the first rows of the pages of a batch that is sorted by ``page``."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in page:
        a, b = batch.column(name).slice(1), batch.column(name).slice(0, batch.num_rows - 1)
        new[1:] |= pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.not_equal(a, b), pc.not_equal(pc.is_valid(a), pc.is_valid(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _with_lines(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Whole pages, sorted by y, with line.

    A gap of more than the tolerance always begins a line, and runs that lie within it of the first one are always one line; only
    pages with runs between these two (or too near to tell) are walked.
    """
    y = batch.column("y").cast(pa.float64()).to_numpy(zero_copy_only=False)
    new = np.ones(len(y), bool)
    new[1:] = y[1:] - y[:-1] > Y_TOLERANCE + Y_MARGIN
    new[starts] = True
    number = np.cumsum(new) - 1
    unsure = ~(y - y[new][number] <= Y_TOLERANCE - Y_MARGIN)
    line = (number - np.repeat(number[starts], np.diff(np.append(starts, len(y))))).astype(np.int32)
    for k in np.flatnonzero(np.logical_or.reduceat(unsure, starts)):
        at = slice(starts[k], starts[k + 1] if k + 1 < len(starts) else len(y))
        line[at] = _line_numbers(y[at].tolist())
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(line)], names=[*batch.schema.names, "line"])


def lined(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``runs`` (keys, page, x, y, w, h, text, and width of the page where there is one) with line: from the top, a run joins the line before while it is near that line's mean height.

    Pages stream through tasks as sorted batches; no more than a batch and the page that it ends in are held.
    """
    ship(runs.sparkSession)
    page = [*keys, "page"]
    names = [*page, "y", "x", "w", "h", "text", *(c for c in ("width",) if c in runs.columns)]
    kinds = dict(runs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []  # of the page that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            first = pa.concat_batches([parts[-1].slice(parts[-1].num_rows - 1), batch]) if parts else batch
            starts = _page_starts(first, page)
            if len(starts) == 1:
                parts.append(batch)
                continue
            cut = int(starts[-1]) - (first.num_rows - batch.num_rows)
            whole = pa.concat_batches([*parts, batch.slice(0, cut)])
            yield _with_lines(whole, _page_starts(whole, page))
            parts = [batch.slice(cut)]
        if parts:
            yield _with_lines(pa.concat_batches(parts), np.zeros(1, np.int64))

    rows = runs.where("x is not null and y is not null").select(*names).repartition(*page).sortWithinPartitions(*page, "y", "x")
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", line int").select(*page, "line", *names[len(page) :])


def _joined(*extra: Column) -> list[Column]:
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y", "text"))), lambda r: r["text"]), " ")
    return [F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), *extra]


def lines(placed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, line, text and height of each line of ``lined`` runs."""
    return placed.groupBy(*keys, "page", "line").agg(*_joined(F.max(F.coalesce(F.nullif("h", F.lit(0.0)), F.lit(10.0))).alias("height")))


def line_cells(placed: DataFrame, keys: list[str], boundaries: list[float], width: float) -> DataFrame:
    """keys, page, line, cell, text and start of each cell that has text.  A run belongs where its middle is between the boundaries (parts of the width)."""
    middle = F.col("x") + F.coalesce("w", F.lit(0.0)) / 2
    cell = sum(((middle >= b * width).cast("int") for b in boundaries), F.lit(0))
    return placed.withColumn("cell", cell).groupBy(*keys, "page", "line", "cell").agg(*_joined(F.min("x").alias("start")))


def year_windows(placed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, last and source (period, printed) of each file that tells its dates.

    The first line with a period of at most LONGEST_PERIOD days gives the window, padded; else the middle one of the dates
    with a year on the first page (of all pages, if it has none) is its anchor.
    """
    patterns = [r"\b[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4}\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b"]
    said = F.when(F.col("text").rlike(r"\d{4}"), F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in patterns)))
    text = placed.withColumn("said", said).groupBy(*keys, "page", "line").agg(*_joined(F.flatten(F.collect_list("said")).alias("said")))
    got = lambda p, k: F.regexp_extract("text", p, k)
    month_day = r"(?i)^([A-Z]{3,9})\.?\s*(\d{1,2})()$"
    fits = lambda p: F.when(F.datediff(p["end"], p["start"]).between(0, LONGEST_PERIOD), p)
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    both = _bound(span(dated(got(PERIOD, 1)), dated(got(PERIOD, 2))), fits)
    # Without a year of its own, the period begins in that of its end, or in the one before.
    begin = lambda p, end: _bound(_date(F.year(end), _month(p["p1"]), p["p2"]), lambda d: F.when(d > end, _date(F.year(end) - 1, _month(p["p1"]), p["p2"])).otherwise(d))
    half = _bound(_bound(got(OPEN_PERIOD, 1), lambda t: _parts(t, month_day)), lambda p: _bound(dated(got(OPEN_PERIOD, 2)), lambda end: _bound(span(begin(p, end), end), fits)))
    period = F.when(F.col("text").rlike(SPAN), F.coalesce(F.when(F.col("text").rlike(PERIOD), both), F.when(F.col("text").rlike(OPEN_PERIOD), half)))
    told = text.withColumn("period", period)
    front, first = F.when(F.col("page") == 1, F.col("said")), F.when(F.col("period").isNotNull(), F.struct("page", "line", "period"))
    files = told.groupBy(*keys).agg(F.min(first)["period"].alias("p"), F.flatten(F.collect_list(front)).alias("front"), F.flatten(F.collect_list("said")).alias("all"))

    # Printed dates are read only where there is no period.
    days = lambda c: F.array_sort(F.filter(F.transform(c, dated), lambda d: d.isNotNull()))
    some = _bound(days(F.col("front")), lambda f: F.when(F.size(f) > 0, f).otherwise(days(F.col("all"))))
    window = lambda first, last, source: F.struct(first.alias("first"), last.alias("last"), F.lit(source).alias("source"))
    around = lambda d: F.when(d.isNotNull(), window(F.date_sub(d, BEFORE_MEDIAN), F.date_add(d, AFTER_MEDIAN), "printed"))
    by_dates = _bound(_bound(some, lambda d: F.get(d, F.floor(F.size(d) / 2).cast("int"))), around)
    found = F.when(F.col("p").isNotNull(), window(F.date_sub("p.start", PAD_DAYS), F.date_add("p.end", PAD_DAYS), "period")).otherwise(by_dates)
    return files.select(*keys, F.inline(F.filter(F.array(found), lambda w: w.isNotNull())))
