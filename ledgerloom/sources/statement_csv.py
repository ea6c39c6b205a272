"""Statement files as text: CSV records, the header row, and the cells that matter, as Column functions over one file's row.

Fields may be quoted, with "" for a quote and line breaks inside; a quote within an unquoted field is a plain character, and
one that is never closed runs to the end of the file.  Records end with CR, LF or both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statement_runs import _bound

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
_FIELD = rf"(?:{_QUOTED})?+[^,\r\n]*+"
_RECORD = rf"(?!\z)({_FIELD}(?:,{_FIELD})*+)(?:\r\n|\r|\n|\z)"

# What banks call a column, the strictest first; a role takes the first column that no role before it has.
ROLES = {
    "date": [r"(?i)^post(ing|ed)?\s*date$", r"(?i)^transaction\s*date$", r"(?i)date"],
    "description": [r"(?i)description", r"(?i)^memo$", r"(?i)^name$", r"(?i)payee", r"(?i)^details?$", r"(?i)transaction"],
    "debit": [r"(?i)^debit$", r"(?i)debit", r"(?i)withdrawal", r"(?i)^amount\s*debit$", r"(?i)charges?", r"(?i)money\s*out"],
    "credit": [r"(?i)^credit$", r"(?i)credit", r"(?i)deposit", r"(?i)^amount\s*credit$", r"(?i)payments?", r"(?i)money\s*in"],
    "amount": [r"(?i)^amount$", r"(?i)^transaction\s*amount$"],
}


def records(text: Column) -> Column:
    """The raw records of a file, without a byte order mark."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", ""), F.lit(_RECORD), F.lit(1))


def cells(record: Column) -> Column:
    """The fields of a raw record."""
    plain = lambda f: F.concat(F.replace(F.regexp_extract(f, '^"([^"]*+(?:""[^"]*+)*+)', 1), F.lit('""'), F.lit('"')), F.regexp_replace(f, f"^{_QUOTED}", ""))
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_FIELD})"), F.lit(1)), lambda f: F.when(f.startswith('"'), plain(f)).otherwise(f))


def is_blank(fields: Column) -> Column:
    return F.forall(fields, lambda f: F.trim(f) == "")


def roles(fields: Column) -> Column:
    """Place of each role's column (-1: none) in a header row; null if the row is none.

    A header has a date, a description, and either an amount or both debit and credit.
    """
    place = F.sequence(F.lit(0), F.size(fields) - 1)

    def pick(patterns: list[str]) -> Callable[[Column], Column]:
        hit = lambda free, p: F.get(F.filter(free, lambda k: F.trim(fields[k]).rlike(p)), F.lit(0))
        first = lambda free: F.coalesce(*(hit(free, p) for p in patterns), F.lit(-1))
        return lambda taken: F.concat(taken, F.array(_bound(F.filter(place, lambda k: ~F.array_contains(taken, k) & (F.trim(fields[k]) != "")), first)))

    at = F.array().cast("array<int>")
    for patterns in ROLES.values():
        at = _bound(at, pick(patterns))
    found = _bound(at, lambda taken: F.struct(*(taken[k].alias(n) for k, n in enumerate(ROLES))))
    usable = lambda m: (m["date"] >= 0) & (m["description"] >= 0) & ((m["amount"] >= 0) | ((m["debit"] >= 0) & (m["credit"] >= 0)))
    # Most rows are no header: none without the word for a date somewhere.
    maybe = F.exists(fields, lambda f: f.rlike(ROLES["date"][-1]))
    return F.when(maybe, F.get(F.filter(F.array(found), usable), F.lit(0)))


def rows(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row (from 0) and cells of every record of ``files`` (keys, text) that isn't blank."""
    return files.select(*keys, F.posexplode(F.transform(records(F.col("text")), cells)).alias("row", "cells")).where(~is_blank(F.col("cells")))


def header(read: Column) -> Column:
    """row and roles of the first header among a file's records; null if there is none."""
    found = F.transform(read, lambda fields, k: F.struct(k.alias("row"), roles(fields).alias("roles")))
    return F.get(F.filter(found, lambda r: r["roles"].isNotNull()), F.lit(0))


def statement_cells(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, date_cell, description_cell, debit_cell, credit_cell and amount_cell of the rows after each file's header.

    With both a debit and a credit column amount_cell is null, else the other two are.  Files without a header give none.
    A file's records are read once, before its rows part: what filters rows stands above that, so that it isn't read again for each filter.
    """
    read = files.select(*keys, F.transform(records(F.col("text")), cells).alias("read")).select(*keys, "read", header(F.col("read")).alias("header"))
    whole = F.when(F.col("header").isNotNull(), F.col("read")).otherwise(F.array().cast("array<array<string>>"))
    both = read.select(*keys, "header.roles", F.coalesce("header.row", F.lit(-1)).alias("header"), F.posexplode(whole).alias("row", "cells")).where((F.col("row") > F.col("header")) & ~is_blank(F.col("cells")))
    cell = lambda role: F.coalesce(F.get("cells", F.col(f"roles.{role}")), F.lit(""))
    two = (F.col("roles.debit") >= 0) & (F.col("roles.credit") >= 0)
    return both.select(
        *keys, "row", cell("date").alias("date_cell"), cell("description").alias("description_cell"), F.when(two, cell("debit")).alias("debit_cell"), F.when(two, cell("credit")).alias("credit_cell"), F.when(~two, cell("amount")).alias("amount_cell")
    )


def file_kind(name: Column, mime: Column) -> Column:
    """pdf by the name's end or the declared type, else csv."""
    return F.when(F.coalesce(name.rlike(r"(?i)\.pdf$"), F.lit(False)) | F.coalesce(mime == "application/pdf", F.lit(False)), "pdf").otherwise("csv")


def batch_plan(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per batch (keys) of files (name, kind, position): ok unless both kinds are in it, its kind, and the names in the order given."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda f: f["name"])
    out = files.groupBy(*keys).agg(F.min("kind").alias("kind"), F.max("kind").alias("other"), F.array_join(names, ", ").alias("files"), F.count("*").alias("n"))
    return out.select(*keys, (F.col("kind") == F.col("other")).alias("ok"), F.when(F.col("kind") == F.col("other"), F.col("kind")).alias("kind"), "files", "n")
