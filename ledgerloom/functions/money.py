"""Money helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A double, 0 where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def cents(c: Column) -> Column:
    """Rounded to cents, halves up; never a negative zero."""
    return F.floor(c.cast("double") * 100 + 0.5) / F.lit(100.0)


def amount(c: Column) -> Column:
    """An exact decimal sum as a double for output."""
    return c.cast("double")


def _rewritten(c: Column, *steps: tuple[str, str]) -> Column:
    """One replacement after the other, so that the cell stands in the expression once, however often the result is used."""
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def parse_money(c: Column) -> Column:
    """A statement's cell: $ , spaces, parentheses and signs; blank is 0 and anything else null."""
    plain = _rewritten(
        F.trim(F.coalesce(c, F.lit(""))), ("^$", "0"), (r"^\((.*)\)$", "\u0001$1"), (r"[$\s,]", ""),
        ("^(?:\u0001-\\+?|\\+)(?=[0-9.])", ""), ("^(?:\u0001\\+?|-\\+?)(?=[0-9.])", "-"),  # parentheses around a minus turn it
    )
    return F.regexp_extract(plain, r"^-?[0-9]*\.?[0-9]+$", 0).try_cast("decimal(18,4)")


def parse_date(c: Column) -> Column:
    """ISO, or month/day/year with / . or - and two or four digits of the year (70 and above: 1900s)."""
    rest = r"^([0-9]{2})[/.\-]([0-9]{2})[/.\-]"
    iso = _rewritten(
        F.trim(F.coalesce(c, F.lit(""))), (r"^([0-9])([/.\-])", "0$1$2"), (r"^([0-9]{2}[/.\-])([0-9])([/.\-])", "$10$2$3"),
        (rest + "([7-9][0-9])$", "19$3-$1-$2"), (rest + "([0-6][0-9])$", "20$3-$1-$2"), (rest + "([0-9]{4})$", "$3-$1-$2"),
    )
    return F.try_to_date(F.regexp_extract(iso, "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", 0), "yyyy-MM-dd")
