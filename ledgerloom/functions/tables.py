"""Small fixed tables as array literals, to be exploded next to a row instead of joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_rows(rows: list[tuple], names: list[str], types: list[str]) -> Column:
    """An array of structs."""
    return F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, types, strict=True))) for row in rows))
