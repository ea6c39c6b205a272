"""Grouped Python over many small groups, without a pandas frame for each.

Rows are dealt by the keys and sorted by them, and each task streams its groups: only one group is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shipping import ship


#: Rows of one batch that a streamed group gives back.
OUT_ROWS = 10_000


def _packing(schema: str) -> tuple[StructType, Callable[[list[tuple]], pa.RecordBatch]]:
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return kind, packed


def stream_in_groups(rows: DataFrame, keys: list[str], order: list[str], solve: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str, spread: bool = True) -> DataFrame:
    """``solve`` on an iterator of each group's rows in ``order``: what it doesn't keep of a group isn't held.  spread: to all shuffle partitions, however few bytes they are."""
    at = [rows.columns.index(k) for k in keys]
    ship(rows.sparkSession)
    kind, packed = _packing(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for _, group in groupby(every, key=itemgetter(*at)):
            for found in solve(group):
                out.append(found)
                if len(out) >= OUT_ROWS:
                    yield packed(out)
                    out = []
        yield packed(out)

    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if spread else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, kind)


def apply_in_groups(rows: DataFrame, keys: list[str], solve: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``solve`` on each group's rows (tuples in the order of the columns); what it returns are rows of ``schema``."""
    at = [rows.columns.index(k) for k in keys]
    ship(rows.sparkSession)
    kind, packed = _packing(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = tuple(row[k] for k in at)
                if held and now != key:
                    out += solve(held)
                    held = []
                key = now
                held.append(row)
            yield packed(out)
        if held:
            yield packed(solve(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, kind)
