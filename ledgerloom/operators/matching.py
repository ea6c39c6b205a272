"""Internal transfers: one-to-one maximum matching of equal amounts out and in, within four days, of different accounts.

Rows only ever match within a household and an amount.  Sorted by date, a gap of more than four days splits such rows
into stretches that can't touch each other, so the unit of work is a stretch of one household's equal amounts.  Stretches
of one out and one in need no search and stay in the JVM; the rest go through an augmenting-path search in Python tasks, on
narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import apply_in_groups
from ..functions.text import present

WINDOW_DAYS = 4


def match(outs: list[tuple], ins: list[tuple], window: int = WINDOW_DAYS) -> list[tuple[int, int]]:
    """Index pairs of a maximum matching between (day, account, id) tuples, both sorted.

    Nearest days are tried first, and outs with the fewest candidates go first.  Augmenting paths are searched depth
    first with an explicit stack, so long chains are no trouble.
    """
    edges = []
    low = 0
    for day, account, _ in outs:
        while low < len(ins) and ins[low][0] < day - window:
            low += 1
        found = []
        for j in range(low, len(ins)):
            if ins[j][0] > day + window:
                break
            if ins[j][1] != account:
                found.append((abs(ins[j][0] - day), j))
        edges.append([j for _, j in sorted(found)])
    owner: dict[int, int] = {}
    for start in sorted(range(len(outs)), key=lambda i: (len(edges[i]), i)):
        seen: set[int] = set()
        path: list[tuple[int, int]] = []  # (out, in) steps to take over if the path ends well
        open_ = [(start, iter(edges[start]))]
        while open_:
            i, rest = open_[-1]
            j = next((j for j in rest if j not in seen), None)
            if j is None:
                open_.pop()
                if path:
                    path.pop()
                continue
            seen.add(j)
            path.append((i, j))
            if j not in owner:
                owner.update((j, i) for i, j in path)
                break
            open_.append((owner[j], iter(edges[owner[j]])))
    return sorted((i, j) for j, i in owner.items())


def _search(rows: list[tuple]) -> list[tuple]:
    """Households and ids of the matched rows of one stretch: household_id, scope, size, stretch, day, account_id, id, out."""
    sides = [sorted((day, str(account), str(id_), id_) for *_, day, account, id_, out in rows if out is side) for side in (True, False)]
    pairs = match([k[:3] for k in sides[0]], [k[:3] for k in sides[1]])
    return [(rows[0][0], sides[0][i][3]) for i, _ in pairs] + [(rows[0][0], sides[1][j][3]) for _, j in pairs]


def internal_ids(rows: DataFrame, scope: Column | None = None) -> DataFrame:
    """household_id and id of each row that is a leg of an internal transfer, among exactly ``rows`` (of one value of ``scope``, where it is given).

    rows: household_id, id (unique in its household), account_id, date, amount, excluded, user_type, account_type.  Excluded rows, loans,
    rows with a user's type, and null dates or amounts never match.
    """
    able = rows.where(
        ~F.coalesce("excluded", F.lit(False)) & ~F.col("account_type").eqNullSafe(F.lit("loan")) & present(F.col("user_type")).isNull() & (F.col("amount") != 0) & F.col("date").isNotNull()
    ).select("household_id", "id", "account_id", (F.lit(0) if scope is None else scope).alias("scope"), F.unix_date("date").alias("day"), F.abs("amount").alias("size"), (F.col("amount") > 0).alias("out"))
    order = Window.partitionBy("household_id", "scope", "size").orderBy("day", "id")
    new = F.coalesce((F.col("day") - F.lag("day").over(order) > WINDOW_DAYS).cast("int"), F.lit(0))
    able = able.withColumn("new", new)
    able = able.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy("household_id", "scope", "size", "stretch")
    able = able.withColumn("n_out", F.sum(F.col("out").cast("int")).over(whole)).withColumn("n", F.count("*").over(whole)).where("n_out > 0 and n_out < n")
    accounts = (F.min("account_id").over(whole), F.max("account_id").over(whole))
    days = F.max("day").over(whole) - F.min("day").over(whole)
    simple = able.where("n = 2").withColumn("ok", (accounts[0] != accounts[1]) & (days <= WINDOW_DAYS)).where("ok").select("household_id", "id")
    kind = dict(rows.dtypes)
    narrow = able.where("n > 2").select("household_id", "scope", "size", "stretch", "day", "account_id", "id", "out")
    hard = apply_in_groups(narrow, ["household_id", "scope", "size", "stretch"], _search, f"household_id {kind['household_id']}, id {kind['id']}")
    return simple.unionByName(hard)


def mark_internal(rows: DataFrame, scope: Column | None = None) -> DataFrame:
    """``rows`` with internal, true for legs of internal transfers among exactly these rows (of one value of ``scope``)."""
    legs = internal_ids(rows, scope).withColumn("internal", F.lit(True))
    return rows.join(legs, ["household_id", "id"], "left").withColumn("internal", F.coalesce("internal", F.lit(False)))
