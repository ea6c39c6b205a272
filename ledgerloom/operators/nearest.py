"""Bills and transactions of one household one to one, the nearest days first, on a walk along its days that never makes their pairs.

Greedy in the order of days apart, due date, the bill's id as text, date and the transaction's id as text.  Step (d, D) offers the bills due on D, in
their order, what is left d days before and then d days after.  Two steps that share a bill or a transaction must follow each other as (d, D) does; all others
may be swapped, so step (d, D) is made as soon as the walk has passed D + d * d: a walk holds what is open of ``most + most * most`` days and no more.
Where several rows have one id and so are one bill, or one transaction, days apart, steps far from each other may share it: such a household is held whole
(never its pairs) and its steps are made in their order.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

from ..functions.text import STOP_WORDS

GONE = 1 << 62
_STOP = frozenset(STOP_WORDS)


@lru_cache(1 << 16)
def _words(key: str) -> frozenset:
    """``description_tokens`` of a text whose ``merchant_key`` this is."""
    return frozenset(w for w in key.split(" ") if len(w) >= 3 and w not in _STOP)


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    both = len(_words(a) & _words(b))
    return both > 0 and both / (len(_words(a)) + len(_words(b)) - both) >= 0.4


def _limits(tolerance: float) -> Callable[[float], tuple[float, float]]:
    @lru_cache(1 << 16)
    def limits(amount: float) -> tuple[float, float]:
        """The least and the greatest number whose distance to ``amount`` is within the tolerance, to the last bit."""
        fits = lambda t: abs(t - amount) <= tolerance * amount
        ends = []
        for way in (-1, 1):
            end = amount + way * tolerance * amount
            while not fits(end):
                end = math.nextafter(end, amount)
            while fits(math.nextafter(end, way * math.inf)):
                end = math.nextafter(end, way * math.inf)
            ends.append(end)
        return ends[0], ends[1]

    return limits


class Shelf:
    """Transactions by amount, and a tree of the least rank: the first within a range of amounts takes logarithmic time."""

    __slots__ = ("amounts", "size", "tree")

    def __init__(self, rows: list[tuple[float, int]]) -> None:
        rows.sort()
        n = self.size = len(rows)
        self.amounts = [a for a, _ in rows]
        tree = self.tree = [GONE] * n + [rank * n + k for k, (_, rank) in enumerate(rows)]
        for k in range(n - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def first(self, low: float, high: float) -> int:
        """rank * size + place of the first one, or GONE."""
        tree, best = self.tree, GONE
        if tree[1] == GONE:
            return GONE
        i, j = bisect_left(self.amounts, low) + self.size, bisect_right(self.amounts, high) + self.size
        while i < j:
            if i & 1:
                if tree[i] < best:
                    best = tree[i]
                i += 1
            if j & 1:
                j -= 1
                if tree[j] < best:
                    best = tree[j]
            i >>= 1
            j >>= 1
        return best

    def drop(self, place: int) -> None:
        tree, k = self.tree, place + self.size
        tree[k] = GONE
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least


class Day:
    """A day's transactions: (id, account, amount, key); ranked by id as text when first asked for, None when taken."""

    __slots__ = ("asked", "by_account", "by_key", "left", "ranked", "rows", "shelves")

    def __init__(self) -> None:
        self.rows, self.left, self.ranked = [], 0, False
        self.by_key, self.by_account, self.shelves, self.asked = {}, None, {}, {}

    def rank(self) -> None:
        self.ranked, self.left = True, len(self.rows)
        self.rows.sort(key=lambda r: str(r[0]))
        for k, row in enumerate(self.rows):
            self.by_key.setdefault(row[3], []).append((row[2], k))

    def _of(self, account: object, key: str, alike: Callable[[str, str], bool]) -> list[Shelf]:
        """What a bill with this account (null: any) and wording may be, a shelf for each wording; made once."""
        groups = self.by_key
        if account is not None:
            if self.by_account is None:
                self.by_account = {}
                for k, row in enumerate(self.rows):
                    if row is not None and row[1] is not None:
                        self.by_account.setdefault(row[1], {}).setdefault(row[3], []).append((row[2], k))
            groups = self.by_account.get(account, {})
        out = []
        for other, rows in groups.items():
            if alike(key, other):
                place = (account, other)
                if place not in self.shelves:
                    self.shelves[place] = Shelf(rows)
                out.append(self.shelves[place])
        return out

    def first(self, bill: tuple, spent: set, alike: Callable[[str, str], bool]) -> tuple[int, Shelf, int] | None:
        """Rank, shelf and place of the first transaction left that ``bill`` may be."""
        what = bill[2], bill[6]
        shelves = self.asked.get(what)
        if shelves is None:
            shelves = self._of(*what, alike)
            if shelves or what[0] is None:
                self.asked[what] = shelves
        best = None
        for shelf in shelves:
            while (found := shelf.first(bill[3], bill[4])) != GONE:
                rank, place = divmod(found, shelf.size)
                row = self.rows[rank]
                if row is not None and row[0] not in spent:
                    if best is None or rank < best[0]:
                        best = rank, shelf, place
                    break
                shelf.drop(place)  # taken from another shelf
        return best


def nearest(most: int, tolerance: float, texts: int) -> Callable[[Iterable[tuple]], Iterator[tuple]]:
    """A function from a household's rows by day (household, day, bill's id, transaction's id, account, amount, reach (null: a transaction), key, whole) to its matches.

    whole: some of the household's rows have the same id.  most: the longest reach in days; texts: so many comparisons of two wordings are remembered at once.
    """

    def solve(rows: Iterable[tuple]) -> Iterator[tuple]:
        limits = _limits(tolerance)
        days: dict[int, Day] = {}
        bills: dict[int, list[tuple]] = {}
        steps: list[tuple[int, int, int]] = []
        past: deque[int] = deque()
        # Ids that are taken, where rows have the same.
        spent_bills, spent_rows = set(), set()
        known: dict[tuple[str, str], bool] = {}
        household, whole = None, False

        def alike(a: str, b: str) -> bool:
            said = known.get((a, b))
            if said is None:
                if len(known) > texts:
                    known.clear()
                said = known[a, b] = _alike(a, b)
            return said

        def offered(due: list[tuple], day: Day, out: list[tuple]) -> list[tuple]:
            """The bills that find nothing on this day."""
            left, k = [], 0
            while k < len(due):
                bill, same = due[k], 1
                while k + same < len(due) and due[k + same][1] == bill[1]:
                    same += 1
                k += same
                if bill[1] in spent_bills:
                    continue
                found = day.first(bill, spent_rows, alike) if same == 1 else min((f for b in due[k - same : k] if (f := day.first(b, spent_rows, alike))), key=lambda f: f[0], default=None)
                if found is None:
                    left += due[k - same : k]
                    continue
                rank, shelf, place = found
                shelf.drop(place)
                out.append((household, bill[1], day.rows[rank][0]))
                if whole:
                    spent_bills.add(bill[1])
                    spent_rows.add(day.rows[rank][0])
                day.rows[rank] = None
                day.left -= 1
                if not day.left:
                    return left + due[k:]
            return left

        def walked(until: float) -> list[tuple]:
            """Matches of the steps that can be made before this day's rows are there."""
            out: list[tuple] = []
            while steps and steps[0][0] < until:
                _, d, due_on = heapq.heappop(steps)
                due = bills.pop(due_on)
                if not d:
                    due.sort(key=lambda b: (b[0], b[1] is None))
                left = []
                for some in (list(b) for _, b in groupby(due, key=itemgetter(1))) if whole else (due,):
                    for on in (due_on - d, due_on + d) if d else (due_on,):
                        day = days.get(on)
                        if day is None or not some:
                            continue
                        if not day.ranked:
                            day.rank()
                        if day.left:
                            some = offered(some, day, out)  # noqa: PLW2901
                    left += [b for b in some if b[5] > d]
                if left:
                    bills[due_on] = left
                    heapq.heappush(steps, (d + 1 if whole else due_on + (d + 1) ** 2, d + 1, due_on))
            while past and past[0] < until - most - most * most:
                del days[past.popleft()]
            return out

        now = None
        for household, day, bill, row, account, amount, reach, key, whole in rows:  # noqa: B007
            if day != now:
                if not whole:
                    yield from walked(day)
                now = day
            if not math.isfinite(amount):
                continue
            if reach is not None:
                if day not in bills:
                    bills[day] = []
                    heapq.heappush(steps, (0 if whole else day, 0, day))
                bills[day].append((str(bill), bill, account, *limits(amount), reach, key))
            else:
                if day not in days:
                    days[day] = Day()
                    past.append(day)
                days[day].rows.append((row, account, amount, key))
        yield from walked(math.inf)

    return solve
