"""Conversation structure repair: the cheapest edits that make a conversation ``(s?(ua)+)?``, by survivor-coalescence Viterbi.

A conversation's rows are read in order (turn, nulls first; then role and text) and pass a four-state automaton: nothing kept
yet, system kept, user last, assistant last.  Each state has one survivor, a leaf of a backpointer tree whose nodes count
their references (children, and the survivor that ends there).  A survivor that is replaced, or that no continuation can
make the best any more, releases its chain; as soon as all survivors descend from one child of the root, that child's edit
is emitted and it becomes the root.  Held at a time are only the edits on which survivors differ.

Ties are decided by the whole unresolved suffixes, ASCII-least.  After a row no survivor's suffix is a prefix of another's
(all have one edit for each row, the last of them for this row, and an insertion costs), so their order is kept as a rank and
carried on: comparing two ranks is comparing the two suffixes, however long they are.

Rows are dealt by conversation once and sorted in the task by Spark's spilling sort; a conversation is streamed, never
collected.  Its digest is a SHA-256 over its text from first to last row, so that one task reads its rows in any plan.
Repeats are found by a window within the same partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .cluster import ship, table

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
_SPACES = " \t\n\x0b\x0c\r"
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row with that initial leads.
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Where the next user or assistant row leads, be it inserted or one of another role.
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: (p, q): the best that can follow p costs at most so much more than the best that can follow q.  From "assistant last" all that follows
#: "system kept" is possible, and what follows the start too if its system row is deleted; an insertion leads from user to assistant and back.
_WITHIN = {(START, SYSTEM): 0, (START, ASSISTANT): 0, (START, USER): INSERT, (ASSISTANT, SYSTEM): 0, (ASSISTANT, START): DELETE, (ASSISTANT, USER): INSERT, (USER, ASSISTANT): INSERT, (USER, SYSTEM): INSERT, (USER, START): INSERT + DELETE}


class _Edit:
    """A node of the backpointer tree."""

    __slots__ = ("children", "edit", "parent", "role", "row", "survives")

    def __init__(self, parent: _Edit | None, edit: str, row: tuple | None, role: str | None) -> None:
        self.parent, self.edit, self.row, self.role = parent, edit, row, role
        self.children: dict[int, _Edit] = {}
        self.survives = False
        if parent is not None:
            parent.children[id(self)] = self

    def release(self) -> None:
        """Drop what nothing refers to any more, upwards."""
        node = self
        while node.parent is not None and not node.children and not node.survives:
            up = node.parent
            del up.children[id(node)]
            node.parent = None
            node = up


class Survivors:
    """One conversation: ``row`` and at last ``end`` return the edits that have become certain, as (edit, row, new role)."""

    def __init__(self) -> None:
        self.root = _Edit(None, "", None, None)
        self.root.survives = True
        self.best: dict[int, tuple[int, int, _Edit]] = {START: (0, 0, self.root)}  # state: cost, rank, leaf

    @property
    def held(self) -> int:
        """Edits that are not certain yet."""
        stack, n = list(self.root.children.values()), 0
        while stack:
            n += 1
            stack.extend(stack.pop().children.values())
        return n

    def _inserted(self) -> dict[int, list]:
        """The survivors, and what up to two insertions make of them: state, then cost, rank, edits since the last row, leaf, roles inserted."""
        ways = {state: (cost, rank, "", leaf, ()) for state, (cost, rank, leaf) in self.best.items()}
        for _ in range(2):
            for state, (cost, rank, edits, leaf, roles) in list(ways.items()):
                to = _NEXT[state]
                way = (cost + INSERT, rank, edits + "I", leaf, (*roles, to))
                if to not in ways or way[:3] < ways[to][:3]:
                    ways[to] = way
        return ways

    def row(self, row: tuple, initial: str, fault: str | None) -> list[tuple]:
        found: dict[int, tuple] = {}

        def offer(to: int, way: tuple, edit: str, cost: int, role: str | None) -> None:
            now = (way[0] + cost, way[1], way[2] + edit, way, role)
            if to not in found or now[:3] < found[to][:3]:
                found[to] = now

        stays = CUT if fault == TRUNCATED else 0
        for state, way in self._inserted().items():
            offer(state, way, "D", DELETE, None)
            if fault in (BLANK, DUPLICATE):
                continue
            if (kept := _KEEP.get((state, initial))) is not None:
                offer(kept, way, "K", stays, None)
            offer(_NEXT[state], way, "R", stays + REROLE, _ROLE[_NEXT[state]])
        lives = {s: w for s, w in found.items() if not any((t, s) in _WITHIN and w[0] > v[0] + _WITHIN[t, s] for t, v in found.items())}
        order = {s: k for k, s in enumerate(sorted(lives, key=lambda s: lives[s][1:3]))}
        self._moved({s: (cost, order[s], self._grown(way, edits[-1], row, role)) for s, (cost, _, edits, way, role) in lives.items()})
        return self._certain()

    @staticmethod
    def _grown(way: tuple, edit: str | None, row: tuple | None, role: str | None) -> _Edit:
        leaf = way[3]
        for to in way[4]:
            leaf = _Edit(leaf, "I", None, _ROLE[to])
        return leaf if edit is None else _Edit(leaf, edit, row, role)

    def _moved(self, now: dict[int, tuple[int, int, _Edit]]) -> None:
        before, self.best = self.best, now
        for _, _, leaf in before.values():
            leaf.survives = False
        for _, _, leaf in now.values():
            leaf.survives = True
        for _, _, leaf in before.values():
            leaf.release()

    def _certain(self) -> list[tuple]:
        out = []
        while len(self.root.children) == 1 and not self.root.survives:
            (self.root,) = self.root.children.values()
            self.root.parent = None
            out.append((self.root.edit, self.root.row, self.root.role))
            self.root.row = None
        return out

    def end(self) -> list[tuple]:
        ways = self._inserted()
        way = min((ways[s] for s in (START, ASSISTANT) if s in ways), key=lambda w: w[:3])
        self._moved({START: (way[0], 0, self._grown(way, None, None, None))})
        return self._certain()


# ---- rows -------------------------------------------------------------------------------------------------------


def _last(text: Column) -> Column:
    """The last character that is no white space."""
    return F.right(F.rtrim(text, F.lit(_SPACES)), F.lit(1))


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and fault (blank, duplicate, truncated or null: the first that holds), dealt by conversation.

    A null role or text is one space.  Of rows with the same conversation, role and text the first by turn is no duplicate.
    """
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    last = _last(F.col("text"))
    fault = F.when(last == "", BLANK).when(F.col("_again"), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED)
    return own.withColumn("_again", again).select("conv_id", "turn", "role", "text", fault.alias("fault"))


EDITS = "step long, edit string, cost int, fault string, turn {turn}, was string, role string, text string"


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation: conv_id, step, edit (Keep, Rerole, Delete, Insert by initial), cost, fault, turn, was, role, text.

    was: the row's own role, null for an inserted one.  role, text: the row as it stays, null if it is deleted.  Rows come in the order of their
    conversation, which lies in one partition.  Null ids are one conversation; turns that are null come first, and rows with
    the same turn by role and text.  Empty texts are blank; an empty table gives no rows; other columns are ignored.
    """
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    schema = StructType.fromDDL(f"conv_id {kinds['conv_id']}, " + EDITS.format(turn=kinds["turn"]))
    arrow = to_arrow_schema(schema)

    def told(key: object, step: int, edit: str, row: tuple | None, role: str | None) -> tuple:
        if edit == "I":
            return (key, step, edit, INSERT, None, None, None, role, "")
        turn, was, text, fault = row
        cost = DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (CUT if fault == TRUNCATED else 0)
        return (key, step, edit, cost, fault, turn, was, *((None, None) if edit == "D" else (role or was, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, step = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != key:
                    for e in now.end() if now else ():
                        out.append(told(key, step, *e))
                        step += 1
                    now, key, step = Survivors(), conv, 0
                for e in now.row(tuple(row), row[1][:1], row[3]):
                    out.append(told(key, step, *e))
                    step += 1
            yield _batch(out, arrow)
        if now is not None:
            yield _batch([told(key, step + k, *e) for k, e in enumerate(now.end())], arrow)

    later = F.coalesce(F.col("fault") == DUPLICATE, F.lit(False))
    return marked(rows).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", later).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def summary(edits: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair``'s edits, read on in the same tasks: its faults, cost, audit and the digest of what stays."""
    schema = StructType.fromDDL(f"conv_id {dict(edits.dtypes)['conv_id']}, " + SUMMARY)
    arrow = to_arrow_schema(schema)
    count = {BLANK: 1, DUPLICATE: 2, TRUNCATED: 3}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            out = []
            for conv, edit, cost, fault, turn, was, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "edit", "cost", "fault", "turn", "was", "role", "text")), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        out.append(closed(key, now))
                    key, now = conv, {"counts": [0] * 6, "turns": None, "was": None, "audit": [], "sha": hashlib.sha256(), "first": True}
                counts = now["counts"]
                counts[5] += cost
                now["audit"].append(edit)
                if edit != "I":
                    if fault:
                        counts[count[fault]] += 1
                    if now["was"] is not None:
                        counts[4] += now["was"] + was[:1] not in ("su", "ua", "au")
                    now["was"] = was[:1]
                    if turn is not None:  # turns come sorted
                        low, high, distinct = now["turns"] or (turn, None, 0)
                        now["turns"] = (low, turn, distinct + (turn != high))
                if edit != "D":
                    now["sha"].update(("" if now["first"] else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    now["first"] = False
            yield _batch(out, arrow)
        if now is not None:
            yield _batch([closed(key, now)], arrow)

    def closed(key: object, now: dict) -> tuple:
        low, high, distinct = now["turns"] or (1, 0, 0)
        now["counts"][0] = high - low + 1 - distinct
        return (key, *now["counts"], "".join(now["audit"]), now["sha"].hexdigest())

    return edits.mapInArrow(run, schema)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# ---- query ------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by a checksum of conversation and turn (nulls of any column count as one space)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("hit")
    hurt = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hit).where("hit <> 0")
        .select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"))
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    told = summary(repair(damaged(rows)))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    zero = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    names = [c.split(" ")[0] for c in SUMMARY.split(", ")]
    return ids.join(told, ids["id"].eqNullSafe(told["conv_id"]), "left").select(F.col("id").alias("conv_id"), *(F.coalesce(n, F.lit(zero.get(n, 0))).alias(n) for n in names))
