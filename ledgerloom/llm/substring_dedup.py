"""Substring dedup: suffix automata of reference shards, matching statistics, removal of maximal repeated spans.

A word is removed if some window of WINDOW consecutive words that covers it also starts anywhere else in the corpus.

The reference is the corpus itself, so an automaton of it can't be broadcast (it has no size bound) and streaming every
document past every shard would be quadratic.  The shards are therefore keyed by content: each window belongs to its
minimizer, the 8-gram with the least hash in it, and equal windows have equal minimizers.

1. Each document is cut into segments, the runs of windows with one minimizer occurrence (at most 28 windows of 62 words).
   A segment is one row of its document, with all its places there.  Minimizers that occur once are done; no window of
   theirs can be repeated.
2. Equal segments are one, with the number of their occurrences, and their words are fetched from one document each.
3. A minimizer's distinct segments are a reference shard: a suffix automaton over their words with occurrence counts, past
   which the same segments are streamed.  A position's state, cut back to WINDOW words, tells how often the window that
   ends there occurs, by its words.
4. A shard with over SHARD_SEGMENTS segments is dealt again: its segments are cut into runs of windows with the same FINER
   least 8-grams, equal runs are one, and each such key has an automaton of its own; those that are still too large are
   dealt once more by all grams of a window.
5. The spans come back to their documents by the segment's key and are cut out of the texts.

Segments are told apart by pairs of 64-bit hashes (minimizer, and the segment's words), all else by words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ship, stored, table
from .words import as_bytes, covered, hashes, mix, powers, spans, windows

WINDOW = 35
GRAM = 8
#: 8-grams in a window.
INSIDE = WINDOW - GRAM + 1
#: Least 8-grams by which a large shard is dealt again.
FINER = 8
#: Distinct segments in one automaton, at most: some 50,000 words, which take up to about 30 MB of a worker.
SHARD_SEGMENTS = 1_024


def segments(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """minimizer, segment key, first window and number of windows for each segment of a document's word hashes."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    gram = windows(h, GRAM)
    best = np.arange(n) + np.lib.stride_tricks.sliding_window_view(gram, INSIDE).argmin(1)
    own, first, count = _runs(h, best)
    # With the minimizer's place in it.
    return gram[best[first]], mix(own + (best[first] - first).astype(np.uint64)), first, count


def _runs(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of the words and their number, first window and number of windows for each run of windows with equal keys."""
    first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    count = np.diff(np.concatenate((first, [len(key)])))
    total = np.zeros(len(h) + 1, np.uint64)
    up, down = powers(len(h) + 1)
    with np.errstate(over="ignore"):
        np.cumsum(h * up[: len(h)], out=total[1:])
        own = (total[first + count + WINDOW - 1] - total[first]) * down[first]
        return mix(own + count.astype(np.uint64)), first, count


def runs_of_least(h: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """As ``segments`` for the runs of windows with the same ``level`` least 8-grams."""
    gram = np.sort(np.lib.stride_tricks.sliding_window_view(windows(h, GRAM), INSIDE), axis=1)
    key = np.zeros(len(gram), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(level):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + gram[:, k])
    own, first, count = _runs(h, key)
    return key[first], own, first, count


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document's different segments, with their places."""
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            buf = as_bytes(text)
            found.append(segments(hashes(buf, *spans(buf))))
        times = np.array([len(f[0]) for f in found], np.int64)
        row = np.repeat(np.arange(len(found)), times)
        a, s, i, c = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(4))
        order = np.lexsort((i, s, a, row))
        row, a, s, i, c = row[order], a[order], s[order], i[order], c[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        at = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(i.astype(np.int32)))
        of = pa.array(row[first])
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[first].view(np.int64)), pa.array(s[first].view(np.int64)), batch.column("doc_id").take(of), batch.column("version").take(of), at, pa.array(c[first].astype(np.int8))],
            names=["anchor", "seg", "doc_id", "version", "at", "n"],
        )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted segments, out of their documents."""
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            out += [(w["anchor"], w["seg"], w["times"], w["n"], b" ".join(words[w["at"] : w["at"] + w["n"] + WINDOW - 1])) for w in wanted]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary()), strict=True)], names=["anchor", "seg", "times", "n", "words"])


class SuffixAutomaton:
    """Of several word sequences; counts occurrences (with a weight per sequence) of every substring."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list, weight: int) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            if w in nexts[last]:
                q = nexts[last][w]
                if length[q] == length[last] + 1:
                    cur = q
                else:
                    cur = self._clone(last, w, q)
                count[cur] += weight
                last = cur
                continue
            cur = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            count.append(weight)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w: object, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        new = len(nexts)
        nexts.append(nexts[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        self.count.append(0)
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = new
            p = link[p]
        link[q] = new
        return new

    def finish(self) -> None:
        """Carry the counts from longer substrings to their suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list, window: int) -> list[int]:
        """Starts of the windows of ``words`` that occur twice or more, by matching statistics."""
        out, state, matched = [], 0, 0
        for end, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.count[state] > 1:
                out.append(end - window + 1)
        return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimizer: for each distinct segment a bit per window, set if the window is repeated."""

    def shard(rows: list[tuple]) -> list[tuple]:
        automaton = SuffixAutomaton()
        split = [(r[1], r[2], r[4].split(b" ")) for r in rows]
        for _, times, words in split:
            automaton.add(words, times)
        automaton.finish()
        return [(rows[0][0], seg, sum(1 << k for k in automaton.repeated(words, WINDOW))) for seg, _, words in split]

    held: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if held and row[0] != held[0][0]:
                out += shard(held)
                held = []
            held.append(row)
        yield _masks(out)
    if held:
        yield _masks(shard(held))


def _masks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "seg", "mask"])


def _finer(level: int):
    """Cuts segments into runs of windows with the same ``level`` least 8-grams: their keys, and where they are in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, seg, times, words in zip(*(batch.column(k).to_pylist() for k in ("anchor", "seg", "times", "words")), strict=True):
                buf, split = np.frombuffer(words, np.uint8), words.split(b" ")
                keys, own, first, count = runs_of_least(hashes(buf, *spans(buf)), level)
                for key, part, at, n in zip(keys.view(np.int64).tolist(), own.view(np.int64).tolist(), first.tolist(), count.tolist(), strict=True):
                    out.append((anchor, seg, times, at, key, part, n, b" ".join(split[at : at + n + WINDOW - 1])))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int8(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "seg", "times", "at", "key", "part", "n", "words"])

    return run


def _by_automata(shards: DataFrame, level: int = 1) -> DataFrame:
    """anchor, seg and mask of the repeated windows of each row of ``shards`` (anchor, seg, times, n, words; distinct, stored)."""

    def matched(rows: DataFrame) -> DataFrame:
        return rows.select("anchor", "seg", "times", "n", "words").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_match, "anchor long, seg long, mask long").where("mask != 0")

    # With all of a window's grams a shard is as small as can be.
    if level == INSIDE:
        return matched(shards)
    large = stored(shards.groupBy("anchor").agg(F.count("*").alias("size")).where(F.col("size") > SHARD_SEGMENTS).select("anchor"), "large")
    if large.isEmpty():
        return matched(shards)
    finer = FINER if level < FINER else INSIDE
    schema = "anchor long, seg long, times long, at int, key long, part long, n byte, words binary"
    parts = stored(shards.join(large, "anchor", "left_semi").select("anchor", "seg", "times", "words").mapInArrow(_finer(finer), schema), "parts")
    below = parts.groupBy("key", "part").agg(F.sum("times").alias("times"), F.first("n").alias("n"), F.first("words").alias("words"))
    masks = stored(_by_automata(stored(below.withColumnsRenamed({"key": "anchor", "part": "seg"}), "below"), finer), "masks")
    found = parts.select("anchor", "seg", "at", "key", "part").join(masks.withColumnsRenamed({"anchor": "key", "seg": "part"}), ["key", "part"])
    back = found.groupBy("anchor", "seg").agg(F.expr("bit_or(shiftleft(mask, at))").alias("mask"))
    return matched(shards.join(large, "anchor", "left_anti")).unionByName(back)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, version and, as ``spans``, the first windows of its places and a mask of windows for each segment that has repeated windows."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text").withColumn("version", F.xxhash64("text"))
    cut = stored(docs.mapInArrow(_cut, f"anchor long, seg long, doc_id {kind}, version long, at array<int>, n byte"), "segments")
    again = stored(cut.groupBy("anchor").agg(F.sum(F.size("at")).alias("c")).where("c > 1").select("anchor"), "again")
    # Both stored, so that the join has exchanges of its own and a very common minimizer's rows can be split.
    held = stored(cut.join(again.hint("merge"), "anchor"), "repeated")

    distinct = stored(held.groupBy("anchor", "seg").agg(F.sum(F.size("at")).alias("times"), F.min(F.struct("doc_id", "version", F.col("at")[0].alias("at"))).alias("where"), F.first("n").alias("n")), "distinct")
    wanted = F.collect_list(F.struct("anchor", "seg", "times", "n", F.col("where.at").alias("at"))).alias("wanted")
    per_doc = distinct.groupBy(F.col("where.doc_id").alias("_id"), F.col("where.version").alias("_version")).agg(wanted)
    one = docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["_id"]) & (docs["version"] == per_doc["_version"])).dropDuplicates(["doc_id", "version"])
    shards = stored(one.select("text", "wanted").mapInArrow(_fetch, "anchor long, seg long, times long, n byte, words binary"), "shards")
    masks = stored(_by_automata(shards), "masks")
    marked = held.select("anchor", "seg", "doc_id", "version", "at").join(masks, ["anchor", "seg"])
    return stored(marked.groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "mask")).alias("spans")), "spans")


def _kept(text: str | None, found: list[dict] | None) -> tuple[list[bytes], np.ndarray]:
    """Words, and which of them stay."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not found:
        return words, np.ones(len(words), bool)
    starts = [np.asarray(f["at"], np.int64) + k for f in found for k in range(f["mask"].bit_length()) if f["mask"] >> k & 1]
    return words, ~covered(np.unique(np.concatenate(starts)), WINDOW, len(words))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words, stay = _kept(text, found)
            left = words if stay.all() else [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            rows.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, changed = [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words, stay = _kept(text, found)
            changed.append(not stay.all())
            out.append(b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s).decode("utf-8", "surrogatepass") if changed[-1] else text)
        at = batch.schema.get_field_index("text")
        names = [n for n in batch.schema.names if n not in ("text", "spans", "version")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, batch.schema.field(at).type)], names=[*names, "text"])


def _with_spans(docs: DataFrame) -> DataFrame:
    found = repeated_spans(docs)
    rows = docs.withColumn("version", F.xxhash64("text"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "spans")
    return rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["version"] == found["_version"]), "left").drop("_id", "_version")


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by a space) for each row of ``docs`` (doc_id, text).

    A null text has no words.  A repeated row repeats all of its windows.  Texts of fewer than WINDOW words keep all of
    them.  An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = _with_spans(docs.select("doc_id", "text"))
    return rows.select("doc_id", "text", "spans").mapInArrow(_digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated spans cut out of their texts: a text that loses words keeps the rest joined by single spaces, others stay as they are."""
    rows = _with_spans(docs.drop("spans", "version", "_id", "_version"))
    kept = [f for f in rows.schema.fields if f.name not in ("text", "spans", "version")]
    from pyspark.sql.types import StringType, StructField, StructType

    out = rows.mapInArrow(_rewrite, StructType([*kept, StructField("text", StringType())]))
    return out.select(*docs.columns)


# ---- query ------------------------------------------------------------------------------------------------------


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(table(spark, sf_dir, "documents"))


SQL = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM a WHERE len(w) >= 35)),
g AS (SELECT doc_id, i FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM g),
c AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM a) ANTI JOIN p USING (doc_id, k) GROUP BY doc_id)
SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM a LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
