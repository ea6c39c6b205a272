"""Spelling variants: words one edit apart, by permuterm rotations, and the common form that each rare one stands for.

A word with a terminator has as many rotations as places.  Of words that differ in one replaced character, the rotations that end in it share
all that goes before it; of a word and one that has a character more, the whole rotation of the shorter is what goes before
the character at the end of the longer's.  So all rotations are dealt and sorted by the prefix that skips the last
character, next to whole rotations, and words in one group are neighbours.  A character deleted from a run of equal ones gives one word
only: the run's last place stands for it, so that each pair of neighbours meets in one group.

A group has at most one word for each character and the shorter word.  It is scanned for the number and the most
frequent of each member's neighbours; no pairs are emitted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grouped import apply_in_groups
from .cluster import ship, stored, table

#: Letters of a word.
WORD = re.compile("[A-Za-zÀ-ÿ]+")
END = "$"
#: A word takes part from so many code points and occurrences on; a form is at least so many times as frequent.
MIN_LENGTH, MIN_COUNT, TIMES = 6, 5, 5
#: Different words that a task holds before it passes their counts on.
HELD = 1 << 17

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> Counter:
    """How often each word occurs, A-Z lower-cased."""
    out: Counter = Counter()
    for run, n in Counter(WORD.findall(text or "")).items():
        out[run.translate(_LOWER)] += n
    return out


def misspelt(doc_id: object, word: str) -> str:
    """``word`` as it counts in that document: one of 199, by checksum, lacks a letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]


def vocabulary(docs: DataFrame, change: object = None) -> DataFrame:
    """word and n over all texts.  ``change(doc_id, word)`` is the word that a document's word counts as.

    Texts are counted one by one and added up in each task and then over all.  A null or empty text has no words.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in words_of(text).items():
                    held[change(doc_id, word) if change else word] += n
                if len(held) >= HELD:
                    yield told()
        yield told()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """prefix, word, n and place: whole (0), or what the prefix skips: a character (2), one that an equal one follows (1)."""
    at = lambda i, k=1: F.substring("word", i, k)
    n = F.length("word")
    skipped = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.substring("word", i + 1, n), F.lit(END), F.substring("word", F.lit(1), i - 1)).alias("prefix"), F.when(at(i) == at(i + 1), 1).otherwise(2).alias("place")))
    whole = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.concat(F.substring("word", i + 1, n), F.lit(END), F.substring("word", F.lit(1), i)).alias("prefix"), F.lit(0).alias("place")))
    return words.select("word", "n", F.explode(F.concat(skipped, whole)).alias("r")).select("r.prefix", "word", "n", "r.place")


def _scan(rows: list[tuple]) -> list[tuple]:
    """One group's members with neighbours: word, how many, and the most frequent of them (ties: the least)."""
    if len(rows) < 2:
        return []
    ranked = sorted(((-n, word, place) for _, word, n, place in rows))
    skips = [r for r in ranked if r[2]]
    deleted, whole = [r for r in skips if r[2] == 2], next((r for r in ranked if not r[2]), None)
    out = []
    for r in skips:
        best = skips[0] if skips[0] is not r else skips[1] if len(skips) > 1 else None
        more = whole if r[2] == 2 else None
        near = min((x for x in (best, more) if x is not None), default=None)
        if near is not None:
            out.append((r[1], len(skips) - 1 + (more is not None), -near[0], near[1]))
    if whole is not None and deleted:
        out.append((whole[1], len(deleted), -deleted[0][0], deleted[0][1]))
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near and the most frequent near word with its count, of words (word, n) that have one.

    Two words are near if one inserted, deleted or replaced code point makes them equal.  Rows with the same word are to be
    added up before; a null or empty word has no neighbours.
    """
    groups = apply_in_groups(rotations(words.where("length(word) > 0")), ["prefix"], _scan, "word string, k long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("near")))
    return groups.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.neg")).alias("near_n"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of words (word, n).

    form: the most frequent near word if it occurs ``times`` as often, else null; root: the last of the forms of forms, or the
    word itself.  Counts grow ``times``-fold at each step, so roots are found by a few rounds of doubling.
    """
    words = stored(words, "words")
    near = neighbours(words)
    joined = stored(words.join(near, "word", "left").withColumn("form", F.when(F.col("near_n") >= times * F.col("n"), F.col("near"))), "variants")
    links = joined.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = joined.agg(F.max("n")).first()[0] or 0
    steps = 1
    while times**steps <= most:
        steps *= 2
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return joined.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n")
    )


# ---- query ------------------------------------------------------------------------------------------------------


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = vocabulary(table(spark, sf_dir, "documents"), misspelt)
    return variants(counted.where((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT)))
