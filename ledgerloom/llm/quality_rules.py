"""Quality rules: exact counts per text, and a hashed n-gram logistic regression behind fixed thresholds.

Words are runs of characters other than ASCII white space.  The model hashes word 1- and 2-grams and character 3- and
5-grams (over code points) of a whole text into ``DIM`` buckets each; a text's features are the square roots of its
bucket frequencies (a unit vector per family), so its length does not count.  It is fitted on a bounded sample of
labelled rows and calibrated by Platt scaling on a part of them that the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ship, table
from .labelled import held_out, training_rows
from .linear import fit, platt, sigmoid
from .words import as_bytes, covered, hashes, spans, windows

#: Buckets for each family of n-grams.
DIM = 1_024
FAMILIES = 4
#: Labelled rows to fit on, at most; with DIM they bound what reaches the driver.
TRAIN_ROWS = 2_000
#: Fixed thresholds of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 10, 20, 0.3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_FIRST = np.ones(256, bool)  # first bytes of code points
_FIRST[0x80:0xC0] = False
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SHIFT = np.uint64(64 - DIM.bit_length() + 1)


def code_points(buf: np.ndarray) -> np.ndarray:
    """Code points of UTF-8."""
    if _FIRST[buf].all():
        return buf.astype(np.uint32)
    return np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def _char_grams(points: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the n-grams of code points."""
    size = len(points) - n + 1
    if size <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(size, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= points[k : k + size]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - DIM.bit_length() + 1)).astype(np.int64)


def families(buf: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Buckets of each family's n-grams, given a text's bytes and its words' hashes."""
    grams = [(h * _C[0]) >> _SHIFT, (windows(h, 2) * _C[1]) >> _SHIFT]
    points = code_points(buf)
    return [g.astype(np.int64) for g in grams] + [_char_grams(points, 3), _char_grams(points, 5)]


def features(buf: np.ndarray, h: np.ndarray) -> np.ndarray:
    """FAMILIES * DIM values; zeros for a family without n-grams."""
    out = np.zeros((FAMILIES, DIM))
    for k, g in enumerate(families(buf, h)):
        if len(g):
            out[k] = np.sqrt(np.bincount(g, minlength=DIM) / len(g))
    return out.ravel()


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    seen: set[bytes] = set()
    found = 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if line in seen:
            found += 1
        elif line.split(None, 1):
            seen.add(line)
    return found


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bytes, word hashes, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    buf = as_bytes(text)
    start, end = spans(buf)
    h = hashes(buf, start, end)
    points = np.concatenate(([0], np.cumsum(_FIRST[buf])))
    grams = windows(h, 5)
    repeated = 0
    if len(grams):
        _, where, times = np.unique(grams, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[where] > 1)
        repeated = int(covered(at, 5, len(h)).sum()) if len(at) else 0
    return buf, h, [len(h), int((points[end] - points[start]).sum()), int(_SYMBOL[buf].sum()), dup_lines(text), repeated]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most ``rows`` labelled rows that aren't held out.  Without both labels among them every text gets probability 1."""
    ship(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column("text").to_pylist():
                buf, h, _ = counts(text)
                made.append(features(buf, h).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(made, pa.binary())], names=["doc_id", "label", "x"])

    sample = training_rows(docs, labels, label, rows)
    got = sample.mapInArrow(extract, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, x binary").orderBy("doc_id", F.xxhash64("x")).toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, FAMILIES * DIM)
    y = got.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return {"w": np.zeros(FAMILIES * DIM), "b": 0.0, "slope": 0.0, "shift": 40.0}
    third = np.arange(len(y)) % 3 == 0
    w, b = fit(x[~third], y[~third], l2=1e-4, steps=150)
    slope, shift = platt(x[third] @ w + b, y[third])
    return {"w": w, "b": b, "slope": slope, "shift": shift}


def score(buf: np.ndarray, h: np.ndarray, model: dict) -> float:
    return float(sigmoid(model["slope"] * (features(buf, h) @ model["w"] + model["b"]) + model["shift"]))


def apply_rules(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept for every row.

    A null text counts as empty: no words, so base_failed.  Repeated rows are each judged alone, an empty table gives no
    rows, and columns other than doc_id and text are ignored.
    """
    ship(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                buf, h, c = counts(text)
                failed = c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0]
                p = score(buf, h, model)
                rows.append((*c, failed, p, not failed and p >= MIN_PROBABILITY))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *NAMES])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]


# ---- query ------------------------------------------------------------------------------------------------------


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return apply_rules(docs, train(docs, labels)).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
