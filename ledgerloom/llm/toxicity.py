"""Toxicity by a counterfactual-regularised classifier.

Features: the distinct words (runs of letters, lower-cased) of a whole text and their first 4 to 8 bytes, hashed; a
feature's value is the square root of its share of the text's words, scaled by the log of its rarity among the training
rows.  The logistic loss is joined by a penalty: identity terms of a labelled text are swapped for each of the others of
their sets in turn, and the mean squared difference between the scores, times PENALTY, is added.  Weights of identity
terms are thereby drawn towards each other, so a neutral mention of one group scores as one of any other.  Scores are
calibrated on rows that the weights have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ship, table
from .labelled import held_out, training_rows
from .linear import platt, sigmoid
from .words import as_bytes, hashes

DIM = 1 << 16
#: Labelled rows to fit on, at most, and the longest text among them (in code points): they bound what reaches the driver.
TRAIN_ROWS, TRAIN_CHARS = 4_000, 200_000
PENALTY = 1.0
PREFIXES = (4, 5, 6, 7, 8)

#: Sets of identity terms that may take each other's place.
IDENTITY = [
    ["men", "women"], ["man", "woman"], ["male", "female"], ["boys", "girls"], ["gay", "straight", "lesbian", "bisexual"], ["transgender", "cisgender"],
    ["black", "white", "asian", "latino", "hispanic", "african", "european"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["immigrant", "native", "refugee"], ["immigrants", "natives", "refugees"], ["old", "young"], ["disabled", "blind", "deaf"], ["american", "mexican", "chinese", "indian", "french", "german"],
]
_PLACE = {w: (s, k) for s in IDENTITY for k, w in enumerate(s)}
_TERM = re.compile(r"\b(?:" + "|".join(sorted(_PLACE, key=len, reverse=True)) + r")\b", re.I)

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def swapped(text: str, by: int = 1) -> str:
    """``text`` with each identity term replaced by the one ``by`` places further in its set."""

    def other(m: re.Match) -> str:
        terms, k = _PLACE[m[0].lower()]
        return terms[(k + by) % len(terms)]

    return _TERM.sub(other, text)


def counterfactuals(text: str) -> list[str]:
    """The distinct texts that swaps make of ``text``: every term of a set stands in one of them for each other of it."""
    found = {m.lower() for m in _TERM.findall(text)}
    most = max((len(_PLACE[w][0]) for w in found), default=1)
    return sorted({swapped(text, by) for by in range(1, most)} - {text})


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of a text, and the square root of each one's number per word."""
    buf = as_bytes((text or "").lower())
    edge = np.zeros(len(buf) + 2, bool)
    edge[1:-1] = _LETTER[buf]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = at[0::2], at[1::2]
    found = [hashes(buf, start, end)]
    for k in PREFIXES:
        some = end - start > k
        found.append(hashes(buf, start[some], start[some] + k) ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64))
    bucket, times = np.unique((np.concatenate(found) % np.uint64(DIM)).astype(np.int32), return_counts=True)
    return bucket, np.sqrt(times / max(len(start), 1)).astype(np.float32)


class _Rows:
    """Sparse rows."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray | None = None) -> None:
        size = [len(r[0]) for r in rows]
        self.n = len(rows)
        self.at = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.int32)
        self.value = np.concatenate([r[1] for r in rows]).astype(float) if rows else np.empty(0)
        self.row = np.repeat(np.arange(len(rows)), size)
        if scale is not None:
            self.value *= scale[self.at]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * g[self.row], DIM)


def fit(rows: list, pairs: list, y: np.ndarray, penalty: float = PENALTY, l2: float = 2e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam; ``pairs`` has a list of the swapped texts' rows for each row.  Both classes weigh the same; a bucket counts by the log of its rarity, and not at all with one row only."""
    held = np.bincount(np.concatenate([np.unique(np.concatenate([r[0], *(c[0] for c in copies)])) for r, copies in zip(rows, pairs, strict=True)]), minlength=DIM)
    rarity = np.where(held > 1, np.log(len(rows) / np.maximum(held, 1)).clip(0), 0)
    x = _Rows(rows, rarity)
    moved = [(r, c, 1 / len(copies)) for r, copies in zip(rows, pairs, strict=True) for c in copies]
    x_moved, other_moved = (_Rows([t[k] for t in moved], rarity) for k in (0, 1))
    share = np.array([t[2] for t in moved])
    n = len(y)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))
    p, m, v = (np.zeros(DIM + 1) for _ in range(3))
    g = np.zeros(DIM + 1)
    for step in range(1, steps + 1):
        d = weight * (sigmoid(x.dot(p[:-1]) + p[-1]) - y)
        g[:-1], g[-1] = x.back(d) + l2 * p[:-1], d.sum()
        if len(moved):
            gap = 2 * penalty * share * (x_moved.dot(p[:-1]) - other_moved.dot(p[:-1])) / n
            g[:-1] += x_moved.back(gap) - other_moved.back(gap)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:-1] * rarity, float(p[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, penalty: float = PENALTY) -> dict:
    """Fit on at most ``rows`` labelled rows that aren't held out.  Without both labels among them every text scores 0."""
    ship(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = [features(t) for t in texts]
            pair = [[features(s) for s in counterfactuals(t)] for t in texts]
            kind = pa.list_(pa.binary())
            sides = [pa.array([[c[k].tobytes() for c in copies] for copies in pair], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *_packed(own), *sides], names=["doc_id", "label", "x", "value", "pair", "pair_value"])

    sample = training_rows(docs.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS), labels, label, rows)
    got = sample.mapInArrow(extract, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, x binary, value binary, pair array<binary>, pair_value array<binary>").toPandas().sort_values(["doc_id", "x"])
    y = got["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return {"w": np.zeros(DIM, np.float32), "b": 0.0, "slope": 0.0, "shift": -40.0}
    x = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(got["x"], got["value"], strict=True)]
    pairs = [[(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(buckets, values, strict=True)] for buckets, values in zip(got["pair"], got["pair_value"], strict=True)]
    part = np.arange(len(y)) % 4 == 0
    pick = lambda rows, which: [r for r, k in zip(rows, which, strict=True) if k]
    w, b = fit(pick(x, ~part), pick(pairs, ~part), y[~part], penalty)
    slope, shift = platt(_Rows(pick(x, part)).dot(w) + b, y[part])
    return {"w": w.astype(np.float32), "b": b, "slope": slope, "shift": shift}


def _packed(rows: list) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1))


def probability(text: str | None, model: dict) -> float:
    bucket, value = features(text)
    return float(sigmoid(model["slope"] * (float(model["w"][bucket] @ value) + model["b"]) + model["shift"]))


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text scores as an empty one, by the bias alone.  Null doc_id: not held out.  Repeated rows get equal results;
    an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([probability(t, model) for t in batch.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ---- query ------------------------------------------------------------------------------------------------------


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity(docs, train(docs, labels))
