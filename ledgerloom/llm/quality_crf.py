"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad.  A line's evidence is a fixed set of measures of itself and of its two neighbours; transitions
between labels are learned.  Training takes a labelled document's quality for all of its lines.  A document's goodness
is the mean of its lines' good marginals (forward-backward), weighted by their lengths in bytes, and a logistic
calibration turns it into the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ship, table
from .labelled import held_out, training_rows
from .linear import platt, sigmoid
from .words import as_bytes, hashes, spans

#: Labelled rows to fit on, at most, and the longest text among them (in code points): they bound what reaches the driver.
TRAIN_ROWS, TRAIN_CHARS = 2_000, 200_000
#: Lines of a text that are walked one after another; longer texts are cut into blocks of so many.
BLOCK_LINES = 512
#: The fixed threshold of ``predicted``.
THRESHOLD = 0.3

_CLASSES = np.zeros((5, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, [ord(c) for c in "#*$%&|<>@{}[]\\^~=+_"]] = True
_CLASSES[2, 48:58] = True
_CLASSES[3, [ord(c) for c in "!?"]] = True
_CLASSES[4, 97:123] = True
_CLASSES[4, 128:] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;\"')"]] = True
#: Measures of a line; with two neighbours and two flags for the ends of the text.
OWN = 14
WIDTH = 3 * OWN + 2


def line_measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of WIDTH measures, and lengths in bytes, for the lines of a text that have a word."""
    buf = as_bytes(text)
    start, end = spans(buf)
    if not len(start):
        return np.empty((0, WIDTH), np.float32), np.empty(0)
    breaks = np.flatnonzero(buf == 10)
    line = np.searchsorted(breaks, start)
    first = np.concatenate(([0], np.flatnonzero(line[1:] != line[:-1]) + 1))
    n = np.diff(np.concatenate((first, [len(start)])))
    head, tail = start[first], end[first + n - 1]
    size = (tail - head).astype(float)
    cum = np.zeros(len(buf) + 1, np.int64)
    share = []
    for k in _CLASSES:
        np.cumsum(k[buf], out=cum[1:])
        share.append((cum[tail] - cum[head]) / size)
    h = hashes(buf, start, end)
    whole = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(first, n).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), first)
    _, where, times = np.unique(whole, return_index=True, return_counts=True)
    dup = np.ones(len(first))
    dup[where] = 0
    row = np.repeat(np.arange(len(first)), n)
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][fresh], minlength=len(first))
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    # Words that the text used before, in this line or an earlier one.
    _, once = np.unique(h, return_index=True)
    again = np.ones(len(h))
    again[once] = 0
    one = (end - start == 1).astype(float)
    own = np.column_stack([
        np.log1p(size) / 8, np.log1p(n) / 6, *share, size / n / 10, 1 - distinct / n, np.add.reduceat(same, first) / n, np.add.reduceat(again, first) / n,
        _END[buf[tail - 1]], dup, np.add.reduceat(one, first) / n,
    ]).astype(np.float32)
    gap = np.zeros((1, OWN), np.float32)
    flags = np.zeros((len(own), 2), np.float32)
    flags[0, 0], flags[-1, 1] = 1, 1
    return np.hstack([own, np.vstack([gap, own[:-1]]), np.vstack([own[1:], gap]), flags]), size


def _through(vector: np.ndarray, move: np.ndarray) -> np.ndarray:
    """A row of log messages for each state, moved on by one line."""
    return np.logaddexp(vector[..., 0, None] + move[0], vector[..., 1, None] + move[1])


def forward_backward(good: np.ndarray, size: np.ndarray, move: np.ndarray, begin: float, block: int = BLOCK_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Good marginals of all lines and the expected moves per document (2 x 2: from, to; 1 is good).

    good: a line's evidence for good against bad, documents after each other; size: lines of each document; move: scores
    of moves; begin: score of a good first line.  All documents are walked at once, a line at a time.  Long ones are cut
    into blocks that are walked side by side too: first for what each makes of any message, then with the one it gets.
    """
    n_blocks = -(-size // block)
    doc = np.repeat(np.arange(len(size)), n_blocks)
    j = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start, length = (np.cumsum(size) - size)[doc] + j * block, np.minimum(block, size[doc] - j * block)
    order = np.argsort(-length, kind="stable")
    at, ranked, opens = start[order], length[order], (j == 0)[order]
    steps = int(ranked[0]) if len(ranked) else 0
    live = [int(np.searchsorted(-ranked, -t, "left")) for t in range(steps)]  # blocks with more than t lines
    evidence = np.column_stack([np.zeros(len(good)), good])
    first = np.where(opens[:, None], evidence[at] + [0.0, begin], 0.0)  # of the blocks that open a document
    into, after = np.zeros((len(order), 2)), np.zeros((len(order), 2))
    if n_blocks.max(initial=0) > 1:
        # What a block makes of a message: from each state before its first line to each at its last.
        whole = np.where(opens[:, None, None], np.stack([first, np.full_like(first, -np.inf)], axis=1), move[None] + evidence[at][:, None, :])
        for t in range(1, steps):
            whole[: live[t]] = _through(whole[: live[t]], move) + evidence[at[: live[t]] + t][:, None, :]
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        into[opens] = [0.0, -np.inf]
        later = [place[np.flatnonzero(j == k)] for k in range(1, int(n_blocks.max()))]
        prior = [place[np.flatnonzero(j == k) - 1] for k in range(1, int(n_blocks.max()))]
        for here, before in zip(later, prior, strict=True):
            into[here] = np.logaddexp(into[before, 0, None] + whole[before, 0], into[before, 1, None] + whole[before, 1])
        for here, before in zip(reversed(later), reversed(prior), strict=True):
            after[before] = np.logaddexp(whole[here, :, 0] + after[here, 0, None], whole[here, :, 1] + after[here, 1, None])
    alpha, beta = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    if steps:
        alpha[at] = np.where(opens[:, None], first, _through(into, move) + evidence[at])
        beta[at + ranked - 1] = after
    for t in range(1, steps):
        k = at[: live[t]] + t
        alpha[k] = _through(alpha[k - 1], move) + evidence[k]
    for t in range(steps - 2, -1, -1):
        k = at[: live[t + 1]] + t
        beta[k] = _through(beta[k + 1] + evidence[k + 1], move.T)
    both = alpha + beta
    marginal = sigmoid(both[:, 1] - both[:, 0])
    norm = np.logaddexp(both[:, 0], both[:, 1])
    moved = np.zeros((len(size), 2, 2))
    owner = np.repeat(np.arange(len(size)), size)
    k = np.flatnonzero(np.concatenate((owner[1:] == owner[:-1], [False]))) if len(good) else np.empty(0, int)
    for a in (0, 1):
        for b in (0, 1):
            p = np.exp(alpha[k, a] + move[a, b] + beta[k + 1, b] + (good[k + 1] if b else 0) - norm[k])
            moved[:, a, b] = np.bincount(owner[k], p, len(size))
    return marginal, moved


def fit(x: np.ndarray, size: np.ndarray, y: np.ndarray, steps: int = 150, l2: float = 1e-3) -> dict:
    """Weights of the evidence, scores of moves and of a good start, by Adam on the mean conditional log likelihood per line."""
    if not len(x):  # no line to learn from: all evidence is nought, and the calibration alone decides
        return {"w": np.zeros(WIDTH), "b": 0.0, "move": np.zeros((2, 2)), "begin": 0.0}
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    owner = np.repeat(np.arange(len(size)), size)
    truth = y[owner]
    per_doc = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = per_doc[owner] / np.maximum(size, 1)[owner]
    p = np.zeros(WIDTH + 1 + 4 + 1)  # evidence, its bias, moves, begin
    m, v = np.zeros_like(p), np.zeros_like(p)
    first = np.cumsum(size) - size
    some = size > 0
    for step in range(1, steps + 1):
        good = z @ p[:WIDTH] + p[WIDTH]
        marginal, moved = forward_backward(good, size, p[WIDTH + 1 : WIDTH + 5].reshape(2, 2), p[-1])
        g = np.zeros_like(p)
        d = w * (marginal - truth)
        g[:WIDTH], g[WIDTH] = z.T @ d, d.sum()
        seen = np.zeros_like(moved)
        seen[np.arange(len(size)), y.astype(int), y.astype(int)] = np.maximum(size - 1, 0)
        g[WIDTH + 1 : WIDTH + 5] = ((moved - seen) * (per_doc / np.maximum(size, 1))[:, None, None]).sum(0).ravel()
        g[-1] = ((marginal[first[some]] - y[some]) * (per_doc / np.maximum(size, 1))[some]).sum()
        g += l2 * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"w": p[:WIDTH] / scale, "b": p[WIDTH] - float((p[:WIDTH] / scale) @ mean), "move": p[WIDTH + 1 : WIDTH + 5].reshape(2, 2), "begin": float(p[-1])}


def goodness(x: np.ndarray, weight: np.ndarray, size: np.ndarray, model: dict) -> np.ndarray:
    """Length-weighted mean of the good marginals of each document, 0 without lines."""
    marginal, _ = forward_backward(x @ model["w"] + model["b"], size, model["move"], model["begin"])
    owner = np.repeat(np.arange(len(size)), size)
    total = np.bincount(owner, weight, len(size))
    return np.divide(np.bincount(owner, weight * marginal, len(size)), total, out=np.zeros(len(size)), where=total > 0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most ``rows`` labelled rows that aren't held out.  Without both labels among them every text scores 1."""
    ship(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_measures(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["doc_id", "label", "x", "weight"])

    sample = training_rows(docs.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS), labels, label, rows)
    got = sample.mapInArrow(extract, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, x binary, weight binary").toPandas().sort_values(["doc_id", "x"])
    y = got["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return {"w": np.zeros(WIDTH), "b": 0.0, "move": np.zeros((2, 2)), "begin": 0.0, "slope": 0.0, "shift": 40.0}
    part = np.arange(len(y)) % 4 == 0

    def lines(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        xs = [np.frombuffer(v, np.float32).reshape(-1, WIDTH) for v in got["x"][which]]
        return np.vstack(xs).astype(float), np.concatenate([np.frombuffer(v) for v in got["weight"][which]]), np.array([len(v) for v in xs])

    x, _, size = lines(~part)
    model = fit(x, size, y[~part])
    x, weight, size = lines(part)
    model["slope"], model["shift"] = platt(_logit(goodness(x, weight, size, model)), y[part])
    return model


def _scores(texts: pa.Array, model: dict) -> list[float]:
    out: list[float] = []
    for k in range(0, len(texts), 256):
        found = [line_measures(t) for t in texts.slice(k, 256).to_pylist()]
        size = np.array([len(x) for x, _ in found])
        good = goodness(np.vstack([x for x, _ in found]).astype(float), np.concatenate([s for _, s in found]), size, model)
        out += sigmoid(model["slope"] * _logit(good) + model["shift"]).tolist()
    return out


def quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text and one without a word have no lines: goodness 0.  Null doc_id: not held out.  Repeated rows get equal
    results; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), model), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def line_labels(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, line, text, good and marginal of each line with a word.

    line: its number among all lines of the text, from 0; marginal: the probability that it is good, given the whole text; good: whether that is
    a half or more.  Rows without such a line (null, empty, white space) give none; repeated rows give their lines each.
    """
    ship(docs.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                texts = rows.column("text").to_pylist()
                found = [line_measures(t) for t in texts]
                size = np.array([len(x) for x, _ in found])
                x = np.vstack([x for x, _ in found]).astype(float)
                marginal, _ = forward_backward(x @ model["w"] + model["b"], size, model["move"], model["begin"])
                lines = [[(n, line) for n, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\x0b\x0c\r")] for t in texts]
                numbers, said = [n for own in lines for n, _ in own], [line for own in lines for _, line in own]
                ids = rows.column("doc_id").take(pa.array(np.repeat(np.arange(len(size)), size)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int32()), pa.array(said, pa.string()), pa.array(marginal >= 0.5, pa.bool_()), pa.array(marginal, pa.float64())], names=["doc_id", "line", "text", "good", "marginal"])

    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id {dict(docs.dtypes)['doc_id']}, line int, text string, good boolean, marginal double")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that score THRESHOLD or more, in one pass over them."""
    ship(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s >= THRESHOLD for s in _scores(batch.column("text"), model)], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


# ---- query ------------------------------------------------------------------------------------------------------


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality(docs, train(docs, labels))
