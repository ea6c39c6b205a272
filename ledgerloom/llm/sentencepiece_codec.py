"""SentencePiece encoding by streaming Viterbi, and decoding.

The vocabulary is a public SentencePiece model with byte fallback.  A piece's score is minus the log of its rank in the
vocabulary, and the segmentation is the one with the highest total (not that of byte-pair merges).  A text is streamed
through one Viterbi search that holds a window: the scores and back pointers from the last committed boundary to the
furthest one that is open, which is at most the longest piece ahead.  Whenever one boundary only is open, all surviving
paths have met in it; else, after every LOOK characters, their back pointers are followed to where they meet.  Ids up to
there are committed and forgotten.

No piece holds a space mark after another character, nor (in most models) a Latin letter next to anything else but marks
before it; both are checked on load.  So the paths always meet in such places.  What was committed between two of them
depends on nothing else, and is kept in a bounded memo.

Spaces become U+2581 and one is put before the text; U+2581 itself is spelled in bytes, so decoding gives the text back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .cluster import ship, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Memoised stretches in a worker, twice.
MEMO = 200_000
#: Characters of a stretch that is kept in the memo, at most.
MEMO_CHARS = 48
#: Characters since the last commit after which back pointers are followed.
LOOK = 64
_MARK = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Ways to cut a text where no piece of a model goes on, the finer first: at marks and where Latin letters begin or end, or at marks only.
_STRETCHES = [
    (re.compile(f"{_MARK}*[{_LATIN}]+|{_MARK}*[^{_MARK}{_LATIN}]+|{_MARK}+"), re.compile(f"[^{_MARK}]{_MARK}|[{_LATIN}][^{_LATIN}]|[^{_MARK}{_LATIN}][{_LATIN}]")),
    (re.compile(f"{_MARK}*[^{_MARK}]+|{_MARK}+"), re.compile(f"[^{_MARK}]{_MARK}")),
]


class Codec:
    def __init__(self, model: str = MODEL) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [sp.id_to_piece(k) for k in range(sp.vocab_size())]
        self.byte0 = next(k for k in range(len(self.pieces)) if sp.is_byte(k))
        if [self.pieces[self.byte0 + b] for b in range(256)] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError("the model has no byte pieces in order")
        normal = [k for k in range(len(self.pieces)) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        self.longest = max(len(self.pieces[k]) for k in normal)
        held = {p[k : k + 2] for p in (self.pieces[k] for k in normal) for k in range(len(p) - 1)}
        self.stretches = next((cut for cut, pair in _STRETCHES if not any(map(pair.search, held))), None)
        if self.stretches is None:
            raise ValueError("a piece of the model crosses a space")
        rank = {k: n for n, k in enumerate(normal, 2)}
        self.trie: dict = {}
        for k in normal:
            node = self.trie
            for c in self.pieces[k]:
                node = node.setdefault(c, {})
            node[""] = (k, -float(np.log(rank[k])))
        self.unknown = -float(np.log(len(normal) + 2)) - 10
        self.memo: dict[str, tuple[int, ...]] = {}  # and the one before, when it was full
        self.older: dict[str, tuple[int, ...]] = {}
        self.text = [p.replace(_MARK, " ") for p in self.pieces]
        for b in range(128):
            self.text[self.byte0 + b] = chr(b)

    def viterbi(self, text: str, look: int = LOOK) -> list[int]:
        """Ids of a text with marks for spaces.  Of equal totals, the piece that was reached from further back stays."""
        trie, longest, unknown, size = self.trie, self.longest, self.unknown, len(text)
        out: list[int] = []
        base = at = 0  # what is before base is committed
        best, back, piece = [0.0], [0], [-1]  # for the boundaries from base on
        due = look
        while at < size:
            here, node = best[at - base], trie
            for end in range(at + 1, min(size, at + longest) + 1):
                node = node.get(text[end - 1])
                if node is None:
                    break
                found = node.get("")
                if found is not None:
                    k, score = end - base, here + found[1]
                    while k >= len(best):
                        best.append(-1e300)
                        back.append(0)
                        piece.append(-1)
                    if score > best[k]:
                        best[k], back[k], piece[k] = score, at, found[0]
            at += 1
            k = at - base
            if k == len(best):
                best.append(-1e300)
                back.append(0)
                piece.append(-1)
            if best[k] == -1e300:
                best[k], back[k] = here + unknown, at - 1
            if k + 1 == len(best):
                if back[k] == base and piece[k] >= 0:
                    out.append(piece[k])
                else:
                    self._commit(text, base, at, back, piece, out)
                base, due = at, at + look
                best, back, piece = [0.0], [0], [-1]
            elif at >= due:
                due = at + look
                met = self._meeting(best, back, base, at)
                if met > base:
                    self._commit(text, base, met, back, piece, out)
                    for held in (best, back, piece):
                        del held[: met - base]
                    base = met
        return out

    @staticmethod
    def _meeting(best: list[float], back: list[int], base: int, at: int) -> int:
        """The last boundary that the paths of all open ones, from ``at`` on, share."""
        open_ = {at + k for k, score in enumerate(best[at - base :]) if score > -1e300}
        while len(open_) > 1:
            last = max(open_)
            open_.discard(last)
            open_.add(max(back[last - base], base))
        return open_.pop()

    def _commit(self, text: str, base: int, end: int, back: list[int], piece: list[int], out: list[int]) -> None:
        """Append the ids from base to end."""
        got: list[int] = []
        while end > base:
            start, found = back[end - base], piece[end - base]
            if found >= 0:
                got.append(found)
            else:
                got += [self.byte0 + b for b in reversed(text[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        out += reversed(got)

    def encode(self, text: str | None) -> list[int]:
        """Ids; none for an empty or null text."""
        if not text:
            return []
        if _MARK in text:
            out: list[int] = []
            for k, part in enumerate(text.split(_MARK)):
                if k:
                    out += [self.byte0 + b for b in _MARK.encode()]
                out += self._marked((_MARK if not k else "") + part.replace(" ", _MARK))
            return out
        return self._marked(_MARK + text.replace(" ", _MARK))

    def _marked(self, text: str) -> list[int]:
        memo, older, out = self.memo, self.older, []
        for stretch in self.stretches.findall(text):
            ids = memo.get(stretch) or older.get(stretch)
            if ids is None:
                ids = tuple(self.viterbi(stretch))
                if len(stretch) > MEMO_CHARS:
                    out += ids
                    continue
                if len(memo) >= MEMO:
                    self.memo, self.older = {}, memo
                    memo, older = self.memo, memo
                memo[stretch] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        low, high = self.byte0 + 128, self.byte0 + 256
        if any(low <= k < high for k in ids):
            parts, run = [], bytearray()
            for k in ids:
                if self.byte0 <= k < high:
                    run.append(k - self.byte0)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run.clear()
                parts.append(self.text[k])
            text = "".join(parts) + run.decode("utf-8", "replace")
        else:
            text = "".join(map(self.text.__getitem__, ids))
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(model: str = MODEL) -> Codec:
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids and exact (decoding gives the text back) for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has no ids and is exact.  Repeated rows get equal results; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerloom.llm.sentencepiece_codec import codec  # the worker's own, kept between tasks

        c = codec(model)
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id")
            for k in range(0, batch.num_rows, 512):
                ids, exact = [], []
                for text in texts.slice(k, 512).to_pylist():
                    got = c.encode(text)
                    exact.append(c.decode(got) == (text or ""))
                    ids.append(np.array(got, np.int32))
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(k, 512), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(exact, pa.bool_())], names=["doc_id", "n_tokens", "ids", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids array<int>, exact boolean")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text for each row of ``tokens`` (doc_id, ids).  Null ids give a null text, an empty list an empty one."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerloom.llm.sentencepiece_codec import codec

        c = codec(model)
        for batch in batches:
            texts = [None if ids is None else c.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")


# ---- query ------------------------------------------------------------------------------------------------------


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its whole text."""
    return encode(table(spark, sf_dir, "documents"))
