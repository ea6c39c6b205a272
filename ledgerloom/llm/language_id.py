"""Language identification: one interpolated Kneser-Ney character model per language, the lowest cross-entropy wins.

A text is read as lower-case letters, with a blank for each run of anything else and before and after all; a symbol is the code point, folded
by a hash into 12 bits beyond 4,095.  ``ORDER`` symbols make one 60-bit key, whose low bits are the keys of its
suffixes and whose high bits its history, so that n-grams of all orders are sorted integer arrays that are searched by
bisection.

Counts cover every training text: tasks count each text's keys and Spark adds them up.  Only the highest order counts
occurrences; lower orders count the different symbols that go before (continuations), from the keys of the order above.
The model is two tables of each order (``_tables``): what a key has of its own in each language, and what a history leaves to the
next lower order.  What is broadcast is bounded: an order's ``KEYS`` probabilities of its most frequent keys, and the next lower order only if
all keys of this one are there.  Keys of a text that aren't settled by that are joined with the tables (``_probabilities``), so
that the bound changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .cluster import ship, stored, table
from .linear import platt

ORDER, BITS = 5, 12
#: Keys that are looked up at a time.
CHUNK = 1 << 20
#: Probabilities of an order that are broadcast, at most (keys times languages): 5 orders of at most 2^19, and of their histories, are some 60 MB.
KEYS = 1 << 19
#: Keys in one row that tells what isn't settled of a text.
ROW_KEYS = 1 << 14
#: Texts on which the score is calibrated, at most; they are not counted.
CALIBRATION_ROWS = 2_000
#: Symbols that are read at a time.
BLOCK = 1 << 20
UNKNOWN = "und"

_MASK = [np.int64((1 << BITS * k) - 1) for k in range(ORDER + 1)]


class _Fold:
    """Symbol of each code point of the basic plane: lower-case letters, 32 for all else."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            low = [ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, range(1 << 16))]
            cls.table = np.array([folded(p) for p in low], np.int64)
        return cls.table


def folded(point: int) -> int:
    """12 bits, never 0 (which stands before a text)."""
    return point if point < 1 << BITS else 1 + ((point * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS)) % ((1 << BITS) - 1)


def symbols(text: str | None) -> np.ndarray:
    """The text's symbols, a blank first and last; empty for a text without letters."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    fold = _Fold.get()
    if len(points) and points.max() >= 1 << 16:
        high = points >= 1 << 16
        out = fold[np.where(high, 32, points)]
        out[high] = [folded(ord(c.lower()[0])) if (c := chr(p)).isalpha() else 32 for p in points[high].tolist()]
    else:
        out = fold[points]
    if not (out != 32).any():
        return out[:0]
    out = np.concatenate(([32], out, [32]))
    return out[np.concatenate(([True], (out[1:] != 32) | (out[:-1] != 32)))]


def keys(text: str | None) -> Iterator[np.ndarray]:
    """The key of each symbol of a text after its first blank, block by block."""
    s = np.concatenate((np.zeros(ORDER - 2, np.int64), symbols(text)))
    for at in range(0, len(s) - ORDER + 1, BLOCK):
        part = s[at : at + BLOCK + ORDER - 1]
        two = (part[:-1] << np.int64(BITS)) | part[1:]
        four = (two[:-2] << np.int64(2 * BITS)) | two[2:]
        yield (four[:-1] << np.int64(BITS)) | part[4:]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's different keys, sorted, and how often each occurs."""
    parts = [np.unique(k, return_counts=True) for k in keys(text)]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return found, np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


# ---- model ------------------------------------------------------------------------------------------------------


def _at(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and which are hits."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


class Common:
    """What is broadcast, of each order: sorted keys and their probabilities, histories and what they leave to the next lower order (a column for each language)."""

    def __init__(self, langs: int) -> None:
        none = np.empty(0, np.int64), np.empty((0, langs))
        self.langs = langs
        self.keys, self.p, self.history, self.rest = [none[0]] * ORDER, [none[1]] * ORDER, [none[0]] * ORDER, [none[1]] * ORDER
        #: Orders of which all keys and histories are here.
        self.whole = [False] * ORDER

    def settled(self, wanted: np.ndarray) -> np.ndarray:
        """Which keys' probabilities these arrays give exactly."""
        out = np.zeros(len(wanted), bool)
        for k in range(ORDER, 0, -1):
            out |= _at(self.keys[k - 1], wanted & _MASK[k])[1]
            if not self.whole[k - 1]:
                return out
        return np.ones(len(wanted), bool)

    def probabilities(self, wanted: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of each key's last symbol after those before it, in each language."""
        if order == 0:
            return np.full((len(wanted), self.langs), 1 / (1 << BITS))
        at, hit = _at(self.keys[order - 1], wanted)
        out = np.empty((len(wanted), self.langs))
        out[hit] = self.p[order - 1][at[hit]]
        if not hit.all():
            rest = wanted[~hit]
            where, known = _at(self.history[order - 1], rest >> np.int64(BITS))
            left = np.ones((len(rest), self.langs))
            left[known] = self.rest[order - 1][where[known]]
            out[~hit] = left * self.probabilities(rest & _MASK[order - 1], order - 1)
        return out


class Language:
    """One language's column of what is broadcast."""

    def __init__(self, common: Common, column: int) -> None:
        self.common, self.column, self.keys, self.history = common, column, common.keys, common.history

    def probability(self, wanted: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of each key's last symbol after those before it; exact for keys that are ``settled``."""
        return self.common.probabilities(wanted, order)[:, self.column]


def _counts(texts: DataFrame) -> DataFrame:
    """lang, key and n of the highest order over all texts."""
    ship(texts.sparkSession)

    def told(by: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in by.items():
            found, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([c for _, c in parts]), minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], names=["lang", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            size = 0
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(counted(text))
                size += len(by[lang][-1][0])
                if size >= CHUNK:
                    yield from told(by)
                    by, size = {}, 0
            yield from told(by)

    return texts.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _most(rows: DataFrame, by: str, share: int) -> DataFrame:
    """The rows with the largest ``by``: all down to the least value with which they are no more than ``share`` (ties stay or go together)."""
    values = rows.groupBy(by).agg(F.count("*").alias("rows"))
    down = values.withColumn("down", F.sum("rows").over(Window.orderBy(F.desc(by))))
    return rows.join(down.where(F.col("down") <= share).select(by), by)


def _by_language(rows: DataFrame, value: str, langs: int, without: float) -> DataFrame:
    """key and x: ``value`` of each language in an array, ``without`` where it has none.  rows: key, l (the language's place) and the value."""
    found = rows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("l", value))).alias("found"))
    places = F.array(*(F.lit(i) for i in range(langs)))
    return found.select("key", F.transform(places, lambda i: F.coalesce(F.try_element_at("found", i), F.lit(without))).alias("x"))


def _tables(counts: DataFrame, langs: list[str]) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Of each order, what keys have of their own and what histories leave to the next lower one (key and x); the keys of the highest order with n, their occurrences.

    A key's probability is its own part, plus what its history leaves times the probability of its suffix in the next lower order;
    a key that a language hasn't seen has no part of its own, and a history that it hasn't seen leaves all.
    """
    place = F.create_map(*(F.lit(x) for pair in zip(langs, range(len(langs)), strict=True) for x in pair))
    t = stored(counts.select(place[F.col("lang")].alias("l"), "key", F.col("n").alias("c")), "language_keys")
    seen = t.groupBy("key").agg(F.sum("c").alias("n"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(ORDER, 0, -1):
        few = t.groupBy("l").agg(F.sum((F.col("c") == 1).cast("long")).alias("a"), F.sum((F.col("c") == 2).cast("long")).alias("b")).collect()
        d = F.create_map(*(F.lit(x) for r in few for x in (r["l"], r["a"] / (r["a"] + 2 * r["b"]) if r["a"] else 0.5)))[F.col("l")]
        history = F.shiftright("key", BITS)
        total = F.sum("c").over(Window.partitionBy("l", history))
        own = t.select("l", "key", (F.greatest(F.col("c") - d, F.lit(0.0)) / total).alias("own"))
        rest = t.groupBy("l", history.alias("key")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).select("l", "key", (d * F.col("kinds") / F.col("total")).alias("rest"))
        out.insert(0, (stored(_by_language(own, "own", len(langs), 0.0), "language_own"), stored(_by_language(rest, "rest", len(langs), 1.0), "language_rest")))
        if k > 1:
            t = stored(t.groupBy("l", F.col("key").bitwiseAND(int(_MASK[k - 1])).alias("key")).agg(F.count("*").alias("c")), "language_keys")
    return out, seen


def _probabilities(wanted: DataFrame, tables: list[tuple[DataFrame, DataFrame]], langs: int, order: int = ORDER) -> DataFrame:
    """key and p (exact, of each language) of the different keys ``wanted``, by joins with the tables of all orders."""

    def each(x: float) -> Column:
        return F.array(*(F.lit(x) for _ in range(langs)))

    rows = wanted.select("key")
    p = each(1 / (1 << BITS))
    for k, (own, rest) in enumerate(tables[:order], 1):
        key = F.col("key").bitwiseAND(int(_MASK[k]))
        rows = rows.join(own.select(F.col("key").alias(f"own{k}"), F.col("x").alias(f"a{k}")), key == F.col(f"own{k}"), "left")
        rows = rows.join(rest.select(F.col("key").alias(f"rest{k}"), F.col("x").alias(f"r{k}")), F.shiftright(key, BITS) == F.col(f"rest{k}"), "left").drop(f"own{k}", f"rest{k}")
        left = F.zip_with(F.coalesce(f"r{k}", each(1.0)), p, lambda x, y: x * y)
        p = F.zip_with(F.coalesce(f"a{k}", each(0.0)), left, lambda x, y: x + y)
    return rows.select("key", p.alias("p"))


def _common(tables: list[tuple[DataFrame, DataFrame]], seen: DataFrame, langs: int, share: int) -> Common:
    """The most frequent keys of the highest order, ``share`` at most; the next lower order only after one that is whole."""
    out = Common(langs)
    for k in range(ORDER, 0, -1):
        own, rest = tables[k - 1]
        whole = own.count() <= share
        if whole:
            out.whole[k - 1] = True
            out.history[k - 1], out.rest[k - 1] = _sorted(rest, "x", langs)
            out.keys[k - 1], out.p[k - 1] = _sorted(_probabilities(own, tables, langs, k), "p", langs)
        else:
            if k == ORDER:
                out.keys[k - 1], out.p[k - 1] = _sorted(_probabilities(_most(seen, "n", share), tables, langs), "p", langs)
            break
    return out


def train(docs: DataFrame, share: int | None = None) -> dict:
    """Models of the languages of ``docs`` (text, lang) by name, their tables and the calibration; rows without text or language teach nothing.  share: keys of an order that are broadcast, at most."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    apart = F.coalesce(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(16)) == 0, F.lit(False))
    counts = stored(_counts(known.where(~apart)), "language_keys")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return {"langs": [], "models": [], "tables": [], "common": Common(0), "slope": 1.0, "shift": 0.0}
    tables, seen = _tables(counts, langs)
    common = _common(tables, seen, len(langs), share or max(KEYS // len(langs), 1))
    model = {"langs": langs, "models": [Language(common, k) for k in range(len(langs))], "tables": tables, "common": common, "slope": 1.0, "shift": 0.0}
    sample = known.where(apart).withColumn("hash", F.xxhash64("doc_id", "text")).orderBy("hash", "lang").limit(CALIBRATION_ROWS)
    lead, right = [], []
    for lang, e, n in _entropies(sample.select("hash", "lang", "text"), model).orderBy("hash", "lang").select("lang", "entropy", "n").collect():
        if n:
            e = np.array(e)
            for k, name in enumerate(langs):
                lead.append(_lead(e, k, n))
                right.append(float(name == lang))
    model["slope"], model["shift"] = platt(np.array(lead), np.array(right))
    return model


def _sorted(rows: DataFrame, value: str, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, with their arrays as rows; ``rows`` is bounded by KEYS."""
    got = rows.select("key", value).toArrow().combine_chunks()
    key = got.column("key").to_numpy()
    order = np.argsort(key)
    return key[order], pc.list_flatten(got.column(value)).to_numpy().reshape(len(key), langs)[order]


# ---- scoring ----------------------------------------------------------------------------------------------------


def _lead(entropies: np.ndarray, k: int, n: int) -> float:
    """How much lower language k's cross-entropy is than the lowest other, in units that shrink with the root of the length."""
    others = np.delete(entropies, k)
    return float((others.min() - entropies[k]) * np.sqrt(n)) if len(others) else 0.0


def cross_entropies(texts: list[str | None], common: Common) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """For each text, nats in all by each language over its settled keys, the number of symbols (0: no letter), and its other keys and how often each occurs.

    A key is looked up once for many texts.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for text in texts:
        held.append(counted(text))
        size += len(held[-1][0])
        if size >= CHUNK or len(held) >= 1024:
            yield from _looked_up(held, common)
            held, size = [], 0
    yield from _looked_up(held, common)


def _looked_up(held: list[tuple[np.ndarray, np.ndarray]], common: Common) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    some = [(k, t) for k, t in held if len(k)]
    if some:
        key, times = np.concatenate([k for k, _ in some]), np.concatenate([t for _, t in some])
        found = np.unique(key)
        where, starts = np.searchsorted(found, key), np.cumsum([0, *(len(k) for k, _ in some[:-1])])
        known = common.settled(found)
        nats = np.zeros((common.langs, len(found)))
        nats[:, known] = -np.log(common.probabilities(found[known])).T
        out = np.column_stack([np.add.reduceat(times * n[where], starts) for n in nats]) if common.langs else np.zeros((len(some), 0))
        size, open_ = np.add.reduceat(times, starts), ~known[where]
        rows = iter(zip(out, size.tolist(), np.split(open_, starts[1:]), strict=True))
    for k, t in held:
        if len(k):
            nats_, n, left = next(rows)
            yield nats_, n, k[left], t[left]
        else:
            yield np.zeros(common.langs), 0, k, t


def _entropies(docs: DataFrame, model: dict) -> DataFrame:
    """The columns of ``docs`` but text, with entropy (nats a symbol, one for each language) and n (symbols) of each row.

    Keys that what is broadcast doesn't settle are told in rows of ``ROW_KEYS`` at most, joined with the model's tables and added up by text.
    """
    ship(docs.sparkSession)
    common = model["common"]
    sent = docs.sparkSession.sparkContext.broadcast(common)
    columns = [c for c in docs.columns if c != "text"]
    whole = all(common.whole) or not common.langs
    rows = docs.withColumn("row", F.lit(0).cast("long") if whole else F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            told: tuple[list, list, list, list] = ([], [], [], [])
            for i, (nats, n, keys_, times) in enumerate(cross_entropies(batch.column("text").to_pylist(), sent.value)):
                for start in range(0, max(len(keys_), 1), ROW_KEYS):
                    at.append(i)
                    for part, x in zip(told, (None if start else nats, None if start else n, keys_[start : start + ROW_KEYS], times[start : start + ROW_KEYS]), strict=True):
                        part.append(x)
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in (*columns, "row")]
            kinds = (pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, t) for x, t in zip(told, kinds, strict=True))], names=[*columns, "row", "nats", "n", "keys", "times"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes)
    told = rows.mapInArrow(run, f"{kinds}, row long, nats array<double>, n long, keys array<long>, times array<long>")
    nats = F.col("nats")
    if not whole:
        told = stored(told, "language_rows")
        left = told.where(F.size("keys") > 0).select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
        p = _probabilities(left.select("key").distinct(), model["tables"], common.langs)
        sums = [F.sum((-F.log(F.col("p")[k]) * F.col("times")).cast("decimal(28,12)")) for k in range(common.langs)]  # decimal: the same in any order
        more = left.join(p, "key").groupBy(F.col("row").alias("of")).agg(F.array(*sums).cast("array<double>").alias("more"))
        told = told.where(F.col("n").isNotNull()).join(more, F.col("row") == F.col("of"), "left")
        nats = F.when(F.col("more").isNull(), nats).otherwise(F.zip_with("nats", "more", lambda x, y: x + y))
    return told.select(*columns, F.transform(nats, lambda x: x / F.greatest(F.col("n"), F.lit(1))).alias("entropy"), "n")


def identify(docs: DataFrame, model: dict, reject: float = 0.0) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability that it is right) and entropy (nats a symbol) of every row.

    A null text, or one without a letter, is ``und`` with score 0, and so is everything if no language was learned; so is a text whose
    score is under ``reject``, with its score.  Languages that tie: the first by name.  Repeated rows and null ids are judged like others;
    other columns are ignored.
    """
    none = (F.col("n") == 0) | (F.size("entropy") == 0)
    least = F.array_min("entropy")
    ahead = (F.try_element_at(F.array_sort("entropy"), F.lit(2)) - least) * F.sqrt("n")  # as _lead
    chance = 1 / (1 + F.exp(-F.greatest(F.least(model["slope"] * ahead + model["shift"], F.lit(40.0)), F.lit(-40.0))))
    score = F.when(none, 0.0).when(F.size("entropy") == 1, 1.0).otherwise(chance)
    lang = F.try_element_at(F.array(*(F.lit(x) for x in model["langs"])).cast("array<string>"), F.array_position("entropy", least).cast("int"))
    judged = _entropies(docs.select("doc_id", "text"), model).select("doc_id", F.when(none, UNKNOWN).otherwise(lang).alias("lang_pred"), score.alias("score"), F.when(none, F.lit(None)).otherwise(least).alias("entropy"))
    return judged.withColumn("lang_pred", F.when((F.col("score") < reject), UNKNOWN).otherwise(F.col("lang_pred")))


# ---- query ------------------------------------------------------------------------------------------------------


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, train(docs.where(~held_out))).withColumn("held_out", held_out)
