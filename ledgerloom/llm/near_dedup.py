"""Near-duplicate grouping: SuperMinHash signatures, banding, exact verification, union-find.

A document's set holds its distinct shingles of five words (A-Z lower-cased; with fewer words the whole sequence is one
shingle).  Documents with 100 * intersection >= 75 * union are linked; a component is what links reach.

* Equal sets are one class from the start, so exact copies cost nothing later however many there are.
* SuperMinHash gives each element a random permutation of the registers; its j-th register gets j plus a uniform
  number.  All registers are settled as soon as the largest value is below the next step, mostly after a few steps.
* BANDS bands of ROWS registers make the buckets.  A pair at the threshold misses all of them with probability
  (1 - 0.75**4)**32 = 5e-6, and less than that with this signature.
* In a bucket, members are first held against one pivot, which is linear in the bucket whatever its size (a few bands
  before the others, which then skip members of the pivot's component).  Where more than one component is left, they are
  held against the member that has the largest share of shingles in common with any other, until a round links nothing.
* What is still apart and could be similar, by the number of shingles that some other such document has, meets by rare
  shared shingles: of two similar sets, ordered by rarity, the heads must have a shingle in common, and how far back
  that stands bounds the other's size.  Only pairs that fit each other's bounds are candidates.
* Every candidate is verified on the two full sets, from the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ship, stored, table
from .components import connected_components
from .words import as_bytes, hashes, mix, spans, windows

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Bands whose pivots are tried before the others.
FIRST_BANDS = 6
#: Rounds of second pivots, at most; what they leave is compared by rare shingles.
PIVOT_ROUNDS = 4
#: Documents with one rare shingle and about one size, above which they are dealt to several tasks.
BLOCK = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = 0x9E3779B97F4A7C15
_TO_UNIT = 2.0**-53
_ODD_INVERSE = np.array([pow(x, -1, REGISTERS) if x % 2 else 0 for x in range(REGISTERS)])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; empty without a word."""
    buf = _LOWER[as_bytes(text)]
    h = hashes(buf, *spans(buf))
    return np.unique(windows(h, min(SHINGLE, len(h)))) if len(h) else h


def _random(e: np.ndarray, j: int | np.ndarray) -> np.ndarray:
    return mix(e + (np.uint64(2) * np.asarray(j, np.uint64) + np.uint64(1)) * np.uint64(_GOLD))


def signature(e: np.ndarray) -> np.ndarray:
    """SuperMinHash of the distinct hashes ``e`` (one at least): REGISTERS values in [0, REGISTERS).

    An element's permutation of the registers is k + j * stride for its own k and odd stride, REGISTERS being a power of two.
    """
    m, value = REGISTERS, np.full(REGISTERS, np.inf)
    with np.errstate(over="ignore"):
        draw = mix(e)
        k, stride = (draw & np.uint64(m - 1)).astype(np.int64), ((draw >> np.uint64(32)) & np.uint64(m - 1) | np.uint64(1)).astype(np.int64)
        if len(e) <= 48:  # the rank of every register for every element at once
            rank = ((np.arange(m) - k[:, None]) * _ODD_INVERSE[stride][:, None]) & (m - 1)
            return (rank + (_random(e[:, None], rank) >> np.uint64(11)) * _TO_UNIT).min(0)
        for j in range(m):
            place, some = (k + j * stride) & (m - 1), e
            if j:
                open_ = value[place] > j
                place, some = place[open_], e[open_]
            np.minimum.at(value, place, (_random(some, j) >> np.uint64(11)) * _TO_UNIT + j)
            if value.max() <= j + 1:
                break
    return value


def band_keys(value: np.ndarray) -> np.ndarray:
    bits = value.view(np.uint64).reshape(BANDS, ROWS)
    return mix(windows_of_rows(bits) ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_GOLD))).view(np.int64)


def windows_of_rows(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bits), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bits.shape[1]):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + bits[:, k])
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, ids, bands = [], [], []
        for text in batch.column("text").to_pylist():
            e = shingle_set(text)
            size.append(len(e))
            ids.append(hashlib.blake2b(e.tobytes(), digest_size=16).digest() if len(e) else None)
            bands.append(band_keys(signature(e)) if len(e) else np.empty(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), keys], names=["doc_id", "n_shingles", "set_id", "bands"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs with both texts, those whose full sets are similar enough."""
    last, held = None, np.empty(0, np.uint64)
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            if a != last or last is None:
                last, held = a, shingle_set(a)
            other = shingle_set(b)
            both = len(np.intersect1d(held, other, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(held) + len(other) - both) > 0)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored links (a, b) among candidate pairs.

    Texts are fetched for candidates only, by shuffle at every size (nothing bounds them); a hot pivot's rows can be split.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "candidates")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = stored(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi"), "texts")
    kind = dict(pairs.dtypes)["a"]
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return stored(rows.select("a", "b", "text_a", "text_b").mapInArrow(_linked, f"a {kind}, b {kind}").distinct(), "links")


def _similar_size(n: str, other: str) -> F.Column:
    return (100 * F.least(n, other) >= PERCENT * F.greatest(n, other))


def _apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose node and pivot p1 are in different components so far."""
    mine = rows.join(groups.select("node", F.col("component").alias("g")), "node", "left")
    both = mine.join(groups.select(F.col("node").alias("p1"), F.col("component").alias("pg")), "p1", "left")
    return both.where(F.coalesce("g", "node") != F.coalesce("pg", "p1")).drop("g", "pg")


def _mixed(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with the component g of each node."""
    rows = buckets.join(groups.withColumnRenamed("component", "g"), "node", "left").withColumn("g", F.coalesce("g", "node"))
    several = stored(rows.groupBy("bucket").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 != g1").select("bucket"), "several")
    return stored(rows.join(several, "bucket", "left_semi"), "mixed")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        size = np.array([len(e) for e in sets], np.int64)
        row = pa.array(np.repeat(np.arange(len(sets)), size))
        yield pa.RecordBatch.from_arrays([batch.column("node").take(row), batch.column("version").take(row), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "version", "n", "shingle"])


def _held(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, version (a text of the node), n (its number of shingles) and shingle for all shingles of ``nodes``."""
    kind = dict(nodes.dtypes)["node"]
    texts = docs.join(nodes.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), F.xxhash64("text").alias("version"), "text")
    return texts.dropDuplicates(["node", "version"]).mapInArrow(_shingles, f"node {kind}, version long, n long, shingle long")


def _common(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and share, the part of its shingles (of the text where it is largest) that another of ``nodes`` has too."""
    held = stored(_held(nodes, docs), "held")
    times = held.groupBy("shingle").agg(F.count("*").alias("c"), F.min(F.struct("node", "version")).alias("of"))
    own = times.where("c = 1").select("of.node", "of.version").groupBy("node", "version").agg(F.count("*").alias("own"))
    sizes = held.select("node", "version", "n").distinct()
    share = sizes.join(own, ["node", "version"], "left").select("node", (1 - F.coalesce("own", F.lit(0)) / F.col("n")).alias("share"))
    return stored(share.groupBy("node").agg(F.max("share").alias("share")), "common")


def _by_rare_shingles(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) among ``nodes`` (node, g) of different components that could be linked; none that are linked is left out.

    With shingles in order of rarity, the overlap of two sets is at most n - pos for each, pos being the place of the first
    they share; sets of n and m shingles are linked if 7 * overlap >= 3 * (n + m).  A row of the larger set probes the sizes
    that its place leaves open, and a row of the smaller is there for those that are not smaller than it.
    """
    held = stored(_held(nodes, docs), "held")
    times = stored(held.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1"), "times")
    shared = held.join(times.hint("merge"), "shingle").groupBy("node", "version").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("shared"))
    own = F.col("n") - F.size("shared")
    # From the place n / 4 on nothing can be linked any more; shingles of one set only come first and meet none.
    heads = shared.join(nodes, "node").where(own <= F.floor(F.col("n") / 4))
    heads = heads.select("node", "n", "g", own.alias("own"), F.posexplode(F.slice("shared", 1, (F.floor(F.col("n") / 4) - own + 1).cast("int"))).alias("k", "of"))
    heads = heads.select("node", "n", "g", F.col("of.shingle").alias("shingle"), (F.col("n") - F.col("own") - F.col("k")).alias("most"))
    heads = heads.withColumn("lo", F.ceil(3 * F.col("n") / 4)).withColumn("hi", F.least(F.floor(4 * F.col("n") / 3), F.floor((7 * F.col("most") - 3 * F.col("n")) / 3))).where("hi >= lo")
    size_bin = lambda n: F.floor(8 * F.log2(n)).cast("int")
    home = stored(heads.where("hi >= n").select("shingle", size_bin(F.col("n")).alias("bin"), "node", "n", "g", "hi"), "home")
    probe = stored(heads.select("shingle", F.explode(F.sequence(size_bin(F.col("lo")), size_bin(F.least("hi", "n")))).alias("bin"), "node", "n", "g", "lo", "hi"), "probe")
    # Probes of a crowded key are dealt to so many tasks, each with all of the key's homes.
    parts = probe.groupBy("shingle", "bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    parts = stored(parts, "parts")
    probe = probe.join(parts, ["shingle", "bin"], "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    home = home.join(parts, ["shingle", "bin"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    home = home.select("shingle", "bin", "part", F.col("node").alias("b"), F.col("n").alias("m"), F.col("g").alias("h"), F.col("hi").alias("to"))
    fits = "m <= n and m >= lo and m <= hi and n <= to and g != h and node != b"
    met = probe.join(home.hint("merge"), ["shingle", "bin", "part"]).where(fits)
    return met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _extended(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) with the components that ``links`` (a, b) join made one; only these are walked."""
    of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("_a", "a").alias("u"), F.coalesce("_b", "b").alias("v"))
    ends = stored(ends, "ends")
    top = stored(connected_components(ends, "u", "v"), "top").select(F.col("node").alias("component"), F.col("component").alias("top"))
    fresh = ends.select(F.col("a").alias("node"), F.col("u").alias("component")).unionByName(ends.select(F.col("b").alias("node"), F.col("v").alias("component"))).distinct()
    nodes = groups.select("node", "component").unionByName(fresh).distinct()
    return stored(nodes.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Null or wordless text: an empty set, linked with nothing, kept.  Null doc_id: component_id null, kept, linked with
    nothing.  Rows that share a doc_id count as one document, whose links are those of any of its texts.  An empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text")
    signed = stored(docs.mapInArrow(_signed, f"doc_id {kind}, n_shingles long, set_id binary, bands array<long>"), "signatures")
    full = signed.where("set_id is not null and doc_id is not null")
    classes = stored(full.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    # Texts of one id are one document: it holds the classes of its texts together.
    several = stored(full.groupBy("doc_id").agg(F.min("set_id").alias("s0"), F.max("set_id").alias("s1")).where("s0 != s1").select("doc_id"), "several")
    together = full.join(several, "doc_id").select("doc_id", "set_id").join(classes.select("set_id", "node"), "set_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    members = classes.select(F.posexplode("bands").alias("band", "bucket"), "node", "n")
    crowd = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("low"), (F.min("band") < FIRST_BANDS).alias("first")).where("size > 1")
    crowd = stored(crowd.select("bucket", F.col("low.node").alias("p1"), F.col("low.n").alias("n1"), "size", "first"), "crowd")
    buckets = stored(members.drop("band").join(crowd, "bucket"), "buckets")

    # A few bands link most of each group; then the pivots of all bands, for members that are not in their component yet.
    tried = buckets.where(F.col("node") != F.col("p1")).where(_similar_size("n", "n1"))
    links = _verified(tried.where("first").select(F.col("p1").alias("a"), F.col("node").alias("b")), docs)
    found = stored(connected_components(links.unionByName(together)), "groups")
    found = _extended(found, _verified(_apart(tried.where("not first"), found).select(F.col("p1").alias("a"), F.col("node").alias("b")), docs))
    # Buckets of two are done.  Of the rest, those that hold more than one component:
    left = buckets.where("size > 2").select("bucket", "node", "n")
    for _ in range(PIVOT_ROUNDS):
        left = _mixed(left, found)
        left = stored(left.join(_common(left.select("node"), docs), "node").where(100 * F.col("share") >= PERCENT - 1e-6), "mixed")
        best = stored(left.groupBy("bucket").agg(F.max(F.struct("share", "node", "n", "g")).alias("best")).select("bucket", F.col("best.node").alias("p2"), F.col("best.n").alias("n2"), F.col("best.g").alias("g2")), "best")
        pivots = left.join(best, "bucket").where("node != p2 and g != g2").where(_similar_size("n", "n2"))
        links = _verified(pivots.select(F.col("p2").alias("a"), F.col("node").alias("b")), docs)
        left = left.select("bucket", "node", "n")
        if links.isEmpty():
            break
        found = _extended(found, links)
    open_ = stored(_mixed(left, found).select("node", "g").distinct(), "open")
    found = _extended(found, _verified(_by_rare_shingles(open_, docs), docs))

    known = classes.select("set_id", "node").join(found, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    grouped = full.select("doc_id", "n_shingles", "set_id").join(known, "set_id").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("set_id is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


# ---- query ------------------------------------------------------------------------------------------------------


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM a WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT y.doc_id AS a, z.doc_id AS b, count(*) AS c FROM s y JOIN s z ON y.x = z.x AND y.doc_id <> z.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n y ON y.doc_id = a JOIN n z ON z.doc_id = b WHERE 100 * c >= 75 * (y.n + z.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM a UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT a.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, a.doc_id = m.c AS kept
FROM a LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
