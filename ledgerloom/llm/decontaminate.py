"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

Words are runs of a-z (A-Z lower-cased), digits and everything outside ASCII.  A window is WINDOW consecutive words of
a benchmark item (all of a shorter item); a document word inside an occurrence of a window is hit.

1. Items are cut into blocks of at most BLOCK words, so that each window is in one; equal blocks are one, with all their items.
   So a posting meets few places of a word, and a text that repeats itself, few blocks, however long both are.
2. The corpus frequency of every benchmark word is counted (combined before the shuffle).
3. Each window is represented by its two rarest words; only words so chosen get postings (document, position), stored.
4. Postings are shifted by the word's place in its block, so that a list entry says where in the document the block would
   begin; the lists of a block meet in (document, block, offset).  An offset survives if two chosen words agree on it
   (one for blocks of one word).  This is necessary for any of its windows.
5. The survivors of a document go to its row, each block's words once with its offsets, and are compared word by word: exact.

``proximity`` returns near matches from such postings: chosen words about as far apart as in the item.  They are kept apart
from the contract's exact columns.

The joins with benchmark words have no hint: Spark broadcasts them by their measured size and else shuffles, with skewed
words split.  Survivors grow with the corpus, so that join always shuffles by document, at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .cluster import stored, table

WINDOW = 10
#: Windows of a block, and its words.
STEP = 31
BLOCK = STEP + WINDOW - 1
#: Chosen words of a near match are so many words closer or further apart than in their item, at most.
SLACK = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, before A-Z are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(word: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` is faster and the same for words within ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _split(text: Column) -> Column:
    """Words in order; the first or the last may be an empty text, which is no word."""
    return F.split(text, _GAP)


def _n_words(words: Column) -> Column:
    ends = (F.element_at(words, 1) == "").cast("int") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    return F.coalesce(F.size(words) - ends, F.lit(0)).cast("long")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (a key), item_id and words of each item with a word; rows without an id are left out."""
    words = F.filter(_split(F.translate("text", _UPPER, _LOWER)), lambda w: w != "")
    return benchmark.where("item_id is not null and text is not null").select("item_id", words.alias("words")).where(F.size("words") > 0).distinct().withColumn("item", F.xxhash64("item_id", "words"))


def _blocks(items: DataFrame) -> DataFrame:
    """item (a key), words and ids (of the items that have it) of each different block."""
    windows = F.greatest(F.size("words") - WINDOW + 1, F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), F.floor((windows - 1) / STEP).cast("int")), lambda k: F.slice("words", k * STEP + 1, BLOCK))
    return items.select("item_id", F.explode(cut).alias("words")).groupBy("words").agg(F.collect_set("item_id").alias("ids")).withColumn("item", F.xxhash64("words"))


def _anchors(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """item, size, p and term: the places of the two rarest words of each window."""
    words = items.select("item", F.size("words").alias("size"), F.posexplode("words").alias("p", "term"))
    rated = words.join(frequency, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    last = F.greatest(F.col("size") - WINDOW, F.lit(0))
    first = F.greatest(F.col("p") - WINDOW + 1, F.lit(0))
    windows = rated.withColumn("start", F.explode(F.sequence(first, F.least("p", last))))
    order = Window.partitionBy("item", "start").orderBy("count", "term", "p")
    return windows.withColumn("rank", F.row_number().over(order)).where("rank <= 2").select("item", "size", "p", "term").distinct()


def _windows_at(words: Column, survivors: Column) -> Column:
    """Of each surviving block, its items' ids and the windows that occur at one of its offsets, each as its first word * 16 + its size.

    ``words`` is bound as the element of an array of one.  Named in the inner functions, Spark could put there the
    expression it comes from, and would then split a text again for every word that is compared.
    """

    def one(text: Column, a: Column, shift: Column) -> Column:
        same = F.transform(a["words"], lambda w, p: F.coalesce(F.get(text, p + shift) == w, F.lit(False)))
        size = F.least(F.size(a["words"]), F.lit(WINDOW))
        starts = F.sequence(F.lit(0), F.size(a["words"]) - size)
        hit = F.flatten(F.transform(F.array(same), lambda s: F.filter(starts, lambda i: F.forall(F.slice(s, i + 1, size), lambda x: x))))
        return F.transform(hit, lambda i: (i + shift).cast("long") * 16 + size)

    found = lambda text, a: F.struct(a["ids"].alias("ids"), F.array_distinct(F.flatten(F.transform(a["shifts"], lambda shift: one(text, a, shift)))).alias("windows"))
    return F.get(F.transform(F.array(words), lambda text: F.filter(F.transform(survivors, lambda a: found(text, a)), lambda f: F.size(f["windows"]) > 0)), F.lit(0))


def _postings(tokens: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen words of items, and where these are in documents."""
    vocabulary = stored(items.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    frequency = stored(tokens.select("term").join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("count")), "frequency")
    anchors = stored(_anchors(items, frequency), "anchors")
    return anchors, stored(tokens.join(anchors.select("term").distinct(), "term").select("term", "doc_id", "version", "pos"), "postings")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated for every row.

    A null or empty text has no words; a null doc_id is kept and judged like others.  Repeated rows get equal results.  An
    empty benchmark or item without words hits nothing; an empty table gives no rows.  Columns of ``docs`` with the names
    of results are replaced; other columns stay, but for names that begin with two underscores, which are used here.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kept = [c for c in docs.columns if c not in made and not c.startswith("__")]
    rows = docs.select(*kept, F.hash("text").alias("__version"))
    items = stored(_blocks(benchmark_items(benchmark)), "items")
    tokens = rows.select("doc_id", F.col("__version").alias("version"), F.posexplode(_split(F.col("text"))).alias("pos", "word")).withColumn("term", _lower(F.col("word"))).drop("word")
    anchors, index = _postings(tokens, items)

    shifted = index.join(anchors, "term").select("doc_id", "version", "item", (F.col("pos") - F.col("p")).alias("shift"), "p", "size")
    places = shifted.groupBy("doc_id", "version", "item", "shift").agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.max("size").alias("size"))
    agreed = places.where("p0 < p1 or size = 1").groupBy("doc_id", "version", "item").agg(F.collect_list("shift").alias("shifts")).join(items, "item")
    survivors = agreed.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__of")).agg(F.collect_list(F.struct("ids", "words", "shifts")).alias("__survivors"))
    survivors = stored(survivors, "survivors")

    joined = rows.join(survivors.hint("merge"), rows["doc_id"].eqNullSafe(survivors["__id"]) & (rows["__version"] == survivors["__of"]), "left")
    lowered = _split(F.when(F.col("__survivors").isNotNull(), F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text")))
    judged = joined.withColumn("__words", lowered).withColumn("n_words", _n_words(F.col("__words")))
    judged = judged.withColumn("__at", F.when(F.col("__survivors").isNotNull(), _windows_at(F.col("__words"), F.col("__survivors"))))
    windows = F.array_distinct(F.flatten(F.transform("__at", lambda f: f["windows"])))
    hit = F.array_distinct(F.flatten(F.transform(windows, lambda w: F.sequence(F.shiftright(w, 4), F.shiftright(w, 4) + w % 16 - 1))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("__at", lambda f: F.transform(f["ids"], lambda i: i.cast("string"))))))
    none = F.array().cast("array<string>")
    judged = judged.withColumn("n_hit", F.coalesce(F.size(hit), F.lit(0)).cast("long")).withColumn("__ids", F.coalesce(ids, none))
    return judged.select(*kept, "n_words", "n_hit", F.size("__ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "__ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def proximity(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first, last and distance where two chosen words of an item are close to each other in a text as in the item.

    The words' places in the item are less than WINDOW apart; first and last are their places in the text (from 0), in either
    order; distance is by how many words they are closer or further apart than in the item, SLACK at most (0 in exact
    copies).  A null doc_id is judged like others, rows with the same id and text count once, and an item of one word has
    no pairs.
    """
    rows = docs.select("doc_id", "text").withColumn("version", F.xxhash64("text")).dropDuplicates(["doc_id", "version"])
    items = stored(benchmark_items(benchmark), "items")
    words = F.filter(_split(F.col("text")), lambda w: w != "")
    tokens = rows.select("doc_id", "version", F.posexplode(words).alias("pos", "word")).withColumn("term", _lower(F.col("word"))).drop("word")
    anchors, index = _postings(tokens, items)
    ahead = anchors.select("item", "p", F.col("term").alias("term_p"), F.explode(F.sequence(F.col("p") + 1, F.col("p") + WINDOW - 1)).alias("q"))
    pairs = stored(ahead.join(anchors.select("item", F.col("p").alias("q"), F.col("term").alias("term_q")), ["item", "q"]), "pairs")
    # Offsets at most SLACK apart are in the same bin or in neighbours.
    placed = lambda term, place: index.join(pairs.withColumnRenamed(term, "term"), "term").select("doc_id", "version", "item", "p", "q", "pos", (F.col("pos") - F.col(place)).alias("shift")).withColumn("bin", F.floor(F.col("shift") / (SLACK + 1)))
    left = placed("term_p", "p").withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    right = placed("term_q", "q")
    right = right.select(*(F.col(c).alias(f"_{c}") for c in right.columns))
    met = left.join(right, [left[c].eqNullSafe(right[f"_{c}"]) for c in ("doc_id", "version", "item", "p", "q", "bin")])
    near = met.withColumn("distance", F.abs(F.col("_shift") - F.col("shift"))).where((F.col("distance") <= SLACK) & (F.col("pos") != F.col("_pos")))
    near = near.join(items.select("item", "item_id"), "item").select("doc_id", "version", "item_id", F.least("pos", "_pos").alias("first"), F.greatest("pos", "_pos").alias("last"), "distance")
    return near.groupBy("doc_id", "version", "item_id", "first", "last").agg(F.min("distance").alias("distance")).drop("version")


# ---- query ------------------------------------------------------------------------------------------------------


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs.select("doc_id", "text"), benchmark).drop("text")


SQL = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM v),
d AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM a, s WHERE len(w) >= size)),
o AS (SELECT DISTINCT doc_id, item_id, i, size FROM d JOIN v USING (size, words)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM o) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM a LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""
