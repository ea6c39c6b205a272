"""A training corpus from documents: five stages, each written to the shared folder and read again by the next.

1. quality: documents that the line model rejects (score below 0.3) go;
2. near_dedup: of each group of near duplicates the document with the smallest id stays, and of rows with the same id (or
   none) and the same text one row, which stage 3 would else cut out of each other;
3. substring_dedup: passages of 35 words or more that occur again anywhere are cut out of all texts (a text may end up
   empty; its row stays);
4. decontamination: documents with a window of a benchmark item go;
5. sentencepiece: ids of what is left.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whatever else ``docs`` has.  A null
text counts as an empty one: the quality model judges it like a text without lines, and what is left of it stays null.
Null ids are no group: such rows are judged and cut like others and merged only if their texts are equal.  Empty tables
pass through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, near_dedup, quality_crf, sentencepiece_codec, substring_dedup
from ledgerloom.llm.cluster import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Texts are changed and rows dropped by models and by hashes of word sequences: no SQL.
ORACLE_SQL = None


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids``; a null id matches a null."""
    wanted = ids.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the line model accepts.  Repeated rows share a verdict; without labels of both kinds all stay."""
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.accepted(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, once for each of its texts; of rows with no id, one for each text."""
    return _only(docs.select(*COLUMNS), near_dedup.near_duplicates(docs).where("kept")).dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with repeated passages cut out and n_chars to match; texts that lose nothing stay as they are."""
    return substring_dedup.without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a window of a benchmark item; all of them if the benchmark is empty.  Repeated rows share a verdict."""
    judged = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and exact of each row; none for an empty text."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
