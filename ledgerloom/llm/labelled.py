"""Labelled rows for the classifiers: which rows may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def held_out(doc_id: Column) -> Column:
    """Every fifth document by crc32 of its id as text is kept out of all training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text and label of at most ``limit`` labelled rows that aren't held out, half of them of each label where there are as many.

    A label's rows are those with the smallest hash of the id; what one label lacks is filled up with the other, so a rare
    label is taken whole.  Rows with a null label or id are left out, several labels of one document count as their
    maximum, and of rows that share an id the one with the least text is taken.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("hash", F.xxhash64("doc_id"))
    )
    first = lambda value: known.where((F.col("label") != 0) == value).orderBy("hash", "doc_id").limit(limit)
    both = first(True).unionByName(first(False)).withColumn("turn", F.row_number().over(Window.partitionBy(F.col("label") != 0).orderBy("hash", "doc_id")))
    taken = both.orderBy("turn", "label", "doc_id").limit(limit).select("doc_id", "label")
    return docs.select("doc_id", "text").join(taken, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
