"""What is kept of conversations: their last turns within bounds, titles, and a shelf of saved ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Turns, characters of a turn and of all turns that are kept; conversations and characters on a shelf.
TURNS, TURN_CHARS, ALL_CHARS = 29, 8_000, 48_000
SHELF, SHELF_CHARS = 10, 300_000


def trimmed(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (conv_id, turn, role, text) that stay: of users and assistants, the newest TURNS, as far as ALL_CHARS reach (one at least), from a user's on."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = turns.where("role in ('user', 'assistant') and text is not null").withColumn("text", F.substring("text", 1, TURN_CHARS)).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= TURNS)
    kept = kept.withColumn("_all", F.sum(F.length("text")).over(newest)).where((F.col("_n") == 1) | (F.col("_all") <= ALL_CHARS))
    return kept.withColumn("_from", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))).where("turn >= _from").drop("_n", "_all", "_from")


def title(first: Column) -> Column:
    """The first words of a user's first turn."""
    text = F.trim(F.regexp_replace(F.coalesce(first, F.lit("")), r"\s+", " "))
    return F.when(text == "", "Chat").when(F.length(text) > 60, F.concat(F.rtrim(F.substring(text, 1, 57)), F.lit("…"))).otherwise(text)


def saved(turns: DataFrame) -> DataFrame:
    """conv_id, title, turns and chars of each conversation of which something stays."""
    of = trimmed(turns)
    return of.groupBy("conv_id").agg(title(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))).alias("title"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def shelf(chats: DataFrame, by: list[str]) -> DataFrame:
    """The newest SHELF of ``chats`` (by, position, chars) as far as SHELF_CHARS reach, the newest in any case."""
    newest = Window.partitionBy(*by).orderBy(F.col("position").desc())
    kept = chats.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= SHELF)
    return kept.withColumn("_all", F.sum("chars").over(newest)).where((F.col("rank") == 1) | (F.col("_all") <= SHELF_CHARS)).drop("_all")
