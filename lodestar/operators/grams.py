"""Shared word n-grams of two tables: which documents have passages of which reference items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reference n-grams that are sent to all tasks at most, and tasks that share a frequent one beyond that.
SENT_GRAMS, SALTS = 500_000, 16


def grams(texts: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, gram): every n-gram of lower-case words of a-z and 0-9; null and short texts have none."""
    words = F.filter(F.split(F.lower(text_col), r"[^a-z0-9]+"), lambda w: w != "")
    own = texts.select(F.col(id_col).alias("id"), words.alias("w")).where(F.size("w") >= n)
    places = F.sequence(F.lit(1), F.size("w") - (n - 1))
    return own.select("id", F.explode(F.transform(places, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("gram"))


def overlap(documents: DataFrame, reference: DataFrame, doc_col: str, item_col: str, text_col: str = "text", n: int = 8, sent_grams: int = SENT_GRAMS) -> DataFrame:
    """(doc, item, grams): how many different n-grams each document shares with each reference item.

    The reference's distinct n-grams are an index. Up to sent_grams of them it goes to the tasks, and documents are
    not shuffled; a larger one is joined by hash, dealt over SALTS tasks for each n-gram, so that one in very many
    documents is no task's alone. Only n-grams that the index holds leave a document's task in the first case.
    """
    index = grams(reference, item_col, text_col, n).distinct().select(F.col("id").alias("item"), "gram", F.xxhash64("gram").alias("h"))
    own = grams(documents, doc_col, text_col, n).select(F.col("id").alias("doc"), F.col("gram").alias("own"), F.xxhash64("gram").alias("own_h"))
    same = (F.col("h") == F.col("own_h")) & (F.col("gram") == F.col("own"))
    if index.count() <= sent_grams:
        index = F.broadcast(index)
    else:
        index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("own_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
        same &= F.col("salt") == F.col("own_salt")
    return own.join(index, same).select("doc", "item", "h", "gram").distinct().groupBy("doc", "item").agg(F.count("*").alias("grams"))
