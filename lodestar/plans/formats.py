"""Queries over tables in other formats than Parquet: each writes a given table whole to the shared folder and asks what it reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from .wider import registered

#: Nulls are written as \N, which no string may be, so that empty strings stay apart; quotes are doubled, white space at ends stays.
CSV = {
    "header": "true", "escape": '"', "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def stored(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """df written in a format and read back by its own schema, so that nothing is read twice to infer one."""
    path = tables.new_path(df.sparkSession, kind)
    tables.write(df, path, kind, **options)
    return tables.read(df.sparkSession, path, kind, None if kind == "text" else df.schema, **options)


@registered("""SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS ordered, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2""")
def format_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as CSV; the filter on priorities is applied while lines are parsed."""
    orders = stored(tables.table(spark, folder, "orders"), "csv", **CSV).where("o_orderpriority = '1-URGENT'")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return orders.groupBy("o_orderstatus", F.year("o_orderdate").alias("ordered")).agg(F.count("*").alias("n"), cents.alias("cents"))


@registered("""SELECT role, count(*) AS n, CAST(max(turn) AS BIGINT) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(DISTINCT md5(text)) AS BIGINT) AS texts
FROM conversations GROUP BY 1""")
def format_json(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as JSON lines, with the turn nested, so that texts keep line feeds and files can be split."""
    turns = tables.table(spark, folder, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("said"))
    said = stored(turns, "json").select("said.*")
    chars = F.sum(F.length("text").cast("long"))
    return said.groupBy("role").agg(
        F.count("*").alias("n"), F.max("turn").alias("last_turn"), chars.alias("chars"),
        F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("texts"),
    )


@registered("""SELECT l_returnflag, l_linenumber, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2""")
def format_orc(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as ORC; the filter and the columns reach the scan."""
    lines = stored(tables.table(spark, folder, "lineitem"), "orc").where("l_quantity > 45")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return lines.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), cents.alias("cents"))


@registered("SELECT url, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1")
def format_text(spark: SparkSession, folder: str) -> DataFrame:
    """Urls as lines of text, which has no null: those rows are left out."""
    urls = tables.table(spark, folder, "pages").select(F.col("url").alias("value")).where("value IS NOT NULL")
    return stored(urls, "text").groupBy(F.col("value").alias("url")).agg(F.count("*").alias("n"))
