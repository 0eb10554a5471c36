"""Inputs: tables by name, page dumps, recorded replies, JSON runs; outputs: reports and recordings.

A connector to a service is a recorded table here: requests join recordings by key, and a miss is an error row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLES = "article_id long, lang string, title string, revid long, wikitext string"
RECORDED = "key string, status int, contentType string, body string, ms long"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """A page dump as JSON lines."""
    return spark.read.schema(ARTICLES).json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every file below ``path``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """Recorded replies, one JSON object a file (compressed or not)."""
    return spark.read.schema(RECORDED).option("multiLine", True).json(path)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def article(pages: DataFrame, lang: str, title: str) -> DataFrame:
    """One article by language and title; the filter reaches the scan."""
    return pages.where((F.col("lang") == lang) & (F.col("title") == title))


def link_translations(links: DataFrame, titles: DataFrame, aliases: DataFrame, langs: list[str]) -> DataFrame:
    """title, lang, foreign for the wanted languages, keyed by the title asked for, aliases followed."""
    from ..operators.joins import alias_chain, small

    asked = titles.select(F.trim("title").alias("title")).where("title <> ''").distinct()
    told = links.where(F.col("lang").isin(*langs)).select(F.col("title").alias("resolved"), "lang", F.col("foreign_title").alias("foreign"))
    return small(alias_chain(asked, aliases, "title")).join(told, "resolved").select("title", "lang", "foreign")


def write_report(df: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_recordings(df: DataFrame, path: str) -> None:
    """Replies (host and the columns of ``RECORDED``) as compressed JSON, a folder a host."""
    df.write.mode("append").partitionBy("host").option("compression", "gzip").json(path)
