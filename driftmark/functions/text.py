"""Words of articles: runs of letters, in lower case, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Split at everything but letters; empty parts are dropped, accents kept."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def tokenize(articles: DataFrame) -> DataFrame:
    return articles.withColumn("words", words(F.col("full_text"))).drop("full_text")


def positions(tokenized: DataFrame) -> DataFrame:
    """(article_id, issue_ts, offset, word) of each token."""
    return tokenized.select("article_id", "issue_ts", F.posexplode("words").alias("offset", "word"))
