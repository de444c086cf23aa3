"""Reports on themes. theme_words: (theme_id, word, p); theme_docs: (theme_id, doc_id, title, pi)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, value: str, tie: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc(value), tie)))


def top_words(theme_words: DataFrame, k: int, min_chars: int = 4) -> DataFrame:
    """The k + 1 likeliest words of at least min_chars letters; the one too many is part of the report's definition."""
    return ranked(theme_words.where(F.length("word") >= min_chars), "p", "word").where(F.col("rank") <= k + 1).select("theme_id", "rank", "word", "p")


def labels(theme_words: DataFrame, k: int = 3, min_chars: int = 5) -> DataFrame:
    """(theme_id, label): up to k + 1 words of more than min_chars letters, each followed by a space."""
    top = top_words(theme_words, k, min_chars + 1)
    return top.groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w")).select("theme_id", F.concat(F.array_join(F.transform("w", lambda x: x["word"]), " "), F.lit(" ")).alias("label"))


def titles(theme_docs: DataFrame, n: int = 3) -> DataFrame:
    return ranked(theme_docs, "pi", "doc_id").where(F.col("rank") <= n).select("theme_id", "rank", "title", "pi")


def features(theme_words: DataFrame, background: DataFrame, epsilon: float, k: int) -> DataFrame:
    """The k words with the greatest p2 * ln(p2 / p1), p1 the smoothed background; what is missing is filled with NOWORDFOUND."""
    size = background.agg(F.count(F.lit(1)).alias("v"))
    known = theme_words.join(background.select("word", F.col("p").alias("bg")), "word", "left").crossJoin(F.broadcast(size))
    smooth = (F.coalesce("bg", F.lit(0.0)) + epsilon) / (1 + F.col("v") * epsilon)
    scored = known.where("p > 0").withColumn("value", F.round(F.col("p") * F.ln(F.col("p") / smooth), 9))
    best = ranked(scored, "value", "word").where(F.col("rank") <= k).select("theme_id", "rank", "word", "value")
    slots = theme_words.select("theme_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return slots.join(best, ["theme_id", "rank"], "left").select("theme_id", "rank", F.coalesce("word", F.lit("NOWORDFOUND")).alias("word"), "value")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "theme_id").limit(k)


def target_words(theme_words: DataFrame, wanted: list[str]) -> DataFrame:
    return theme_words.where(F.col("word").isin(wanted))


def report(scores: DataFrame, theme_words: DataFrame, theme_docs: DataFrame, words: int = 12, n_titles: int = 3) -> DataFrame:
    """(theme_id, score, titles, words)."""
    ordered = lambda df, c: df.groupBy("theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]).alias(f"{c}s"))
    return scores.join(ordered(titles(theme_docs, n_titles), "title"), "theme_id", "left").join(ordered(top_words(theme_words, words), "word"), "theme_id", "left")
