"""Background model: the unigram distribution of frequent words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import running_total

#: Counts that a task holds until they are added up.
ADDED_ROWS = 2_000_000


def word_counts(tokenized: DataFrame) -> DataFrame:
    return tokenized.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def background_model(tokenized: DataFrame, min_count: int = 30) -> DataFrame:
    """(word, cnt, total, p): words with at least min_count occurrences; total is over these words alone."""
    return model_of_counts(word_counts(tokenized), min_count)


def model_of_counts(counts: DataFrame, min_count: int = 30) -> DataFrame:
    """The model of (word, cnt), each word once."""
    kept = counts.where(F.col("cnt") >= min_count)
    total = kept.agg(F.sum("cnt").alias("total"))
    return kept.crossJoin(F.broadcast(total)).select("word", "cnt", "total", (F.col("cnt") / F.col("total")).alias("p"))  # one row


def counted_words(docs: DataFrame) -> DataFrame:
    """word_counts of terms.counted rows, added up in the task first."""

    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(["word"], use_threads=False).aggregate([("cnt", "sum")]).select(["word", "cnt_sum"]).rename_columns(["word", "cnt"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            some = pa.table([batch.column("words").flatten(), batch.column("cnts").flatten().cast(pa.int64())], names=["word", "cnt"])
            held, n = [*held, added([some])], n + some.num_rows
            if n > ADDED_ROWS:
                held = [added(held)]
                # what is held grows with the words, and is given on before it is large
                n = held[0].num_rows
                if n > ADDED_ROWS // 2:
                    yield from held[0].to_batches(10_000)
                    held, n = [], 0
        if held:
            yield from added(held).to_batches(10_000)

    return docs.select("words", "cnts").mapInArrow(count, "word string, cnt long").groupBy("word").agg(F.sum("cnt").alias("cnt"))


def count_histogram(tokenized: DataFrame, least: int = 1, most: int = 49) -> DataFrame:
    """(cnt, n_words): how many words occur cnt times."""
    return word_counts(tokenized).where(F.col("cnt").between(least, most)).groupBy("cnt").agg(F.count(F.lit(1)).alias("n_words"))


def lexicon(background: DataFrame) -> DataFrame:
    """(word, word_id, p): ids by the order of words."""
    return running_total(background.select("word", "p"), ["word"], F.lit(1), "word_id").select("word", "word_id", "p")
