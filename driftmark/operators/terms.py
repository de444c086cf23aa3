"""Documents of periods as term counts, and the chronological word stream."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import running_total
from ..functions.periods import assign
from ..functions.text import words as text_words
from ..ship import ship_package


COUNTED = "doc_id long, issue_ts timestamp, n long, words array<string>, cnts array<int>"


def counted(tokenized: DataFrame) -> DataFrame:
    """COUNTED: a row per article with its distinct words and how often it has each, counted where the article is, and n, the number of its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
            found = lists.flatten().dictionary_encode()
            width = max(1, len(found.dictionary))
            row = np.repeat(np.arange(len(sizes)), sizes)
            keys, cnt = np.unique(row * width + found.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys // width, minlength=len(sizes)))]), pa.int32())
            words = pa.ListArray.from_arrays(ends, found.dictionary.take(pa.array(keys % width)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("article_id"), batch.column("issue_ts"), pa.array(sizes, pa.int64()), words, pa.ListArray.from_arrays(ends, pa.array(cnt, pa.int32()))], names=["doc_id", "issue_ts", "n", "words", "cnts"])

    ship_package(tokenized.sparkSession)
    return tokenized.select("article_id", "issue_ts", "words").mapInArrow(count, COUNTED)


def counted_texts(articles: DataFrame) -> DataFrame:
    """counted of articles that are not tokenised yet (.., full_text): words are found and counted where the texts are, by bytes; texts with characters beyond U+023F are split by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("plain")).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            edges = [0, *np.unique(np.searchsorted(sizes, np.arange(COUNT_BYTES, sizes[-1] if len(sizes) else 0, COUNT_BYTES), side="right")), len(sizes)]
            for a, b in itertools.pairwise(edges):
                if b > a:
                    yield stretch(batch.slice(a, b - a))

    def stretch(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, lists = batch.column("plain").fill_null("").cast(pa.large_binary()), batch.column("words")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        words, text, other = plain_words(np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0])
        if other.any():
            raise ValueError("a text that was taken for plain has other characters")
        split = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        row = np.concatenate([text, np.repeat(np.arange(len(split)), split)])
        found = pa.chunked_array([words, lists.flatten().cast(pa.string())]).combine_chunks().dictionary_encode()
        width = max(1, len(found.dictionary))
        keys, cnt = np.unique(row * width + found.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys // width, minlength=len(split)))]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, found.dictionary.take(pa.array(keys % width))), pa.ListArray.from_arrays(ends, pa.array(cnt, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("article_id"), batch.column("issue_ts"), pa.array(np.bincount(row, minlength=len(split)), pa.int64()), *lists], names=["doc_id", "issue_ts", "n", "words", "cnts"])

    ship_package(articles.sparkSession)
    text = F.col("full_text").cast("string")
    # lower case makes the bytes of three characters below U+0240 more or less
    plain = F.coalesce(~text.rlike("[^\\x{0}-\\x{23F}]|[\\x{130}\\x{23A}\\x{23E}]"), F.lit(False))
    return articles.select("article_id", "issue_ts", F.when(plain, text).alias("plain"), F.when(~plain, text_words(text)).alias("words")).mapInArrow(count, COUNTED)


#: Bytes of text whose words are counted at a time.
COUNT_BYTES = 4_000_000
#: Counts that a task holds until they are added up.
COUNT_ROWS = 1_500_000
#: Up to here a character has two bytes at most, and of these all but three become one of as many bytes in lower case.
PLAIN = 0x240


def plain_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below PLAIN whether it is a letter, and its lower case."""
    return np.array([chr(c).isalpha() for c in range(PLAIN)]), np.array([ord(chr(c).lower()[0]) for c in range(PLAIN)])


def plain_words(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts in UTF-8 as functions.text.words gives them, the text of each, and which texts have other characters than plain ones: these have no words here.

    Text i is raw[at[i]:at[i + 1]].
    """
    letter, lower = plain_tables()
    lead, inner = (raw >= 0xC2) & (raw <= 0xC8), (raw & 0xC0) == 0x80
    begin = np.zeros(len(raw) + 1, bool)
    begin[at] = True
    follows = np.r_[False, lead[:-1]][: len(raw)] & ~begin[:-1]
    # what is not whole, and the characters that lower case makes longer or shorter
    odd = (raw > 0xC8) | (raw == 0xC0) | (raw == 0xC1) | (inner != follows) | (lead & begin[1:])
    first = np.flatnonzero(lead[:-1] & follows[1:]) if len(raw) else np.zeros(0, np.int64)
    code = ((raw[first] & 0x1F).astype(np.int64) << 6) | (raw[first + 1] & 0x3F)
    odd[first[np.isin(code, (0x130, 0x23A, 0x23E))]] = True
    total = np.r_[0, np.cumsum(odd)]
    other = total[at[1:]] > total[at[:-1]]
    text = lower[np.minimum(raw, 0x7F)].astype(np.uint8)
    inside = letter[np.minimum(raw, 0x7F)] & (raw < 0x80)
    low, known = lower[code], letter[code]
    text[first], text[first + 1] = 0xC0 | (low >> 6), 0x80 | (low & 0x3F)
    inside[first], inside[first + 1] = known, known
    if other.any():
        inside &= ~np.repeat(other, np.diff(at))
    starts = inside & (~np.r_[False, inside[:-1]][: len(raw)] | begin[:-1])
    start = np.flatnonzero(starts)
    # without what is between them words lie side by side
    ends = np.r_[np.cumsum(inside)[start] - 1, inside.sum()].astype(np.int32) if len(start) else np.zeros(1, np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.tobytes()), pa.py_buffer(text[inside].tobytes()))
    return found, np.searchsorted(at, start, side="right") - 1, other


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, word, cnt) of texts (key long, full_text): how often the texts of a key have a word.

    Words are counted where their texts are, a stretch of texts at a time, and added up in the task; texts with characters beyond U+023F are split by Spark.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("full_text")).fill_null(0).to_numpy().cumsum()
            edges = [0, *np.unique(np.searchsorted(sizes, np.arange(COUNT_BYTES, sizes[-1] if len(sizes) else 0, COUNT_BYTES), side="right")), len(sizes)]
            for a, b in itertools.pairwise(edges):
                if b > a:
                    some, rest = stretch(batch.slice(a, b - a))
                    held, n = [*held, some], n + len(some)
                    yield pa.RecordBatch.from_arrays([rest.column("key"), pa.nulls(len(rest), pa.string()), pa.nulls(len(rest), pa.int64()), rest.column("full_text").cast(pa.string())], names=names)
                    if n > COUNT_ROWS:
                        yield from added(held)
                        held, n = [], 0
        if held:
            yield from added(held)

    names = ["key", "word", "cnt", "rest"]

    def added(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held).group_by(["key", "word"], use_threads=False).aggregate([("cnt", "sum")]).select(["key", "word", "cnt_sum"])
        yield from table.append_column("rest", pa.nulls(len(table), pa.string())).rename_columns(names).to_batches(10_000)

    def stretch(batch: pa.RecordBatch) -> tuple[pa.Table, pa.RecordBatch]:
        column, keys = batch.column("full_text").fill_null("").cast(pa.large_binary()), batch.column("key").to_numpy()
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        words, text, other = plain_words(raw, at - at[0])
        coded = words.dictionary_encode()
        each, key = np.unique(keys, return_inverse=True)
        width = max(1, len(coded.dictionary))
        pairs, cnt = np.unique(key[text] * width + coded.indices.to_numpy(), return_counts=True)
        return pa.table([pa.array(each[pairs // width], pa.int64()), coded.dictionary.take(pa.array(pairs % width)), pa.array(cnt, pa.int64())], names=names[:3]), batch.filter(pa.array(other))

    ship_package(texts.sparkSession)
    found = texts.select("key", F.col("full_text").cast("string").alias("full_text")).where("key is not null").mapInArrow(count, "key long, word string, cnt long, rest string")
    one = lambda w, n: F.struct(w.alias("word"), n.alias("cnt"))
    split = F.when(F.col("rest").isNull(), F.array(one(F.col("word"), F.col("cnt")))).otherwise(F.transform(text_words(F.col("rest")), lambda w: one(w, F.lit(1).cast("long"))))
    return found.select("key", F.explode(split).alias("x")).groupBy("key", F.col("x.word").alias("word")).agg(F.sum("x.cnt").alias("cnt"))


def doc_terms(tokenized: DataFrame, background: DataFrame, periods: DataFrame, min_tokens: int = 50, min_distinct: int = 50) -> DataFrame:
    """(period_id, doc_id, word, cnt): articles of at least min_tokens tokens, words of the background model, more than min_distinct of them."""
    return terms_of(counted(tokenized), background, periods, min_tokens, min_distinct)


def terms_of(docs: DataFrame, background: DataFrame, periods: DataFrame, min_tokens: int = 50, min_distinct: int = 50) -> DataFrame:
    """doc_terms of COUNTED rows."""
    counts = docs.where(F.col("n") >= min_tokens).select("doc_id", "issue_ts", F.explode(F.arrays_zip("words", "cnts")).alias("x")).select("doc_id", "issue_ts", F.col("x.words").alias("word"), F.col("x.cnts").cast("long").alias("cnt"))
    # an article that has several rows is one document; dealt by document, counting and the window need no further shuffle
    known = counts.join(background.select("word"), "word", "left_semi").repartition("doc_id").groupBy("doc_id", "issue_ts", "word").agg(F.sum("cnt").alias("cnt"))
    distinct = Window.partitionBy("doc_id")
    rich = known.withColumn("distinct", F.count(F.lit(1)).over(distinct)).where(F.col("distinct") > min_distinct)
    return assign(rich, periods).select("period_id", "doc_id", "word", "cnt")


def articles_per_period(articles: DataFrame, periods: DataFrame) -> DataFrame:
    return assign(articles, periods).groupBy("period_id").agg(F.count(F.lit(1)).alias("n_articles"))


def period_chunks(articles: DataFrame, n: int) -> DataFrame:
    """(article_id, chunk): n chunks of nearly equal size in the order of article_id, without loss; the first ones have one more where it doesn't come out even."""
    ranked = running_total(articles.select("article_id"), ["article_id"], F.lit(1), "rank")
    size, more = divmod(articles.count(), n)
    # the first `more` chunks have size + 1 articles
    late = more + 1 + F.floor((F.col("rank") - more * (size + 1)) / max(size, 1))
    chunk = F.when(F.col("rank") < more * (size + 1), 1 + F.floor(F.col("rank") / (size + 1))).otherwise(late)
    return ranked.select("article_id", chunk.cast("int").alias("chunk"))


def word_stream(tokenized: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(pos, word_id, ts): known words in the order of dates, articles and offsets.

    Articles are ordered by ranges (see running_total); a word's place is its article's offset plus its rank in the article.
    """
    known = tokenized.select("article_id", "issue_ts", F.posexplode("words").alias("offset", "word")).join(lexicon.select("word", "word_id"), "word")
    sizes = known.groupBy("article_id", "issue_ts").agg(F.count(F.lit(1)).alias("n"))
    starts = running_total(sizes, ["issue_ts", "article_id"], F.col("n"), "before").select("article_id", F.col("before").alias("start"))
    rank = F.row_number().over(Window.partitionBy("article_id").orderBy("offset")) - 1
    return known.join(starts, "article_id").select((F.col("start") + rank).alias("pos"), "word_id", F.col("issue_ts").alias("ts"))
