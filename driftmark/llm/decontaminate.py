"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

1. The benchmark's windows (13 consecutive words; a shorter item is one window) and the document frequency of their terms.
2. Each window names its rarest terms. The index holds the postings (term, document, positions) of these terms, in the shared folder.
3. Offset-adjusted lists are intersected: a posting at position p of a term at place o of an item proposes the alignment p - o;
   an alignment is a candidate for a window if all of the window's rarest terms propose it.
4. Candidates meet their document once more, and the words at each are compared with the whole window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Everything ASCII that is neither a digit nor a letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
RAREST = 3
#: Benchmark words up to which their windows are broadcast (some 100 bytes a word at most).
BROADCAST_WORDS = 500_000


def word_list(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def bounded(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_words, ids) of each different list of words: its digest, and the item_ids that have it (structs, so that a null one counts)."""
    rows = benchmark.select(F.struct("item_id").alias("id"), word_list(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    item = F.unhex(F.sha2(F.array_join("item_words", " "), 256)).alias("item")
    return rows.groupBy(item).agg(F.first("item_words").alias("item_words"), F.collect_set("id").alias("ids"))


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """(item, begin, words) of each window; an item of fewer words is one window."""
    begins = F.explode(F.sequence(F.lit(0), F.greatest(F.size("item_words") - size, F.lit(0))))
    return items.select("item", "item_words", begins.alias("begin")).select("item", "begin", F.slice("item_words", F.col("begin") + 1, size).alias("words"))


def terms_of(docs: DataFrame) -> DataFrame:
    return docs.select("row_id", F.posexplode("words").alias("pos", "term"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Exact matches (doc_id, item_id, begin, at, length): the item's window from `begin` stands in the document at word `at`.

    docs: doc_id (unique, not null), text. benchmark: item_id (may repeat or be null), text.
    """
    return _matches(docs.select(F.col("doc_id").alias("row_id"), "text"), benchmark, size, rarest, Scratch(docs.sparkSession, "phrases"))[0].select(F.col("row_id").alias("doc_id"), "item_id", "begin", "at", "length")


def proximity_matches(docs: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(doc_id, at): each position where an occurrence of the first term has every other term at most `within` words away.

    The postings of the named terms alone are kept; the lists are intersected from the first term by bucketed distance, without
    pairing all positions of a document: for each term the nearest posting before and after is carried along by a window.
    Repeated terms count once; no terms give no rows.
    """
    terms = list(dict.fromkeys(terms))
    rows = docs.select(F.col("doc_id").alias("row_id"), word_list(F.col("text")).alias("words"))
    found = terms_of(rows).where(F.col("term").isin(terms))
    before, after = Window.partitionBy("row_id").orderBy("pos"), Window.partitionBy("row_id").orderBy(F.desc("pos"))
    near = F.lit(True)
    for i, term in enumerate(terms[1:]):
        here = F.when(F.col("term") == term, F.col("pos"))
        found = found.withColumn(f"b{i}", F.last(here, True).over(before)).withColumn(f"a{i}", F.last(here, True).over(after))
        near &= F.coalesce(F.col("pos") - F.col(f"b{i}") <= within, F.lit(False)) | F.coalesce(F.col(f"a{i}") - F.col("pos") <= within, F.lit(False))
    return found.where((F.col("term") == (terms[0] if terms else None)) & near).select(F.col("row_id").alias("doc_id"), F.col("pos").alias("at"))


def _matches(docs: DataFrame, benchmark: DataFrame, size: int, rarest: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The matches by row_id, and the documents with their words joined with their candidates."""
    # items go by their words: an item_id can be null or stand for several texts
    items = scratch.write(benchmark_items(benchmark), "items")
    windows = scratch.write(benchmark_windows(items, size), "windows")
    ids = items.select("item", "ids")
    total = (windows.agg(F.sum(F.size("words")).alias("n")).first().n or 0) + (ids.agg(F.sum(F.size("ids")).alias("n")).first().n or 0)
    small = total <= BROADCAST_WORDS
    text = F.col("row.text" if "row" in docs.columns else "text")
    words = docs.select("row_id", word_list(text).alias("words"))
    # document frequency of the benchmark's terms; each document counts a term once
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    each = docs.select("row_id", F.explode(F.array_distinct(word_list(text))).alias("term"))
    frequency = scratch.write(each.join(bounded(vocabulary, small), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequency")
    placed = windows.select("item", "begin", F.posexplode("words").alias("o", "term"))
    ranked = placed.join(frequency, "term", "left").select("item", "begin", "term", (F.col("begin") + F.col("o")).alias("place"), F.coalesce("df", F.lit(0)).alias("df"))
    # of a term that a window has twice, one place is enough to propose an alignment
    first = Window.partitionBy("item", "begin", "term").orderBy("place")
    best = Window.partitionBy("item", "begin").orderBy("df", "term")
    once = ranked.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("n", F.row_number().over(best)).where(F.col("n") <= rarest)
    probes = scratch.write(once.groupBy("item", "begin").agg(F.collect_set(F.struct("place", "term")).alias("probe"), F.min("df").alias("least")).where("least > 0"), "probes")
    seeds = probes.select("item", F.explode("probe").alias("p")).select("item", "p.place", "p.term").distinct()
    index = terms_of(words).join(bounded(seeds.select("term").distinct(), small), "term")
    postings = scratch.write(index.groupBy("row_id", "term").agg(F.collect_list("pos").alias("positions")), "postings")
    proposed = postings.join(bounded(seeds, small), "term").select("row_id", "item", "place", F.explode("positions").alias("pos"))
    alignments = proposed.groupBy("row_id", "item", (F.col("pos") - F.col("place")).alias("delta")).agg(F.collect_set("place").alias("places"))
    probe_places = probes.select("item", "begin", F.col("probe.place").alias("need"))
    agreed = alignments.join(bounded(probe_places, small), "item").where((F.size(F.array_except("need", "places")) == 0) & (F.col("delta") + F.col("begin") >= 0))
    candidates = agreed.join(bounded(windows, small), ["item", "begin"]).join(bounded(ids, small), "item").select("row_id", "ids", "begin", (F.col("delta") + F.col("begin")).alias("at"), "words")
    gathered = candidates.groupBy("row_id").agg(F.collect_list(F.struct("ids", "begin", "at", F.col("words").alias("window"))).alias("candidates"))
    texts = docs.join(gathered, "row_id", "left").withColumn("words", word_list(text))
    hit = F.filter(F.coalesce("candidates", F.array()), lambda c: F.slice(F.col("words"), c["at"] + 1, F.size(c["window"])) == c["window"])
    checked = texts.withColumn("hits", hit)
    matches = checked.select("row_id", F.explode("hits").alias("h")).select("row_id", "h", F.explode("h.ids").alias("id")).select("row_id", "id.item_id", "h.begin", "h.at", F.size("h.window").alias("length"))
    return matches, checked


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, rarest: int = RAREST, share: int = 20, whole_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (the item_ids, sorted as strings), contaminated; with whole_rows also the struct `row` of its columns.

    Words: A-Z lower-cased, runs of non-ASCII characters, letters and digits. A word inside any occurrence of a window is hit. A document
    is contaminated if n_hit > 0 and share * n_hit >= n_words. Null and empty texts have no words; items without words match nothing;
    items with the same words all count; an item_id of several texts stands for all of them and counts once, and so does a null item_id, which
    is not in the list; rows with one doc_id are each judged on their own text, a null doc_id included.
    Without documents there are no rows, without items nothing is hit; other columns are passed on in `row` only.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    # rows of one doc_id and one text have the same candidates, so these need not be told apart
    named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("row_id"), "text")
    if whole_rows:
        named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("row_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    _, checked = _matches(named, benchmark, size, rarest, scratch)
    spots = F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + F.size(h["window"]) - 1)))
    items = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("hits", lambda h: h["ids"])), lambda i: i["item_id"].cast("string"))))
    rest = ["row"] if whole_rows else []
    out = checked.select(F.col("row_id.doc_id").alias("doc_id"), F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct(spots)).cast("long").alias("n_hit"), items.alias("items"), *rest)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *rest)
