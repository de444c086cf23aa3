"""Runs of repeated words: stretches of a text that repeat a period at least three times.

For a period p the words p apart that are equal form stretches. A run of p covers at least `step(p)` neighbouring ones, so one place in every `step(p)` is enough to meet
each run: the grid. Over all periods it has about n/2 * ln(n) points (a harmonic sum). From all points of all periods and texts at once the longest common extensions to the right
and to the left are found by binary search over prefix hashes, in numpy. What is found is verified by the words themselves, and of equal stretches the
smallest period stays. Each text is worked through on its own, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship_package
from .common import slices_by_bytes, utf8_parts
from .words import U64, Words, ranges

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 24, 3
BATCH_BYTES = 2_000_000
#: Points of the grid, and words to verify, that are worked through at once.
POINTS = 1_000_000
#: The base of the prefix hashes.
BASE = 0x9E3779B97F4A7C15


def least_length(period: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST, TIMES * period)


def step(period: np.ndarray) -> np.ndarray:
    """Neighbouring equal pairs that a run of the period has at least."""
    return least_length(period) - period


class Prefixes:
    """Hashes of prefixes of a sequence of 64-bit codes: whether stretches at a place and `shift` later are equal is one comparison each."""

    def __init__(self, codes: np.ndarray):
        powers = np.full(len(codes) + 1, BASE, U64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=U64)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * self.powers[:-1], out=self.sums[1:])

    def equal(self, x: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        y = x + shift
        return (self.sums[x + length] - self.sums[x]) * self.powers[shift] == self.sums[y + length] - self.sums[y]

    def extension(self, x: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The greatest length up to `most` for which the stretches that begin (with back: end) at x and x + shift are equal, for all places at once."""
        low, high = np.zeros_like(x), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.equal(x[open_] - middle if back else x[open_], shift[open_], middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
        return low


def smallest_periods(found: np.ndarray) -> np.ndarray:
    """Of rows (begin, end, period) with one begin and end the one with the smallest period, in order."""
    found = found[np.lexsort(found.T[::-1])]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def grid(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, period) of all periods that a run of a text of so many words can have, in portions of about POINTS points."""
    text, periods = np.repeat(np.arange(len(counts)), counts // TIMES), ranges(np.ones(len(counts), np.int64), counts // TIMES)
    held = counts[text] >= least_length(periods)
    text, periods = text[held], periods[held]
    total = np.cumsum(-(-(counts[text] - periods) // step(periods)))
    begin = 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + POINTS, side="right")))
        yield text[begin:end], periods[begin:end]
        begin = end


def candidates(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(begin, end, smallest period) of the runs in a sequence of texts; text i has the codes first[i] to first[i + 1]. Equal hashes count as equal words here."""
    prefixes, out = Prefixes(codes), [np.zeros((0, 3), np.int64)]
    for text, periods in grid(np.diff(first)):
        points = -(-(first[text + 1] - first[text] - periods) // step(periods))
        text, p = np.repeat(text, points), np.repeat(periods, points)
        x = first[text] + (ranges(np.zeros(len(points), np.int64), points)) * step(p)
        meet = np.flatnonzero(codes[x] == codes[x + p])
        x, p, text = x[meet], p[meet], text[meet]
        begin = x - prefixes.extension(x, p, x - first[text], back=True)
        end = x + p + prefixes.extension(x, p, first[text + 1] - x - p, back=False)
        long = end - begin >= least_length(p)
        out.append(smallest_periods(np.column_stack([begin, end, p])[long]))
    return smallest_periods(np.concatenate(out))


def verified(words: Words, runs: np.ndarray) -> np.ndarray:
    """Whether the words of each run really equal those a period later, byte by byte."""
    good, size = np.ones(len(runs), bool), words.end - words.start
    pairs = runs[:, 1] - runs[:, 2] - runs[:, 0]
    part = np.cumsum(pairs) // POINTS
    for number in np.unique(part):
        at = np.flatnonzero(part == number)
        x = ranges(runs[at, 0], pairs[at])
        y, owner = x + np.repeat(runs[at, 2], pairs[at]), np.repeat(at, pairs[at])
        differ = size[x] != size[y]
        good[owner[differ]] = False
        x, y, owner = x[~differ], y[~differ], owner[~differ]
        wrong = words.raw[ranges(words.start[x], size[x])] != words.raw[ranges(words.start[y], size[y])]
        good[np.repeat(owner, size[x])[wrong]] = False
    return good


def plain_runs(words: list[bytes]) -> np.ndarray:
    """The runs of one text by comparing all words at each period: the way out where hashes met that should not."""
    known: dict[bytes, int] = {}
    ids, out = np.array([known.setdefault(w, len(known)) for w in words], np.int64), [np.zeros((0, 3), np.int64)]
    for p in range(1, len(ids) // TIMES + 1):
        edges = np.flatnonzero(np.diff(np.r_[False, ids[:-p] == ids[p:], False]))
        begin, end = edges[::2], edges[1::2] + p
        long = end - begin >= max(LEAST, TIMES * p)
        out.append(np.column_stack([begin, end, np.full(len(begin), p)])[long])
    return smallest_periods(np.concatenate(out))


def all_runs(words: Words) -> np.ndarray:
    """(begin, end, period) of the runs of a batch of texts, numbered through all its words."""
    runs = candidates(words.hashes(), words.first)
    wrong = np.unique(np.searchsorted(words.first, runs[~verified(words, runs), 0], side="right") - 1)
    if not len(wrong):
        return runs
    out = [runs[~np.isin(np.searchsorted(words.first, runs[:, 0], side="right") - 1, wrong)]]
    for i in wrong:
        own = range(words.first[i], words.first[i + 1])
        out.append(plain_runs([words.raw[words.start[k] : words.end[k]].tobytes() for k in own]) + np.array([words.first[i], words.first[i], 0]))
    return smallest_periods(np.concatenate(out))


def joined(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    at = np.flatnonzero(kept)
    first = np.searchsorted(at, words.first)
    last = np.zeros(len(at), bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    size = words.end[at] - words.start[at] + ~last
    # each word with the byte behind it, which becomes the space; behind the last word of all there may be none
    data = np.r_[words.raw, np.uint8(0x20)][ranges(words.start[at], size)]
    ends = np.cumsum(size)
    data[ends[~last] - 1] = 0x20
    offsets = np.r_[0, ends].astype(np.int64)[first]
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def batch_of_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = Words(*utf8_parts(batch.column("text")))
    runs = all_runs(words)
    gone = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone)[:-1] == 0
    text = np.searchsorted(words.first, runs[:, 0], side="right") - 1
    values = [runs[:, 0] - words.first[text], runs[:, 1] - runs[:, 0], runs[:, 2]]
    structs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], fields=list(RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32()), structs)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.count, pa.int64()), lists, joined(words, kept)], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length and period in words; by start, then period), collapsed.

    Words are maximal runs of other bytes than space and 0x09-0x0D. A run is a stretch with that smallest period, of at least LEAST words and TIMES periods, that no
    neighbour extends. collapsed: the words joined by one space without those that any run holds after its first period. A null, empty or white text has no words and no runs
    and collapses to an empty text. Rows are judged one by one, so repeated rows, ties and null ids are no matter; other columns are not read; an
    empty table gives no rows. Runs do not depend on hashes: they are verified, and where a hash misled, the text is compared directly.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            yield batch_of_runs(batch)

    of = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_words long, runs array<struct<start long, length long, period long>>, collapsed string").fields])
    return docs.select("doc_id", "text").mapInArrow(work, of)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """docs with repeated words in the texts that crc32(doc_id as text) % 10 = 0 chooses: of the n words those from a on repeat the p words from a on.

    With g the tenth part of that number, a = g % n and p = 1 + (n - a) // (3 + g % 8). Texts without words and rows without a doc_id stay as they are.
    """
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.expr("hash_of_id div 10"), F.size("words_of_text")
    a = (F.col("tenth") % n).cast("int")
    p = (1 + F.floor((n - F.col("place")) / (3 + F.col("tenth") % 8))).cast("int")
    left = n - F.col("place")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words_of_text", F.col("place") + 1, F.col("length_of_period")), F.ceil(left / F.col("length_of_period")).cast("int"))), F.lit(1), left)
    chosen = docs.select("doc_id", "text", h.alias("hash_of_id"))
    chosen = chosen.withColumn("words_of_text", F.when(F.col("hash_of_id") % 10 == 0, words)).withColumn("tenth", g)
    chosen = chosen.withColumn("place", F.when(n > 0, a)).withColumn("length_of_period", p)
    text = F.when(F.col("place").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("words_of_text", F.lit(1), F.col("place")), again), " "))
    return chosen.select("doc_id", text.alias("text"))
