"""Substring dedup on words with prefix-partitioned suffix trees.

Suffixes are dealt to tasks in ranges of neighbouring starts. A range's key is what all its windows contain, of variable length: first 16 words, their anchor,
then, where a group is too large for a task, all the words that a shorter range shares, and last the whole window (see repeats). It stands inside the windows: it is a prefix only
of the suffix that starts where it does.
A task builds the tree of its group's suffixes from the top: a node is split by the next words, suffixes alone in a node are
leaves, and the internal nodes at the depth of a window are the repeats, with the smallest doc_id below each. A repeat that goes on beyond a window
has such a node at each of its starts; these runs are joined to maximal repeats.

Words go by 64-bit hashes. Two different words have one hash with a chance of 2**-64; a wrong match also needs the other 49 words to be equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship_package
from .common import Scratch, slices_by_bytes
from .repeats import BATCH_BYTES, MEMBERS, SPANS, Units, identified, merged_spans, repeated_intervals
from .words import Words, ranges

WINDOW, GRAM = 50, 16
#: Words that one split of a node looks at.
STEP = 3


def deep_nodes(words: np.ndarray, begin: np.ndarray, count: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The node at depth `size` of each suffix that starts at the first count[i] words of context i (one of its own for a leaf above that depth)."""
    _, ids = np.unique(words, return_inverse=True)
    if len(ids) >= 1 << 21:
        raise ValueError("a batch has to have fewer than 2**21 words")
    ids = np.r_[ids.reshape(-1), np.zeros(size, np.int64)].astype(np.uint64)
    start = ranges(begin, count)
    result, live, node, leaves = np.empty(len(start), np.int64), np.arange(len(start)), np.zeros(len(start), np.int64), 0
    for depth in range(0, size, STEP):
        # the first split has no node yet to tell apart
        edge = np.zeros(len(live), np.uint64)
        for i in range(depth, min(depth + STEP, size)):
            edge = edge << np.uint64(21) | ids[start[live] + i]
        order = np.lexsort((edge, node)) if depth else np.argsort(edge, kind="stable")
        e, n = edge[order], node[order]
        new = np.r_[True, (e[1:] != e[:-1]) | (n[1:] != n[:-1])][: len(e)]
        child = np.cumsum(new) - 1
        several = (np.bincount(child, minlength=1) > 1)[child]
        lone = live[order[~several]]
        result[lone] = leaves + np.arange(len(lone))
        leaves += len(lone)
        live, node = live[order[several]], child[several]
    if len(live):
        result[live] = leaves + node
    _, dense = np.unique(result, return_inverse=True)
    return dense.reshape(-1)


def word_units(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = Words(raw, at)
    codes = words.hashes()
    return codes, words.first, codes


def substring_dedup(docs: DataFrame, members: int = MEMBERS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (begin and end of the maximal removed runs of words), kept (the other words, joined by one space).

    Removed is each word covered by 50 consecutive words that also start in a document with a smaller doc_id; judged on the input. Words are
    unchanged runs of bytes other than space and 0x09-0x0D. A null text has no words; texts under 50 words lose nothing; rows with one doc_id
    lose nothing to each other; a null doc_id comes after all others. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "substring")
    rows = identified(docs)
    units = Units(word_units, lambda codes: codes, WINDOW, GRAM, False)
    spans = repeated_intervals(rows, units, np.dtype(np.uint64), deep_nodes, scratch, members)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, gone = text.encode().split(), merged_spans(own)
                kept, last = [], 0
                for a, b in gone:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                out.append((len(words), [{"begin": a, "end": b} for a, b in gone], b" ".join(kept).decode()))
            n, runs, kept_ = zip(*out, strict=True)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, SPANS), pa.array(kept_, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    joined = rows.join(spans, ["did", "tk"], "left").select("doc_id", "text", F.col("spans"))
    return joined.mapInArrow(remove, "doc_id long, n_words long, spans array<struct<begin:long,end:long>>, kept string")
