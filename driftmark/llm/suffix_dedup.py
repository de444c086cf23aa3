"""Suffix-array dedup on bytes by bucket-pointer refinement.

Across tasks, windows are put in buckets by a 32-byte gram, and buckets too large for a task are refined by longer keys, up to whole windows (see
repeats). In a task, positions are put in buckets by their first 8 bytes. A bucket is then refined by sorting its positions on the
bucket numbers at later offsets; the refined numbers are the keys of the next round, so that the depth goes 8, 24, 72, 216 and last to
the window of 400. A position alone in its bucket is final and sorted no more. Windows are equal if they end in one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship_package
from .common import Scratch, slices_by_bytes, utf8_parts
from .repeats import BATCH_BYTES, MEMBERS, SPANS, Units, identified, merged_spans, repeated_intervals
from .words import ranges, stream

WINDOW, GRAM, Q = 400, 32, 8


def buckets(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense bucket numbers in sorted order of the keys, and whether a bucket has one member."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.r_[True, s[1:] != s[:-1]][: len(s)]
    number = np.cumsum(new) - 1
    out, alone = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    out[order] = number
    alone[order] = (np.bincount(number, minlength=1) == 1)[number]
    return out, alone


def refine(pointer: np.ndarray, alone: np.ndarray, at: np.ndarray, offsets: tuple[int, ...]) -> None:
    """Refine the buckets of positions `at` by the pointers at later offsets, in place."""
    single = alone[at]
    for o in offsets:
        single = single | alone[at + o]
    again = at[~single]
    key = pointer[again].astype(np.uint64)
    for o in offsets:
        key = key << np.uint64(21) | pointer[again + o].astype(np.uint64)
    number, unique = buckets(key)
    # what any part of a window tells apart is final
    final = at[single]
    pointer[final] = number.max(initial=-1) + 1 + np.arange(len(final))
    alone[final] = True
    pointer[again], alone[again] = number, unique


def window_classes(data: np.ndarray, begin: np.ndarray, count: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The class of the window at each of the first count[i] positions of each context (equal classes: equal windows)."""
    n, depth = len(data), Q
    if n >= 1 << 21:
        raise ValueError("a batch has to have fewer than 2**21 bytes")
    padded = np.r_[data, np.zeros(size + Q, np.uint8)]
    key = np.zeros(n + size, np.uint64)
    for i in range(Q):
        key = key << np.uint64(8) | padded[i : i + n + size].astype(np.uint64)
    plan = []
    while depth < size:
        step = (depth, 2 * depth) if 3 * depth <= size else (min(depth, size - depth),) if 2 * depth >= size else (depth, size - depth)
        depth = min(size, 3 * depth)
        plan.append(step)
    if plan:
        used = Q
        for step in plan[:-1]:
            used += step[-1]
        plan[-1] = (size - used,) if 2 * used >= size else (used, size - used)
    # positions whose buckets a later round reads: the starts, and as far beyond as the remaining offsets go
    reach = [sum(s[-1] for s in plan[i + 1 :]) for i in range(len(plan))]
    at = ranges(begin, count + sum(s[-1] for s in plan))
    pointer, alone = np.zeros(n + size, np.int64), np.zeros(n + size, bool)
    pointer[at], alone[at] = buckets(key[at])
    for step, more in zip(plan, reach, strict=True):
        refine(pointer, alone, ranges(begin, count + more), step)
    return pointer[ranges(begin, count)]


CODES = stream(256, 21)


def byte_codes_of(raw: np.ndarray) -> np.ndarray:
    return CODES[raw]


def byte_units(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return CODES[raw], at, raw


def suffix_dedup(docs: DataFrame, members: int = MEMBERS) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (begin and end of the maximal removed runs of bytes), kept (the remaining bytes).

    Removed is each byte covered by a 400-byte string that starts anywhere else too, in the same or another document, overlaps included; judged
    on the input. A null text counts as empty; texts under 400 bytes lose nothing; rows with one doc_id are documents of their
    own, equal ones too; a null doc_id is passed on. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "suffix")
    rows = identified(docs)
    units = Units(byte_units, byte_codes_of, WINDOW, GRAM, True)
    spans = repeated_intervals(rows, units, np.dtype(np.uint8), window_classes, scratch, members)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            raw, at = utf8_parts(batch.column("text"))
            data, out = raw.tobytes(), []
            for begin, end, own in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
                gone, kept, last = merged_spans(own), [], begin
                for a, b in gone:
                    kept.append(data[last : begin + a])
                    last = begin + b
                kept.append(data[last:end])
                out.append((end - begin, [{"begin": a, "end": b} for a, b in gone], b"".join(kept)))
            n, runs, kept_ = zip(*out, strict=True)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, SPANS), pa.array(kept_, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(spans, ["did", "tk"], "left").select("doc_id", "text", F.col("spans"))
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
