"""Distributed search for repeated windows, shared by suffix-array and substring dedup.

Sampling. Every window of `size` units (bytes or words) has one anchor: the position in it whose q-gram has the least hash. Equal windows have
equal anchors at equal places, so the windows of an anchor (a run of starts, about size / 2 of them) only have to be compared with
those of anchors with the same q-gram. A run's units are its context; runs with equal contexts are represented by one.

Buckets. Contexts are put in buckets by the q-gram. A bucket with one context is settled: its windows are repeated if the context is. A bucket of
at most MEMBERS contexts goes to one task, where the caller's index tells which windows are equal. A larger one is split by longer
keys: the run is cut into pieces of neighbouring starts, and the key is all that the windows of a piece share. What
is still too large is split by whole windows, where the members of a bucket are equal. So no bucket is too large for a task, and none is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions_for, slices_by_bytes, utf8_parts
from .words import U64, mix, ranges, stream

BATCH_BYTES = 1_500_000
#: Units that are anchored at a time; only a text of more bytes than a batch should have can be longer.
PIECE = 1 << 21
#: Different texts of one bucket that one task compares; larger buckets are split by longer keys.
MEMBERS = 256
#: Units of contexts that are compared at a time.
UNITS = 1 << 20
INVERSES = {}

#: A context: its q-gram and 128 bits of a hash of its units and the anchor's place.
KEY = ["h", "c1", "c2"]
#: A member of a bucket: the bucket's key, and 128 bits of a hash of its own units.
MEMBER = ["g1", "g2", "e1", "e2"]
ANCHORS = "h long, c1 long, c2 long, did long, tk long, f int, len int, off int"
CUTS = "piece boolean, h long, c1 long, c2 long, place int, g1 long, g2 long, e1 long, e2 long, did long, cnt long, len int, blob binary"
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
RUNS = "g1 long, g2 long, e1 long, e2 long, a int, b int, least long"
WINDOWS = "g1 long, g2 long, e1 long, e2 long, did long, cnt long, a int, w1 long, w2 long"


@dataclass(frozen=True)
class Units:
    """What a unit is. split: bytes of texts -> (codes of all units, first unit of each text and the end, bytes of all units for contexts, their width)."""

    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: Units as they are kept in contexts -> their codes.
    codes: Callable[[np.ndarray], np.ndarray]
    size: int
    q: int
    #: Whether windows of one document count as repeats of each other, and which of them go: all, or those with an earlier document.
    all_go: bool


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for an odd B."""
    b = int(stream(1, seed)[0])
    out = []
    for base in (b, pow(b, -1, 1 << 64)):
        p = np.ones(1, U64)
        while len(p) < n:
            p = np.concatenate([p, p * U64(pow(base, len(p), 1 << 64))])
        out.append(p[:n])
    return out[0], out[1]


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, seed: int):
        key = (seed, 1 << max(10, int(len(codes)).bit_length()))
        if key not in INVERSES:
            for old in [k for k in INVERSES if k[0] == seed]:
                del INVERSES[old]
            INVERSES[key] = powers(key[1] + 1, seed)
        self.up, self.down = INVERSES[key]
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * self.up[: len(codes)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(U64) * U64(0x9E3779B97F4A7C15))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    m, span = x, 1
    while span * 2 <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - span : w - span + len(x) - w + 1])


def overlapping(codes: np.ndarray, first: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(begin, codes, first unit of each text and the end) of pieces that overlap by size - 1 units: each window is in one piece."""
    for begin in range(0, len(codes) - size + 1, PIECE - size + 1):
        piece = codes[begin : begin + PIECE]
        yield begin, piece, np.clip(first - begin, 0, len(piece))


def anchor_runs(codes: np.ndarray, first: np.ndarray, size: int, q: int) -> tuple[np.ndarray, ...] | None:
    """(text, first start, number of starts, anchor, hash of its q-gram) of each run of starts with one anchor."""
    n = len(codes)
    if n < size:
        return None
    if n >= 1 << 24:
        raise ValueError("a piece has to have fewer than 2**24 units")
    places = np.arange(n + 1)
    roll = Rolling(codes, 11)
    h = roll.of(places[: n - q + 1], places[q : n + 1])
    low = U64((1 << 24) - 1)
    least = sliding_least((h & ~low) | places[: len(h)].astype(U64), size - q + 1)
    anchor = (least & low).astype(np.int64)
    windows = np.maximum(np.diff(first) - size + 1, 0)
    start = ranges(first[:-1], windows)
    if not len(start):
        return None
    text = np.repeat(np.arange(len(windows)), windows)
    anchor = anchor[start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    return text[new], start[new], np.diff(np.r_[new, len(start)]), anchor[new], h[anchor[new]]


def find_anchors(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            every, firsts, _ = units.split(*utf8_parts(batch.column("text")))
            for begin, codes, first in overlapping(every, firsts, units.size):
                runs = anchor_runs(codes, first, units.size, units.q)
                if runs is None:
                    continue
                text, start, count, anchor, h = runs
                end = start + count - 1 + units.size
                offset = (anchor - start).astype(U64)
                c1, c2 = (mix(Rolling(codes, seed).of(start, end) ^ mix(offset + U64(seed))) for seed in (12, 13))
                ids, keys = batch.column("did").to_numpy()[text], batch.column("tk").to_numpy()[text]
                columns = [h.view(np.int64), c1.view(np.int64), c2.view(np.int64), ids, keys, (begin + start - firsts[text]).astype(np.int32), count.astype(np.int32), (anchor - start).astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], ["h", "c1", "c2", "did", "tk", "f", "len", "off"])

    return find


def cut_contexts(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each document the units of its wanted runs: whole, with the q-gram as the bucket's key, or, for large buckets, in pieces of starts at fixed distances
    from the anchor, with what all windows of a piece share as the key. About as many pieces as windows in each make the fewest rows of both."""
    names = [c.split()[0] for c in CUTS.split(", ")]
    step = math.isqrt(units.size - units.q + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            codes, first, content = units.split(*utf8_parts(batch.column("text")))
            runs = batch.column("runs")
            flat = runs.flatten()
            text = np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy())
            large, h, c1, c2, f, count, off, cnt = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("large", "h", "c1", "c2", "f", "len", "off", "cnt"))
            did = batch.column("did").to_numpy()[text]
            begin = first[text] + f

            def rows(own: np.ndarray, start: np.ndarray, number: np.ndarray, g1: np.ndarray, g2: np.ndarray, e1: np.ndarray, e2: np.ndarray, piece: bool) -> pa.RecordBatch:
                blobs = [content[b : b + n].tobytes() for b, n in zip(start, number - 1 + units.size, strict=True)]
                place = (start - begin[own]).astype(np.int32)
                columns = [np.full(len(own), piece), h[own], c1[own], c2[own], place, g1, g2, e1, e2, did[own], cnt[own], number.astype(np.int32)]
                return pa.record_batch([*map(pa.array, columns), pa.array(blobs, pa.binary())], names)

            whole = np.flatnonzero(~large)
            if len(whole):
                yield rows(whole, begin[whole], count[whole], h[whole], np.zeros(len(whole), np.int64), c1[whole], c2[whole], False)
            much = np.flatnonzero(large)
            for some in (much[i : i + 1000] for i in range(0, len(much), 1000)):
                start, of = ranges(begin[some], count[some]), np.repeat(some, count[some])
                anchor = begin[of] + off[of]
                piece = (anchor - start) // step
                new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (piece[1:] != piece[:-1])])
                last = np.r_[new[1:], len(of)] - 1
                core = anchor[new] - step * piece[new]
                rolls = [Rolling(codes, seed) for seed in (14, 15)]
                g1, g2 = (r.of(core, core - (step - 1) + units.size).view(np.int64) for r in rolls)
                shift = mix((anchor[new] - start[new]).astype(U64))
                e1, e2 = (mix(r.of(start[new], start[last] + units.size) ^ shift).view(np.int64) for r in rolls)
                yield rows(of[new], start[new], last - new + 1, g1, g2, e1, e2, True)

    return cut


def compare_members(units: Units, dtype: np.dtype, classes: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of starts per member whose windows are repeated. classes(units, first unit of each member, number of starts of each) -> class of each start."""

    def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        did, cnt, count = (t[k].to_numpy() for k in ("did", "cnt", "len"))
        blobs = t["blob"].to_pylist()
        content = np.frombuffer(b"".join(blobs), dtype)
        begin = np.cumsum([0, *(len(b) // dtype.itemsize for b in blobs[:-1])])
        of, group = np.repeat(np.arange(len(count)), count), classes(content, begin, count)
        n = int(group.max()) + 1
        weight = np.bincount(group, cnt[of], minlength=n)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, group, did[of])
        place, best = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), least[group]
        keep = weight[group] > 1
        if not units.all_go:
            keep &= (best < did[of]) | (cnt[of] > 1)
        place, of, best = place[keep], of[keep], np.zeros(keep.sum(), np.int64) if units.all_go else best[keep]
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1) | (best[1:] != best[:-1])][: len(of)])
        last = np.r_[new[1:], len(of)][: len(new)] - 1
        ids = [pa.array(t[k].to_numpy()[of[new]]) for k in MEMBER]
        return pa.record_batch([*ids, pa.array(place[new].astype(np.int32)), pa.array(place[last].astype(np.int32)), pa.array(best[new])], [*MEMBER, "a", "b", "least"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total, last = 0, None
        for batch in batches:
            g1, g2 = (batch.column(k).to_numpy() for k in ("g1", "g2"))
            size = np.array([len(b) // dtype.itemsize for b in batch.column("blob").to_pylist()], np.int64)
            edges = np.flatnonzero(np.r_[True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])][: len(g1)])
            for a, b in zip(edges, [*edges[1:], len(g1)], strict=True):
                # a bucket may go on from the batch before, so only a new one closes what is held
                if total > UNITS and (g1[a], g2[a]) != last:
                    yield close(held)
                    held, total = [], 0
                held.append(batch.slice(a, b - a))
                total, last = total + int(size[a:b].sum()), (g1[a], g2[a])
        if held:
            yield close(held)

    return compare


def window_rows(units: Units, dtype: np.dtype) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each window of each member, with 128 bits of a hash of the window as its key."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                count, blobs = batch.column("len").to_numpy(), batch.column("blob").to_pylist()
                content = np.frombuffer(b"".join(blobs), dtype)
                begin = np.cumsum([0, *(len(b) // dtype.itemsize for b in blobs[:-1])])
                start, of = ranges(begin, count), np.repeat(np.arange(len(count)), count)
                keys = (Rolling(units.codes(content), seed).of(start, start + units.size).view(np.int64) for seed in (14, 15))
                yield pa.record_batch([*(pa.array(batch.column(k).to_numpy()[of]) for k in [*MEMBER, "did", "cnt"]), pa.array((start - begin[of]).astype(np.int32)), *map(pa.array, keys)], names)

    return each


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, did (a null doc_id comes after all others), tk (tells rows with one doc_id apart by their text) and the text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("did"), text).withColumn("tk", F.xxhash64("text"))


def islands(windows: DataFrame) -> DataFrame:
    """Runs (a, b, least) of each member from single windows (a, least)."""
    order = Window.partitionBy(*MEMBER, "least").orderBy("a")
    return windows.withColumn("isle", F.col("a") - F.row_number().over(order)).groupBy(*MEMBER, "least", "isle").agg(F.min("a").alias("a"), F.max("a").alias("b")).select(*MEMBER, "a", "b", "least")


def repeated_intervals(rows: DataFrame, units: Units, dtype: np.dtype, classes: Callable, scratch: Scratch, members: int = MEMBERS) -> DataFrame:
    """(did, tk, spans) with the unit ranges [a, b) that repeated windows cover."""
    parts = partitions_for(rows, 8)
    anchors = scratch.write(rows.select("did", "tk", "text").mapInArrow(find_anchors(units), ANCHORS), "anchors")
    contexts = anchors.groupBy(*KEY).agg(F.min(F.struct("did", "tk", "f", "len", "off")).alias("rep"), F.count(F.lit(1)).alias("cnt"))
    contexts = scratch.write(contexts, "contexts")
    grams = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("total")).where("total > 1")
    repeated = scratch.write(contexts.join(grams, "h"), "repeated")
    scratch.drop("contexts")
    alone = repeated.where("n = 1").select(*KEY, F.lit(0).alias("a"), (F.col("rep.len") - 1).alias("b"), F.col("rep.did").alias("least"))
    wanted = repeated.where("n > 1").select(F.col("rep.did").alias("did"), F.col("rep.tk").alias("tk"), F.struct((F.col("n") > members).alias("large"), *KEY, F.col("rep.f").alias("f"), F.col("rep.len").alias("len"), F.col("rep.off").alias("off"), "cnt").alias("run"))
    lists = wanted.groupBy("did", "tk").agg(F.collect_list("run").alias("runs"))
    # of rows with one doc_id and one text, one is cut: the others are dropped before they are shuffled
    texts = rows.select("did", "tk", "text").dropDuplicates(["did", "tk"]).join(lists, ["did", "tk"])
    cuts = scratch.write(texts.mapInArrow(cut_contexts(units), CUTS), "cuts")
    sort = [*MEMBER, "did", "cnt", "len", "blob"]
    compare = lambda df: df.repartition(parts, "g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(compare_members(units, dtype, classes), RUNS)
    small = compare(cuts.where("not piece").select(*sort)).select(F.col("g1").alias("h"), F.col("e1").alias("c1"), F.col("e2").alias("c2"), "a", "b", "least")
    # pieces with equal units are represented by one; a bucket of one such is settled
    pieces = cuts.where("piece")
    equal = pieces.groupBy(*MEMBER).agg(F.min("did").alias("least"), F.sum("cnt").alias("weight"), F.min(F.struct(*KEY, "place")).alias("rep"))
    sizes = equal.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("kinds"))
    known = scratch.write(equal.join(sizes, ["g1", "g2"]), "pieces")
    settled = known.where("kinds = 1 and weight > 1")
    chosen = known.where("kinds > 1").select("rep.*", F.col("least").alias("did"), F.col("weight").alias("cnt"), "kinds")
    open_ = scratch.write(pieces.drop("did", "cnt").join(chosen, [*KEY, "place"]).select(*sort, "kinds"), "open")
    sorted_ = compare(open_.where(F.col("kinds") <= members).drop("kinds"))
    each = open_.where(F.col("kinds") > members).drop("kinds").mapInArrow(window_rows(units, dtype), WINDOWS)
    windows = scratch.write(each, "windows")
    same = windows.groupBy("w1", "w2").agg(F.min("did").alias("least"), F.sum("cnt").alias("weight")).where("weight > 1")
    if units.all_go:
        same = same.withColumn("least", F.lit(0).cast("long"))
    found = scratch.write(sorted_.unionByName(islands(windows.join(same, ["w1", "w2"]))), "found")
    place = [(F.col("place") + F.col(c)).alias(c) for c in ("a", "b")]
    whole = pieces.join(settled.select(*MEMBER, F.col("least").alias("first")), MEMBER).select(*KEY, F.col("place").alias("a"), (F.col("place") + F.col("len") - 1).alias("b"), F.col("first").alias("least"))
    parts_ = pieces.join(found, MEMBER).select(*KEY, *place, "least")
    # one row for each context, so that a context with many copies meets each copy once
    runs = alone.unionByName(small).unionByName(whole).unionByName(parts_).groupBy(*KEY).agg(F.collect_list(F.struct("a", "b", "least")).alias("runs"))
    runs = scratch.write(runs, "runs")
    scratch.drop("cuts", "repeated", "pieces", "open", "windows", "found")
    both = anchors.join(runs, KEY)
    if not units.all_go:
        both = both.withColumn("runs", F.filter("runs", lambda r: r["least"] < F.col("did"))).where(F.size("runs") > 0)
    spans = F.transform("runs", lambda r: F.struct((F.col("f") + r["a"]).alias("a"), (F.col("f") + r["b"] + units.size).alias("b")))
    return both.select("did", "tk", spans.alias("spans")).groupBy("did", "tk").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges joined where they overlap or touch."""
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return [(a, b) for a, b in out]
