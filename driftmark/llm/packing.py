"""Hierarchical packing of documents into training windows of several lengths.

Documents are routed to context-size tiers by length. Each tier's documents open its windows, whole shorter documents, those of shorter tiers too, fill what is left in a window,
the longest that fits first; only where none fits, one is cut. Windows of a tier are then dealt to step groups of equal size and about equal cost of attention.

A document beyond the longest tier has full windows of its own and a rest. Rests of equal length are alike, so the packing is planned for the counts of each length (at most as
many numbers as the longest tier has tokens, whatever the size of the table): a plan says which ranks of a length go to which windows. The documents'
ranks, and so their places, are found by DataFrame operations.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship_package
from .common import Scratch, binary_rows, partitions_for, slices_by_bytes
from .tokens import byte_alphabet

#: Context sizes of the tiers, powers of two, longest first.
TIERS = (1024, 512, 256, 128)
#: Tokens of a step group.
STEP_TOKENS = 65_536
#: Pieces of a plan: so many at most for any counts of rests. They depend on the lengths that occur, not on how often they do.
PLAN_PIECES = 100_000
#: The id that ends a document.
END = 0
BATCH_BYTES = 2_000_000
#: How byte-level vocabularies of this kind split texts (fixed).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of texts, without added special tokens; special strings inside texts are taken as the library takes them.

    Plain byte-level vocabularies whose ids follow their merges are encoded by a second library, which gives the same ids in a third of the time (a test compares
    them over all code points); others by the vocabulary's own.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library, parsed = Tokenizer.from_str(spec), json.loads(spec)
        self.size, self.fast = self.library.get_vocab_size(), None
        model, before, added = parsed["model"], parsed.get("pre_tokenizer") or {}, parsed.get("added_tokens") or []
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        plain &= not parsed.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", False) and not before.get("add_prefix_space")
        plain &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if plain:
            vocab, byte_of = model["vocab"], {c: b for b, c in enumerate(byte_alphabet())}
            made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            special = {t["content"]: t["id"] for t in added}
            if made == sorted(made) and all(c in vocab for c in byte_of):
                import tiktoken

                ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
                self.fast = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder for a vocabulary, kept between tasks."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


class Supply:
    """Rests that are not placed yet: for each length the stretches (size, rank, count, start) of rests of one size, by rank, that have lost their first `start` tokens."""

    def __init__(self, counts: dict[int, int]):
        self.held = {size: [(size, 0, n, 0)] for size, n in counts.items() if size and n}
        self.lengths = sorted(self.held)
        self.tokens = sum(size * n for size, n in counts.items())

    def put(self, stretch: tuple[int, int, int, int]) -> None:
        length = stretch[0] - stretch[3]
        if length not in self.held:
            self.held[length] = []
            bisect.insort(self.lengths, length)
        self.held[length].append(stretch)

    def take(self, length: int, count: int, room: int) -> tuple[int, int, int, int]:
        """A stretch of at most `count` rests of this length, of each its first `room` tokens; what is left of them stays."""
        size, rank, n, start = self.held[length].pop()
        if not self.held[length]:
            del self.held[length]
            self.lengths.remove(length)
        k = min(count, n)
        if n > k:
            self.put((size, rank + k, n - k, start))
        if length > room:
            self.put((size, rank, k, start + room))
        self.tokens -= k * min(length, room)
        return size, rank, k, start

    def best(self, room: int) -> int:
        """The longest rest that fits; if none does, the shortest."""
        at = bisect.bisect_right(self.lengths, room)
        return self.lengths[max(at - 1, 0)]


def plan_windows(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, list[tuple[int, int, int, int, int]]]]:
    """Windows for so many rests of each length: (tier, how many, pieces), where piece (size, rank, start, length, offset) of the window i is part of the rest with that
    size and rank + i. All windows are full but one, which has the last tokens, fewer than the shortest tier."""
    supply, out = Supply(counts), []
    for tier in tiers:
        while supply.lengths and supply.tokens >= tier and (supply.lengths[-1] > tier // 2 or tier == tiers[-1]):
            # as many windows as there are tokens for
            length = supply.lengths[-1]
            size, rank, n, start = supply.take(length, supply.tokens // tier, tier)
            used = min(length, tier)
            open_ = [(n, [(size, rank, start, used, 0)], used)]
            while open_:
                n, pieces, used = open_.pop()
                if used == tier:
                    out.append((tier, n, pieces))
                    continue
                length = supply.best(tier - used)
                size, rank, k, start = supply.take(length, n, tier - used)
                more = min(length, tier - used)
                open_.append((k, [*pieces, (size, rank, start, more, used)], used + more))
                if n > k:
                    open_.append((n - k, [(s, r + k, *rest) for s, r, *rest in pieces], used))
    last, used = [], 0
    while supply.lengths:
        length = supply.lengths[-1]
        size, rank, _, start = supply.take(length, 1, length)
        last.append((size, rank, start, length, used))
        used += length
    return [*out, (tiers[-1], 1, last)] if last else out


def cost(window: tuple[int, int, list]) -> int:
    """Attention within documents: the squares of the pieces' lengths."""
    return sum(piece[3] ** 2 for piece in window[2])


def tokenised(docs: DataFrame, vocabulary_path: str, longest: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """A written table with a row per document: row_key, part, doc_id, n (tokens), full (windows of its own), rest (tokens beyond them), rank (among the part's rows with that rest),
    before (full windows of the part's rows before), ids (little-endian, of the second result's bytes each)."""
    spark: SparkSession = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    width = 2 if encoder(sent.value).size <= 1 << 16 else 4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(sent.value).ids, TaskContext.get().partitionId()
        row, before, ranks = 0, 0, np.zeros(longest, np.int64)
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            ids = [np.append(ids_of(t or ""), np.uint32(END)).astype(f"<u{width}") for t in batch.column("text").to_pylist()]
            n = np.array([*map(len, ids)], np.int64)
            full, rest = n // longest, n % longest
            # equal rests of the batch in order: the place of each among them
            order = np.argsort(rest, kind="stable")
            first = np.searchsorted(rest[order], rest[order])
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - first + ranks[rest[order]]
            np.add.at(ranks, rest, 1)
            columns = [(part << 33) + row + np.arange(len(n)), np.full(len(n), part), n, full, rest, rank, before + np.cumsum(full) - full]
            row, before = row + len(n), before + int(full.sum())
            column = binary_rows(np.concatenate(ids), np.r_[0, np.cumsum(n)[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), column], names=["doc_id", "row_key", "part", "n", "full", "rest", "rank", "before", "ids"])

    of = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("row_key long, part long, n long, full long, rest long, rank long, before long, ids binary").fields])
    return scratch.write(docs.select("doc_id", "text").mapInArrow(work, of), "ids"), width


def places(rows: DataFrame, plan: list, n_full: int, starts: DataFrame, tiers: tuple[int, ...], step_tokens: int) -> DataFrame:
    """row_key and pieces (start, length, sequence_id, offset, tier, step_group) of each document."""
    spark, longest = rows.sparkSession, tiers[0]
    # windows in order: by tier, within it by cost; those of one document each cost most
    plan = sorted(plan, key=lambda w: (-w[0], -cost(w)))
    held = dict.fromkeys(tiers, 0) | {longest: n_full}
    for tier, n, _ in plan:
        held[tier] += n
    first, group, before, groups = {}, {}, 0, 0
    for tier in tiers:
        first[tier], group[tier] = before, (groups, max(1, -(-held[tier] * tier // step_tokens)))
        before, groups = before + held[tier], groups + group[tier][1] * (held[tier] > 0)
    at, listed = first | {longest: first[longest] + n_full}, {}
    for tier, n, pieces in plan:
        for size, rank, start, length, offset in pieces:
            listed.setdefault(size, []).append((rank, n, start, length, offset, at[tier], tier))
        at[tier] += n
    piece = "array<struct<from_rank long, n long, start long, length long, offset long, first long, tier int>>"
    planned = spark.createDataFrame([*listed.items()], f"rest long, planned {piece}")

    def stepped(sequence: Column, tier: Column) -> Column:
        """Windows in order of cost go to the groups forth and back."""
        out = F.lit(None).cast("long")
        for t in tiers:
            base, n = group[t]
            place = sequence - first[t]
            turn, along = F.floor(place / n), place % n
            out = F.when(tier == t, base + F.when(turn % 2 == 0, along).otherwise(n - 1 - along)).otherwise(out)
        return out.alias("step_group")

    def struct(start: Column, length: Column, sequence: Column, offset: Column, tier: Column) -> Column:
        return F.struct(start.alias("start"), length.alias("length"), sequence.alias("sequence_id"), offset.alias("offset"), tier.alias("tier"), stepped(sequence, tier))

    zero, top = F.lit(0).cast("long"), F.lit(longest).cast("long")
    start_of = lambda c: F.coalesce(F.element_at("starts", c), zero)
    ranked = rows.select("row_key", "part", "full", "rest", "rank", "before").join(starts, "part")
    ranked = ranked.select("row_key", "full", "rest", (F.col("rank") + start_of(F.col("rest"))).alias("rank"), (F.col("before") + start_of(top)).alias("before"))
    # the plan has a row per length, and its pieces are as many for a million times the counts (test_plan holds them to PLAN_PIECES)
    found = ranked.join(F.broadcast(planned), "rest", "left")
    own = F.when(F.col("full") > 0, F.transform(F.sequence(zero, F.col("full") - 1), lambda i: struct(i * longest, top, first[longest] + F.col("before") + i, zero, F.lit(longest)))).otherwise(F.array())
    here = F.filter(F.coalesce("planned", F.array()), lambda p: (p["from_rank"] <= F.col("rank")) & (F.col("rank") < p["from_rank"] + p["n"]))
    rest = F.transform(here, lambda p: struct(F.col("full") * longest + p["start"], p["length"], p["first"] + F.col("rank") - p["from_rank"], p["offset"], p["tier"]))
    return found.select("row_key", F.concat(own, rest).alias("pieces"))


def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two bytes an id become four."""
    for batch in batches:
        of = batch.schema.get_field_index("ids")
        column = batch.column(of)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u2").astype("<u4")
        arrays = batch.columns
        arrays[of] = binary_rows(values, (at[:-1] - at[0]) // 2)
        yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)


def pack(docs: DataFrame, vocabulary_path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start (its document's tokens before it), length, doc_tokens (with the end), sequence_id, offset (in the sequence), tier (its context size),
    step_group, ids (four bytes each, little-endian).

    A document is its text's ids and the id END. Each of its tokens is in one piece, a sequence's pieces follow each other without gaps, and all sequences are as long as
    their tier but the last one of the shortest tier. A null or empty text has its end only. Rows are packed one by one, so repeated rows, ties and null
    ids are no matter, and a very long text is cut into windows; other columns are not read; an empty table gives no rows. sequence_id and step_group count
    from 0; how rows are numbered follows the order in which the table is read.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    scratch, longest = Scratch(spark, "packing"), tiers[0]
    rows, width = tokenised(docs, vocabulary_path, longest, scratch)
    # class `longest` counts full windows, the others count rests of that length
    classes = F.explode(F.array(F.struct("rest", F.lit(1).cast("long").alias("c")), F.struct(F.lit(longest).cast("long").alias("rest"), F.col("full").alias("c")))).alias("k")
    counts = scratch.write(rows.select("part", classes).where("k.c > 0").groupBy("part", F.col("k.rest").alias("class")).agg(F.sum("k.c").alias("c")), "counts")
    by_class = {r["class"]: r.c for r in counts.groupBy("class").agg(F.sum("c").alias("c")).collect()}  # at most longest + 1 rows
    n_full = by_class.pop(longest, 0)
    before = F.sum("c").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    starts = counts.select("part", "class", before.alias("start")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("class", "start"))).alias("starts"))
    found = places(rows, plan_windows(by_class, tiers), n_full, starts, tiers, step_tokens)
    n = partitions_for(rows, 16)
    cut = lambda p: F.struct(p.alias("p"), F.substring("ids", (p["start"] * width + 1).cast("int"), (p["length"] * width).cast("int")).alias("ids"))
    met = rows.select("row_key", "doc_id", "n", "ids").repartition(n, "row_key").join(found.repartition(n, "row_key").hint("shuffle_hash"), "row_key")
    out = met.select("doc_id", "n", F.explode(F.transform("pieces", cut)).alias("x")).select("doc_id", "x.p.start", "x.p.length", F.col("n").alias("doc_tokens"), "x.p.sequence_id", "x.p.offset", "x.p.tier", "x.p.step_group", "x.ids")
    return out.mapInArrow(widened, out.schema) if width == 2 else out
