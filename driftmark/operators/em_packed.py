"""Expectation-maximisation of periods whose terms are packed: a row per document, which holds its words by their numbers in the vocabulary, 8 bytes a term.

Documents are packed where they are counted, and dealt out once, by period and run. A task goes through the documents of a period in blocks, whose terms it puts in the order of words: then
word states are read and summed in order, and only the documents of a block are met at random. Beyond HELD_ROWS terms blocks lie in a scratch file of the task, so it holds one block, the states of
the period's words, and those of its documents. Vocabularies and periods beyond the limits below are fitted by `em_blocks`.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import BROADCAST_PERIODS, assign
from ..shared import settle
from ..ship import ship_package
from .em import THEMES, drawn_weights, ratio, scaled
from .em_blocks import fit_blocks, fit_periods
from .terms import terms_of

#: Words times themes up to which the vocabulary is held by the driver and by each task.
VOCABULARY = 20_000_000
#: Terms of a period up to which one task fits it: 1.6 GB of scratch.
TASK_ROWS = 200_000_000
#: Terms of a block, about.
BLOCK_ROWS = 1_000_000
#: Terms that a task holds in memory: 128 MB.
HELD_ROWS = 16_000_000
#: Terms whose posteriors are held at once, about.
PIECE = 1 << 16
#: Words of a batch that a task gives back.
OUT_WORDS = 100_000
PACKED = "period_id int, doc_id long, n long, ids binary, cnts binary"


@dataclass
class Packed:
    """Terms of documents as PACKED rows (ids: int32 numbers of words, cnts: int32), each document of a period once, and the vocabulary's (words, p)."""

    rows: DataFrame
    model: DataFrame
    sent: Broadcast


def vocabulary(model: DataFrame, most: int) -> Broadcast | None:
    """(words in order, p) of a background model, sent to all tasks; none where it has more than `most` words."""
    if model.limit(most + 1).count() > most:
        return None
    table = model.select("word", "p").toArrow().combine_chunks()
    table = table.take(pc.sort_indices(table["word"]))
    words = table["word"].combine_chunks()
    return model.sparkSession.sparkContext.broadcast((words if isinstance(words, pa.Array) else pa.array([], pa.string()), table["p"].to_numpy()))


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value for each size, of so many int32 numbers."""
    ends = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])


def with_numbers(rows: DataFrame, sent: Broadcast, *kept: str) -> DataFrame:
    """(*kept, n, ids, cnts) of rows with words and cnts: the n known words of each."""
    of = [f for f in rows.schema.fields if f.name in kept]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value[0]
        for batch in batches:
            lists = batch.column("words")
            ids = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
            known = ids >= 0
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            n = np.bincount(row[known], minlength=batch.num_rows)
            cnts = batch.column("cnts").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in of), pa.array(n, pa.int64()), binaries(ids[known], n), binaries(cnts[known], n)], names=[*(f.name for f in of), "n", "ids", "cnts"])

    ship_package(rows.sparkSession)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in of)
    return rows.select(*(f.name for f in of), "words", "cnts").mapInArrow(number, f"{columns}, n long, ids binary, cnts binary")


def pack(docs: DataFrame, model: DataFrame, periods: DataFrame, k: int, min_tokens: int = 50, min_distinct: int = 50) -> Packed | None:
    """terms.terms_of of COUNTED rows, a written table, packed; none where the vocabulary is too large for k themes. Only articles that have several rows are shuffled."""
    sent = vocabulary(model, VOCABULARY // k)
    if sent is None:
        return None
    columns = [c.split()[0] for c in PACKED.split(", ")]
    again = settle(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("doc_id").alias("again")), "again")
    repeated = not again.isEmpty()
    single = docs.join(again, docs["doc_id"].eqNullSafe(again["again"]), "left_anti") if repeated else docs
    known = with_numbers(single.where(F.col("n") >= min_tokens), sent, "doc_id", "issue_ts").where(F.col("n") > min_distinct)
    rows = assign(known, periods).select(*columns)
    if repeated:
        several = terms_of(docs.join(again, docs["doc_id"].eqNullSafe(again["again"]), "left_semi"), model, periods, min_tokens, min_distinct)
        one = several.groupBy("period_id", "doc_id").agg(F.collect_list(F.struct("word", F.col("cnt").cast("int").alias("cnt"))).alias("x"))
        rows = rows.unionByName(with_numbers(one.select("period_id", "doc_id", F.col("x.word").alias("words"), F.col("x.cnt").alias("cnts")), sent, "period_id", "doc_id").select(*columns))
    return Packed(settle(rows, "packed"), model, sent)


def unpacked(packed: Packed, rows: DataFrame) -> DataFrame:
    """(period_id, doc_id, word, cnt) of PACKED rows."""
    sent = packed.sent

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            ids, cnts = numbers(batch.column("ids")), numbers(batch.column("cnts"))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("period_id", "doc_id")] + [sent.value[0].take(pa.array(ids)), pa.array(cnts.astype(np.int64))], names=["period_id", "doc_id", "word", "cnt"])

    return rows.mapInArrow(spread, "period_id int, doc_id long, word string, cnt long")


def numbers(column: pa.Array) -> np.ndarray:
    """The int32 numbers of all values of a binary column, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.int32) if len(column) else np.zeros(0, np.int32)


def word_pieces(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of words, and of their terms, of about PIECE terms."""
    ends = np.cumsum(sizes)
    borders = np.unique([0, *(np.searchsorted(ends, np.arange(PIECE, ends[-1], PIECE)) + 1), len(ends)])
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        yield int(a), int(b), int(ends[a] - sizes[a]), int(ends[b - 1])


def masses(doc: np.ndarray, sizes: np.ndarray, pi: np.ndarray, pw: np.ndarray) -> np.ndarray:
    """pi * pw of each theme and term; sizes: the terms of each word."""
    m = np.empty((len(pw), len(doc)))
    for row, a, b in zip(m, pi, pw, strict=True):
        np.take(a, doc, out=row, mode="clip")
        row *= np.repeat(b, sizes)
    return m


def ordered_step(doc: np.ndarray, cnt: np.ndarray, sizes: np.ndarray, pb: np.ndarray, pi: np.ndarray, pw: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """em.mixture_step of terms in the order of words. sizes: the terms of each word, none of 0; pi: K x documents, as is what is given back for it."""
    d, w = np.zeros(pi.shape), np.empty(pw.shape)
    for a, b, first, last in word_pieces(sizes):
        i, own = doc[first:last].astype(np.intp), sizes[a:b]
        m = masses(i, own, pi, pw[:, a:b])
        s, known = m.sum(0), np.repeat(lam * pb[a:b], own)
        each = cnt[first:last] * ratio(1 - ratio(known, known + (1 - lam) * s), s)
        starts = np.cumsum(own) - own
        for theme, row in enumerate(m):
            row *= each
            w[theme, a:b] = np.add.reduceat(row, starts)
            d[theme] += np.bincount(i, row, minlength=d.shape[1])
    return ratio(d, np.broadcast_to(d.sum(0), d.shape)), w


def ordered_likelihoods(doc: np.ndarray, cnt: np.ndarray, sizes: np.ndarray, pb: np.ndarray, pi: np.ndarray, pw: np.ndarray, lam: float) -> np.ndarray:
    """em.document_likelihoods of terms in the order of words."""
    x = np.zeros(pi.shape[1])
    for a, b, first, last in word_pieces(sizes):
        i, own = doc[first:last].astype(np.intp), sizes[a:b]
        mixture = np.repeat(lam * pb[a:b], own) + (1 - lam) * masses(i, own, pi, pw[:, a:b]).sum(0)
        x += np.bincount(i, cnt[first:last] * np.log(mixture), minlength=len(x))
    return x / np.bincount(doc, minlength=len(x))


@dataclass
class Period:
    """The documents of a period in blocks of terms in the order of words."""

    key: tuple[int, int]
    docs: list[np.ndarray] = field(default_factory=list)
    #: Of each block the numbers of its words, and how many terms each has.
    words: list[np.ndarray] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    #: (doc, cnt) of each block, or its place in the scratch file.
    terms: list = field(default_factory=list)
    scratch: object = None
    waiting: list[tuple] = field(default_factory=list)
    n: int = 0
    held: int = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.waiting.append((batch.column("doc_id").to_numpy(), batch.column("n").to_numpy(), numbers(batch.column("ids")), numbers(batch.column("cnts"))))
        self.n += len(self.waiting[-1][2])
        if self.n >= BLOCK_ROWS:
            self.close()

    def close(self) -> None:
        """What waits becomes blocks."""
        if not self.waiting:
            return
        docs, n, ids, cnts = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.n = [], 0
        ends = np.cumsum(n)
        borders = np.unique([0, *(np.searchsorted(ends, np.arange(BLOCK_ROWS, ends[-1], BLOCK_ROWS)) + 1), len(ends)])
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            some = slice(int(ends[a] - n[a]), int(ends[b - 1]))
            self.block(docs[a:b], n[a:b], ids[some], cnts[some])

    def block(self, docs: np.ndarray, n: np.ndarray, ids: np.ndarray, cnts: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        doc, cnt, ids = np.repeat(np.arange(len(docs), dtype=np.int32), n)[order], cnts[order], ids[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        self.docs.append(docs)
        self.words.append(ids[starts])
        self.sizes.append(np.diff(np.r_[starts, len(ids)]))
        self.held += len(ids)
        if self.held <= HELD_ROWS:
            self.terms.append((doc, cnt))
            return
        if self.scratch is None:
            self.scratch = tempfile.TemporaryFile(dir=(os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None)
        at = self.scratch.seek(0, os.SEEK_END)
        self.scratch.write(doc)
        self.scratch.write(cnt)
        self.terms.append((at, len(doc)))

    def block_terms(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.terms[i]
        if isinstance(a, np.ndarray):
            return a, b
        self.scratch.seek(a)
        x = np.frombuffer(self.scratch.read(8 * b), np.int32)
        return x[:b], x[b:]

    def fitted(self, words: pa.Array, p: np.ndarray, k: int, lam: float, iterations: int) -> Iterator[pa.RecordBatch]:
        """THEMES rows."""
        self.close()
        seen = np.zeros(len(p), bool)
        for x in self.words:
            seen[x] = True
        vocab = np.flatnonzero(seen)
        place = (np.cumsum(seen) - 1).astype(np.int32)
        at = [place[x] for x in self.words]
        pb, words = p[vocab], words.take(pa.array(vocab))
        pw, pi = drawn_weights(words.to_pylist(), k, self.key[1]), [np.full((k, len(x)), 1.0 / k) for x in self.docs]
        for _ in range(iterations):
            sums = np.zeros(pw.shape)
            for i, x in enumerate(at):
                pi[i], own = ordered_step(*self.block_terms(i), self.sizes[i], pb[x], pi[i], pw[:, x], lam)
                sums[:, x] += own
            pw = scaled(sums)
        ll = float(np.concatenate([ordered_likelihoods(*self.block_terms(i), self.sizes[i], pb[x], pi[i], pw[:, x], lam) for i, x in enumerate(at)]).mean())
        if self.scratch is not None:
            self.scratch.close()
        names, themes = [c.split()[0] for c in THEMES.split(", ")], np.arange(k, dtype=np.int32)

        def given(kind: str, theme: np.ndarray, doc: pa.Array, word: pa.Array, values: np.ndarray) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.key[0], np.int32)), pa.array(np.full(n, self.key[1], np.int32)), pa.array(np.full(n, ll)), pa.repeat(kind, n), pa.array(theme), doc, word, pa.array(values)], names=names)

        for docs, x in zip(self.docs, pi, strict=True):
            yield given("pi", np.tile(themes, len(docs)), pa.array(np.repeat(docs, k)), pa.nulls(x.size, pa.string()), x.T.ravel())
        for theme, x in enumerate(pw):
            for a in range(0, len(x), OUT_WORDS):
                some = x[a : a + OUT_WORDS]
                yield given("word", np.full(len(some), theme, np.int32), pa.nulls(len(some), pa.int64()), words.slice(a, len(some)), some)


def fit_tasks(packed: Packed, rows: DataFrame, sizes: DataFrame, k: int, lam: float, runs: int, iterations: int) -> DataFrame:
    """THEMES rows of all runs of the periods, each fitted in one task. sizes: (period_id, size), the terms of each period in rows."""
    sent = packed.sent

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            period, run = batch.column("period_id").to_numpy(), batch.column("run").to_numpy()
            borders = [0, *(np.flatnonzero((period[1:] != period[:-1]) | (run[1:] != run[:-1])) + 1), len(period)]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                if b > a:
                    key = int(period[a]), int(run[a])
                    if now is None or now.key != key:
                        if now is not None:
                            yield from now.fitted(*sent.value, k, lam, iterations)
                        now = Period(key)
                    now.add(batch.slice(a, b - a))
        if now is not None:
            yield from now.fitted(*sent.value, k, lam, iterations)

    seen = sizes.agg(F.count(F.lit(1)).alias("periods"), F.sum("size").alias("rows")).first()
    partitions = max(1, min(seen.periods * runs, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-(seen.rows or 0) * runs // (4 * BLOCK_ROWS)))))
    # the largest are dealt out first, so that no task has two while another has none
    place = F.row_number().over(Window.orderBy(F.desc("size"), "period_id", "run")) - 1
    slots = sizes.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).select("period_id", "run", F.pmod(place, F.lit(partitions)).cast("int").alias("slot"))
    told = rows.join(F.broadcast(slots) if seen.periods * runs <= BROADCAST_PERIODS else slots, "period_id")
    dealt = told.repartitionById(partitions, F.col("slot")).select("period_id", "run", "doc_id", "n", "ids", "cnts").sortWithinPartitions("period_id", "run", "doc_id")
    return dealt.mapInArrow(fit, THEMES)


def fit_packed(packed: Packed, k: int = 10, lam: float = 0.95, runs: int = 1, iterations: int = 25, task_rows: int | None = None) -> DataFrame:
    """THEMES rows, a written table: periods of up to task_rows terms (none: TASK_ROWS) in one task for each run, larger ones by the blocks of `em_blocks`."""
    ship_package(packed.rows.sparkSession)
    most = TASK_ROWS if task_rows is None else task_rows
    sizes = settle(packed.rows.groupBy("period_id").agg(F.sum("n").alias("size")), "sizes")
    small, large = sizes.where(F.col("size") <= most), sizes.where(F.col("size") > most)
    if large.isEmpty():
        return settle(fit_tasks(packed, packed.rows, sizes, k, lam, runs, iterations), "fitted")
    # a row per period
    of = lambda some: packed.rows.join(F.broadcast(some), "period_id", "left_semi").select(*(c.split()[0] for c in PACKED.split(", ")))
    by_blocks = fit_blocks(settle(unpacked(packed, of(large)), "terms"), packed.model, k, lam, runs, iterations)
    return by_blocks if small.isEmpty() else settle(fit_tasks(packed, of(small), small, k, lam, runs, iterations), "fitted").unionByName(by_blocks)


def fit_documents(docs: DataFrame, model: DataFrame, periods: DataFrame, k: int = 10, lam: float = 0.95, runs: int = 1, iterations: int = 25, min_tokens: int = 50, min_distinct: int = 50) -> DataFrame:
    """THEMES rows, a written table, of COUNTED rows, also a written table: packed, or as text where the vocabulary is too large for that."""
    packed = pack(docs, model, periods, k, min_tokens, min_distinct)
    if packed is None:
        return settle(fit_periods(settle(terms_of(docs, model, periods, min_tokens, min_distinct), "terms"), model, k, lam, runs, iterations), "fitted")
    return fit_packed(packed, k, lam, runs, iterations)
