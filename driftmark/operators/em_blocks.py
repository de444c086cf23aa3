"""Expectation-maximisation of periods of any size.

A period's documents are dealt into blocks once: a row per block, holding its (document, word, count) triples as arrays, 12 bytes each. A period of up to GROUP_ROWS triples is fitted in one
task over its blocks. Of larger ones the blocks are a bucketed table: in each iteration a block pulls the state of the words it has, works through its triples, keeps the state of its documents and pushes one sum per word; words are summed and scaled by key. So an
iteration shuffles word states, once for each block that has the word, and never the triples, and no task holds more than a block and its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import BROADCAST_PERIODS
from ..shared import Shelf, settle
from ..ship import ship_package
from .em import THEMES, document_likelihoods, drawn_weights, init_weight, mixture_step, scaled

#: Triples of a block, about.
BLOCK_ROWS = 1_000_000
#: Triples of a period up to which one task fits it: 290 MB as blocks.
GROUP_ROWS = 24_000_000
STORE = "bucket long, period_id int, docs binary, doc binary, word binary, cnt binary, pb binary, words array<string>"
PUSHED = "bucket long, period_id int, word string, s array<double>, pi binary, ll double, n long"


def arrays(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch with numpy arrays for binary columns."""
    kinds = {"docs": np.int64, "doc": np.int32, "word": np.int32, "cnt": np.int32, "pb": np.float64, "pi": np.float64}
    for i in range(batch.num_rows):
        row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
        yield {k: (np.frombuffer(v.as_py(), kinds[k]) if v.is_valid else None) if k in kinds else v for k, v in row.items()}


def term_blocks(terms: DataFrame, sizes: DataFrame, block_rows: int, partitions: int) -> DataFrame:
    """STORE rows of terms (period_id, doc_id, word, cnt, pb): documents in blocks of about block_rows triples. sizes: (period_id, n), the triples of each period."""
    ship_package(terms.sparkSession)
    schema = pa.schema([("bucket", pa.int64()), ("period_id", pa.int32()), *((c, pa.binary()) for c in ("docs", "doc", "word", "cnt", "pb")), ("words", pa.list_(pa.string()))])

    def fill(table: pa.Table) -> pa.Table:
        found = table["word"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(found.dictionary).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        word = place[found.indices.to_numpy()]
        docs, doc = np.unique(table["doc_id"].to_numpy(), return_inverse=True)
        rows = np.lexsort((word, doc))
        pb = np.empty(len(order))
        pb[word] = table["pb"].to_numpy()
        packed = [x.tobytes() for x in (docs.astype(np.int64), doc[rows].astype(np.int32), word[rows], table["cnt"].to_numpy()[rows].astype(np.int32), pb)]
        values = [table["bucket"][0].as_py(), table["period_id"][0].as_py(), *packed, found.dictionary.take(pa.array(order)).to_pylist()]
        return pa.Table.from_arrays([pa.array([v], t.type) for v, t in zip(values, schema, strict=True)], schema=schema)

    count = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("long")
    block = F.shiftleft(F.col("period_id").cast("long"), 32) + F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    # a row per period
    told = terms.join(F.broadcast(sizes.select("period_id", count.alias("blocks"))), "period_id")
    kept = told.select(block.alias("bucket"), "period_id", "doc_id", "word", F.col("cnt").cast("int").alias("cnt"), "pb")
    return kept.repartition(partitions, "bucket").groupBy("bucket").applyInArrow(fill, STORE)


def period_sizes(terms: DataFrame) -> DataFrame:
    return terms.groupBy("period_id").agg(F.count(F.lit(1)).alias("n"))


class TermStore:
    """terms (period_id, doc_id, word, cnt, pb) in blocks of documents, and which words each block needs. `with` releases both."""

    def __init__(self, terms: DataFrame, block_rows: int | None = None, buckets: int | None = None):
        self.spark: SparkSession = terms.sparkSession
        self.shelf = Shelf(self.spark, "terms")
        each, parallel = block_rows or BLOCK_ROWS, self.spark.sparkContext.defaultParallelism
        sizes = self.shelf.write(period_sizes(terms), "sizes")
        seen = sizes.agg(F.sum(F.ceil(F.col("n") / each)).alias("blocks"), F.sum("n").alias("rows")).first()
        self.buckets = buckets or max(1, min(seen.blocks or 0, max(2 * parallel, -(-(seen.rows or 0) // (4 * BLOCK_ROWS)))))
        self.names = []
        self.rows = self.saved(term_blocks(terms, sizes, each, self.buckets), "bucket")
        needs = self.rows.select("bucket", "period_id", F.posexplode("words").alias("at", "word"))
        self.needs = self.saved(needs.repartition(self.buckets, "period_id", "word"), "period_id", "word")

    def saved(self, df: DataFrame, *key: str) -> DataFrame:
        name = f"{self.shelf.root.rsplit('/', 1)[-1]}_{len(self.names)}".replace("-", "_")
        df.write.bucketBy(self.buckets, *key).option("path", f"{self.shelf.root}/{name}").option("compression", "zstd").mode("overwrite").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def __enter__(self) -> TermStore:
        return self

    def __exit__(self, *_: object) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.shelf.drop()


def word_states(sums: DataFrame, k: int, buckets: int) -> DataFrame:
    """(period_id, word, pw): sums (.., s) of each word added up and scaled to 1 by theme."""
    per_word = sums.repartition(buckets, "period_id", "word").groupBy("period_id", "word").agg(*(F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(k)))
    totals = sums.groupBy("period_id").agg(*(F.sum(F.col("s")[j]).alias(f"t{j}") for j in range(k)))
    pw = F.array(*(F.coalesce(F.try_divide(F.col(f"s{j}"), F.col(f"t{j}")), F.lit(0.0)) for j in range(k)))
    # a row per period
    return per_word.join(F.broadcast(totals) if totals.count() <= BROADCAST_PERIODS else totals, "period_id").select("period_id", "word", pw.alias("pw"))


def blocks_with_words(store: TermStore, words: DataFrame, state: DataFrame | None) -> DataFrame:
    """The store's rows, the states of their words in order (pulled), and of their documents (pi; null: at the start)."""
    pulled = store.needs.join(words, ["period_id", "word"]).repartition(store.buckets, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("at", "pw"))).alias("pulled"))
    met = store.rows.join(pulled.select("bucket", F.flatten(F.transform("pulled", lambda x: x["pw"])).alias("pulled")).hint("shuffle_hash"), "bucket")
    if state is None:
        return met.withColumn("pi", F.lit(None).cast("binary"))
    return met.join(state.select("bucket", "pi").hint("shuffle_hash"), "bucket")


def state_of(row: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    pw = row["pulled"].values.to_numpy(zero_copy_only=False).reshape(-1, k).T
    n = len(row["docs"])
    return np.full((n, k), 1.0 / k) if row["pi"] is None else row["pi"].reshape(n, k), pw


def fit_run(store: TermStore, run: int, k: int, lam: float, iterations: int, shelf: Shelf) -> DataFrame:
    """THEMES rows of one run of all the store's periods."""
    pushed = pa.schema([("bucket", pa.int64()), ("period_id", pa.int32()), ("word", pa.string()), ("s", pa.list_(pa.float64())), ("pi", pa.binary()), ("ll", pa.float64()), ("n", pa.int64())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One iteration of each block: a row with the documents' state, and one with the sum of each word."""
        for batch in batches:
            for row in arrays(batch):
                pi, pw = state_of(row, k)
                pi, sums = mixture_step(row["doc"], row["word"], row["cnt"], row["pb"], pi, pw, lam)
                n, bucket, period = sums.shape[1], row["bucket"].as_py(), row["period_id"].as_py()
                yield pa.RecordBatch.from_pylist([{"bucket": bucket, "period_id": period, "pi": np.ascontiguousarray(pi).tobytes()}], schema=pushed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(sums.T).ravel()))
                none = lambda kind: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([none(pa.int64()), pa.array(np.full(n, period, np.int32)), row["words"].values, lists, none(pa.binary()), none(pa.float64()), none(pa.int64())], schema=pushed)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in arrays(batch):
                pi, pw = state_of(row, k)
                each = document_likelihoods(row["doc"], row["word"], row["cnt"], row["pb"], pi, pw, lam)
                yield pa.RecordBatch.from_pylist([{"bucket": row["bucket"].as_py(), "period_id": row["period_id"].as_py(), "ll": float(each.sum()), "n": len(each)}], schema=pushed)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in arrays(batch):
                n, pi = len(row["docs"]), state_of(row | {"pulled": pa.scalar([], pa.list_(pa.float64()))}, k)[0]
                yield pa.RecordBatch.from_pydict({"period_id": pa.array(np.full(n * k, row["period_id"].as_py(), np.int32)), "doc_id": np.repeat(row["docs"], k), "theme": np.tile(np.arange(k, dtype=np.int32), n), "p": pi.ravel()})

    # the first sums are the drawn weights
    drawn = F.array(*(init_weight(F.col("word"), j, run).cast("double") for j in range(k)))
    sums, state = store.needs.select("period_id", "word").distinct().select("period_id", "word", drawn.alias("s")), None
    for i in range(iterations):
        out = shelf.write(blocks_with_words(store, word_states(sums, k, store.buckets), state).mapInArrow(step, PUSHED), f"run{run}-{i}")
        sums, state = out.where("word is not null").select("period_id", "word", "s"), out.where("pi is not null")
        if i > 1:
            shelf.drop(f"run{run}-{i - 2}")
    words = shelf.write(word_states(sums, k, store.buckets), f"words{run}")
    state = state if state is not None else store.rows.select("bucket", F.lit(None).cast("binary").alias("pi"))
    found = blocks_with_words(store, words, state).mapInArrow(likelihood, PUSHED).groupBy("period_id").agg((F.sum("ll") / F.sum("n")).alias("ll"))
    pi = store.rows.select("bucket", "period_id", "docs").join(state.select("bucket", "pi").hint("shuffle_hash"), "bucket").mapInArrow(shares, "period_id int, doc_id long, theme int, p double")
    of_words = words.select("period_id", "word", F.posexplode("pw").alias("theme", "p"))
    rows = pi.select("period_id", F.lit("pi").alias("kind"), "theme", "doc_id", F.lit(None).cast("string").alias("word"), "p").unionByName(
        of_words.select("period_id", F.lit("word").alias("kind"), "theme", F.lit(None).cast("long").alias("doc_id"), "word", "p"))
    found = shelf.write(found, f"ll{run}")
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST_PERIODS else found, "period_id").withColumn("run", F.lit(run)).select(*(c.split()[0] for c in THEMES.split(", ")))


def fit_blocks(terms: DataFrame, background: DataFrame, k: int = 10, lam: float = 0.95, runs: int = 1, iterations: int = 25, block_rows: int | None = None) -> DataFrame:
    """What `extract_themes` gives, by blocks; a written table."""
    rows = terms.join(background.select("word", F.col("p").alias("pb")), "word")
    kept = Shelf(terms.sparkSession, "themes")
    with TermStore(rows, block_rows) as store, Shelf(terms.sparkSession, "em") as shelf:
        out = [kept.write(fit_run(store, run, k, lam, iterations, shelf), f"run{run}") for run in range(runs)]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def fit_groups(blocks: DataFrame, k: int, lam: float, runs: int, iterations: int) -> DataFrame:
    """THEMES rows of all runs of the periods, each fitted in one task over its blocks (STORE rows), which stay packed."""

    def fit(table: pa.Table) -> pa.Table:
        period, run = table["period_id"][0].as_py(), table["run"][0].as_py()
        parts = sorted((row for batch in table.select(["bucket", *(c.split()[0] for c in STORE.split(", ")[2:])]).to_batches() for row in arrays(batch)), key=lambda row: row["bucket"].as_py())
        words = pa.concat_arrays([row["words"].values for row in parts]).unique()
        words = words.take(pc.sort_indices(words))
        at = [pc.index_in(row["words"].values, value_set=words).to_numpy() for row in parts]
        pw, pi = drawn_weights(words.to_pylist(), k, run), [np.full((len(row["docs"]), k), 1.0 / k) for row in parts]
        for _ in range(iterations):
            sums = np.zeros(pw.shape)
            for i, row in enumerate(parts):
                pi[i], own = mixture_step(row["doc"], row["word"], row["cnt"], row["pb"], pi[i], pw[:, at[i]], lam)
                sums[:, at[i]] += own
            pw = scaled(sums)
        ll = float(np.concatenate([document_likelihoods(row["doc"], row["word"], row["cnt"], row["pb"], pi[i], pw[:, at[i]], lam) for i, row in enumerate(parts)]).mean())
        docs = np.concatenate([row["docs"] for row in parts])
        a, b, themes = len(docs) * k, len(words) * k, np.arange(k, dtype=np.int32)
        columns = [
            np.full(a + b, period, np.int32), np.full(a + b, run, np.int32), np.full(a + b, ll), pa.concat_arrays([pa.repeat("pi", a), pa.repeat("word", b)]),
            np.concatenate([np.tile(themes, len(docs)), np.repeat(themes, len(words))]), pa.concat_arrays([pa.array(np.repeat(docs, k)), pa.nulls(b, pa.int64())]),
            pa.concat_arrays([pa.nulls(a, pa.string()), *(k * [words])]), np.concatenate([*(x.ravel() for x in pi), pw.ravel()])]
        return pa.table(columns, names=[c.split()[0] for c in THEMES.split(", ")])

    rows = blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return rows.groupBy("period_id", "run").applyInArrow(fit, THEMES)


def fit_periods(terms: DataFrame, background: DataFrame, k: int = 10, lam: float = 0.95, runs: int = 1, iterations: int = 25, group_rows: int | None = None) -> DataFrame:
    """What `extract_themes` gives, with each period fitted as its size demands: up to group_rows triples (none: GROUP_ROWS) in one task for each run, larger ones by blocks.

    terms are read twice, so they should be a written table.
    """
    most = GROUP_ROWS if group_rows is None else group_rows
    rows = terms.join(background.select("word", F.col("p").alias("pb")), "word")
    sizes = settle(period_sizes(rows), "sizes")
    seen = sizes.agg(F.count_if(F.col("n") > most).alias("large"), F.count_if(F.col("n") <= most).alias("small"), F.sum(F.when(F.col("n") <= most, F.ceil(F.col("n") / BLOCK_ROWS))).alias("blocks")).first()
    if seen.large and not seen.small:
        return fit_blocks(terms, background, k, lam, runs, iterations)
    # a row per period
    of = lambda df, large: df.join(F.broadcast(sizes.where(F.col("n") > most if large else F.col("n") <= most)), "period_id", "left_semi")
    partitions = max(1, min(seen.blocks or 0, max(2 * terms.sparkSession.sparkContext.defaultParallelism, -(-(seen.blocks or 0) // 4))))
    found = fit_groups(term_blocks(of(rows, False) if seen.large else rows, sizes, BLOCK_ROWS, partitions), k, lam, runs, iterations)
    return found if not seen.large else found.unionByName(fit_blocks(of(terms, True), background, k, lam, runs, iterations))
