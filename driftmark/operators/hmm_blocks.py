"""Training and decoding of the HMM on streams of any length.

The stream is dealt into blocks once (`BlockStore`): a bucketed table with a row per block. Every pass is a narrow one over it. What blocks need to know of each other is, where
models forget, told by the first and last words of their neighbours: two vectors a block. Otherwise it is small matrices, scanned along a tree: FAN blocks are a group, FAN groups a
larger one and so on, each level a table of its own. Going up, a group's matrices are multiplied; going down, a group hands each member what comes before and after it. A stream of
one group is scanned on the driver. No task and no driver holds more numbers than FAN matrices of N x N have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Shelf
from ..ship import ship_package
from .hmm import LOW, Hmm, Lanes, Moves, best_product, chained, emitted, expected_of_blocks, logs, normalised, nowhere, outlines, paths_of_blocks, scaled, thin, thin_scores, traced, train_local

#: Members of a group of the tree.
FAN = 1000
#: Words of a bucket of the store, about: those of one task in each pass.
BUCKET_WORDS = 4_000_000
#: Words times N**2 up to which a stream is trained on the driver.
SEQUENTIAL_BELOW = 5e7
#: Words of blocks that are worked through together, about.
LANE_WORDS = 1 << 17
#: Of each block its matrix m, or u and v where that is thin.
LEAVES = "id long, m binary, u binary, v binary"
BLOCKS = "block long, words binary, places binary, times binary, counts binary"


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def listed(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


class BlockStore:
    """A stream (pos, word_id and, where it has one, ts) in blocks of `block` places: one shuffle, then a table that is bucketed by block.

    A row has the words of a block in order, their places where some are missing, and the times as runs. `with` releases it.
    """

    def __init__(self, stream: DataFrame, block: int, buckets: int | None = None):
        self.spark: SparkSession = stream.sparkSession
        self.block, self.timed = block, "ts" in stream.columns
        self.shelf = Shelf(self.spark, "blocks")
        ship_package(self.spark)
        found = stream.agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b")).first()
        self.length = found.n
        self.first, self.last = (found.a // block, found.b // block) if found.n else (0, 0)
        self.buckets = buckets or max(1, min(self.last - self.first + 1, max(2 * self.spark.sparkContext.defaultParallelism, -(-found.n // BUCKET_WORDS))))
        self.name = self.shelf.root.rsplit("/", 1)[-1].replace("-", "_")
        timed = self.timed

        def fill(table: pa.Table) -> pa.Table:
            number = table.column("block")[0].as_py()
            place = table.column("place").to_numpy()
            order = np.argsort(place, kind="stable")
            row = {"block": number, "words": packed(table.column("word_id").to_numpy()[order]), "places": None, "times": None, "counts": None}
            if not np.array_equal(place[order], np.arange(len(place))):
                row["places"] = packed(place[order])
            if timed:
                ts = table.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy()[order]
                starts = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
                row["times"], row["counts"] = packed(ts[starts]), packed(np.diff(np.r_[starts, len(ts)]).astype(np.int32))
            return pa.Table.from_pylist([row], schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("words", "places", "times", "counts"))]))

        number = F.floor(F.col("pos") / block).cast("long")
        kept = stream.select(number.alias("block"), (F.col("pos") - number * block).cast("int").alias("place"), F.col("word_id").cast("int").alias("word_id"), *(["ts"] if timed else []))
        self.dealt = kept.repartition(self.buckets, "block").groupBy("block").applyInArrow(fill, BLOCKS)
        self.dealt.write.bucketBy(self.buckets, "block").option("path", f"{self.shelf.root}/store").option("compression", "zstd").mode("overwrite").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def __enter__(self) -> BlockStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.shelf.drop()

    def joined(self, known: DataFrame, few: bool = False) -> DataFrame:
        """The store's rows with what is known of each block; only the latter is shuffled, or broadcast where it is FAN rows at most (few)."""
        return self.rows.join(F.broadcast(known) if few else known.hint("shuffle_hash"), "block")


def climb(leaves: DataFrame, last: int, combine: Callable[[np.ndarray], np.ndarray], n: int, shelf: Shelf) -> list[DataFrame]:
    """The levels of the tree over (id, m) with ids from 0 to last, from the leaves to a level that is one group."""
    schema, levels, fan = pa.schema([("id", pa.int64()), ("m", pa.binary())]), [shelf.write(leaves, "level0")], FAN

    def product(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        ms = np.array([np.frombuffer(r["m"]).reshape(n, n) for r in rows])
        return pa.Table.from_pylist([{"id": rows[0]["id"] // fan, "m": packed(combine(ms))}], schema=schema)

    while last >= fan:
        last //= fan
        above = levels[-1].groupBy(F.expr(f"id div {fan}")).applyInArrow(product, "id long, m binary")
        levels.append(shelf.write(above, f"level{len(levels)}"))
    return levels


def descend(levels: list[DataFrame], root: dict, hand_down: Callable[[np.ndarray, dict], list[dict]], n: int, of: pa.Schema, spark_of: str) -> DataFrame:
    """What each leaf is handed: `root` belongs to the whole, and hand_down gives the members of a group theirs, from their matrices and the group's."""
    names, fan = of.names, FAN
    handed = levels[0].sparkSession.createDataFrame([(0, *root.values())], f"id long, {spark_of}")
    schema = pa.schema([("id", pa.int64()), *of])

    def group(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        found = hand_down(np.array([np.frombuffer(r["m"]).reshape(n, n) for r in rows]), {k: rows[0][k] for k in names})
        return pa.Table.from_pylist([{"id": r["id"], **x} for r, x in zip(rows, found, strict=True)], schema=schema)

    for level in reversed(levels):
        members = level.select("id", "m", F.expr(f"id div {fan}").alias("parent")).join(handed.withColumnRenamed("id", "parent"), "parent")
        handed = members.groupBy("parent").applyInArrow(group, f"id long, {spark_of}")
    return handed


def scanned(leaves: DataFrame, last: int, combine: Callable[[np.ndarray], np.ndarray], root: dict, hand_down: Callable[[np.ndarray, dict], list[dict]], n: int, of: pa.Schema, spark_of: str, shelf: Shelf) -> tuple[DataFrame, bool]:
    """What each leaf (id, m) is handed, and whether that is one group. One group is scanned here: FAN matrices at most meet on the driver, as they would in a task."""
    if last >= FAN:
        return descend(climb(leaves, last, combine, n, shelf), root, hand_down, n, of, spark_of), False
    rows = sorted(leaves.collect(), key=lambda r: r.id)
    found = hand_down(np.array([np.frombuffer(r.m).reshape(n, n) for r in rows]), root)
    return leaves.sparkSession.createDataFrame([(r.id, *x.values()) for r, x in zip(rows, found, strict=True)], f"id long, {spark_of}"), True


def summed(rows: DataFrame, parts: int, shelf: Shelf) -> list:
    """The sums of the arrays of (part, xi, gamma) over groups of FAN parts, level by level; what is left, FAN rows at most, meets here."""
    schema, fan, level = pa.schema([("part", pa.int64()), ("xi", pa.binary()), ("gamma", pa.binary())]), FAN, 0

    def group(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist([{"part": found[0]["part"] // fan, "xi": packed(sum(np.frombuffer(r["xi"]) for r in found)), "gamma": next((r["gamma"] for r in found if r["gamma"]), None)}], schema=schema)

    while parts > fan:
        level, parts = level + 1, -(-parts // fan)
        rows = shelf.write(rows.groupBy(F.expr(f"part div {fan}")).applyInArrow(group, "part long, xi binary, gamma binary"), f"sums{level}")
    return sorted(rows.collect(), key=lambda r: r.part)


def hand_down_vectors(ms: np.ndarray, group: dict) -> list[dict]:
    """Scaled forward values before, and backward ones after each member."""
    before, after = [np.frombuffer(group["before"])], [np.frombuffer(group["after"])]
    for m in ms[:-1]:
        before.append(scaled(before[-1] @ m))
    for m in ms[:0:-1]:
        after.append(scaled(m @ after[-1]))
    return [{"before": packed(x), "after": packed(y)} for x, y in zip(before, after[::-1], strict=True)]


def hand_down_states(ms: np.ndarray, group: dict) -> list[dict]:
    """The best states before and after each member. A begin of -1: before the stream; an end of -1: the best one."""
    n, begin, end = ms.shape[1], group["begin"], group["end"]
    score, came = chained(nowhere(n) if begin < 0 else np.where(np.arange(n) == begin, 0.0, 2 * LOW), ms)
    ends = traced(int(score.argmax()) if end < 0 else end, came)
    return [{"begin": a, "end": b} for a, b in zip([begin, *ends[:-1]], ends, strict=True)]


def full(leaves: DataFrame, outer: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(id, m) of LEAVES, with the matrices of thin ones."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in whole_batches(batches):
            m = row["m"] or packed(outer(np.frombuffer(row["u"]), np.frombuffer(row["v"])))
            yield listed([{"id": row["id"], "m": m}], pa.schema([("id", pa.int64()), ("m", pa.binary())]))

    return leaves.mapInArrow(fill, "id long, m binary")


def handed_on(leaves: DataFrame, last: int, outer: Callable, meet: Callable[[bytes | None, bytes, bytes, bytes | None], dict], combine: Callable[[np.ndarray], np.ndarray], root: dict, hand_down: Callable[[np.ndarray, dict], list[dict]], n: int, of: pa.Schema, spark_of: str, shelf: Shelf) -> tuple[DataFrame, bool]:
    """What each of LEAVES is handed, and whether that may be broadcast.

    Where all leaves are thin, each is told by its neighbours (meet: v of the one before, its own u and v, u of the one after). That is worked out here as long as it is no
    more numbers than FAN matrices, in tasks beyond. Where some are not thin, the tree is scanned.
    """
    if last >= FAN:
        leaves = shelf.write(leaves, "leaves")
        if leaves.agg(F.count("u").alias("n")).first().n <= last:
            return scanned(full(leaves, outer), last, combine, root, hand_down, n, of, spark_of, shelf)
        if 2 * (last + 1) > FAN * n:
            near = leaves.join(leaves.select((F.col("id") + 1).alias("id"), F.col("v").alias("left")), "id", "left").join(leaves.select((F.col("id") - 1).alias("id"), F.col("u").alias("right")), "id", "left")

            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                schema = pa.schema([("id", pa.int64()), *of])
                for batch in batches:
                    yield listed([{"id": r["id"], **meet(r["left"], r["u"], r["v"], r["right"])} for r in batch.to_pylist()], schema)

            return near.select("id", "left", "u", "v", "right").mapInArrow(each, f"id long, {spark_of}"), False
    rows = sorted(leaves.collect(), key=lambda r: r.id)
    if len(rows) == last + 1 and all(r.u is not None for r in rows):
        found = [meet(a and a.v, r.u, r.v, b and b.u) for a, r, b in zip([None, *rows[:-1]], rows, [*rows[1:], None], strict=True)]
    else:
        found = hand_down(np.array([np.frombuffer(r.m).reshape(n, n) if r.m is not None else outer(np.frombuffer(r.u), np.frombuffer(r.v)) for r in rows]), root)
    return leaves.sparkSession.createDataFrame([(r.id, *x.values()) for r, x in zip(rows, found, strict=True)], f"id long, {spark_of}"), True


def groups_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Blocks with LANE_WORDS words or a little more together, so that short blocks are worked through side by side, too."""
    held, n = [], 0
    for row in whole_batches(batches):
        row["words"] = np.frombuffer(row["words"], np.int32)
        held.append(row)
        n += len(row["words"])
        if n >= LANE_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def place_of(rows: list[dict], first: int) -> int:
    return next((i for i, r in enumerate(rows) if r["block"] == first), -1)


def leaf_rows(rows: list[dict], found: list[tuple], first: int) -> pa.RecordBatch:
    values = [{"id": r["block"] - first, **{k: None if x is None else packed(x) for k, x in zip("muv", f, strict=True)}} for r, f in zip(rows, found, strict=True)]
    return listed(values, pa.schema([("id", pa.int64()), *((c, pa.binary()) for c in "muv")]))


def step(store: BlockStore, model: Hmm, sent: Broadcast | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One Baum-Welch step: new pi and transition sums. sent: `emitted` of the model's emissions, which stay the same over all steps."""
    spark, n, first = store.spark, model.n, store.first
    own = sent is None
    sent = spark.sparkContext.broadcast(emitted(model.b)) if own else sent
    a = model.a

    def multiplied(ms: np.ndarray) -> np.ndarray:
        m = ms[0]
        for x in ms[1:]:
            m = scaled(m @ x, (0, 1))
        return m

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, emits = Moves(a), sent.value
        for rows in groups_of_blocks(batches):
            blocks = [r["words"] for r in rows]
            forgets = [bool(a[:, 0].min() > 0 and emits[0][x].min() > 0) for x in blocks]
            found = outlines(blocks, place_of(rows, first), lambda x, at: [multiplied(ms) for ms in Lanes(emits, x, at).products(moves)], thin, forgets)
            yield leaf_rows(rows, found, first)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, start, moves = np.zeros((n, n)), None, Moves(a)
        for rows in groups_of_blocks(batches):
            at = place_of(rows, first)
            xi, gamma = expected_of_blocks(sent.value, moves, [r["words"] for r in rows], at, [np.frombuffer(r["before"]) for r in rows], [np.frombuffer(r["after"]) for r in rows])
            total += xi
            start = gamma[at] if at >= 0 else start
        yield listed([{"part": TaskContext.get().partitionId(), "xi": packed(total), "gamma": None if start is None else packed(start)}], pa.schema([("part", pa.int64()), ("xi", pa.binary()), ("gamma", pa.binary())]))

    root = {"before": packed(model.pi), "after": packed(np.ones(n))}

    def meet(left: bytes | None, u: bytes, v: bytes, right: bytes | None) -> dict:
        return {"before": left or root["before"], "after": right or root["after"]}

    with Shelf(spark, "step") as shelf:
        leaves = store.rows.select("block", "words").mapInArrow(product, LEAVES)
        vectors = pa.schema([("before", pa.binary()), ("after", pa.binary())])
        handed, few = handed_on(leaves, store.last - first, np.outer, meet, multiplied, root, hand_down_vectors, n, vectors, "before binary, after binary", shelf)
        known = store.joined(handed.select((F.col("id") + first).alias("block"), "before", "after"), few).select("block", "words", "before", "after")
        found = summed(known.mapInArrow(expect, "part long, xi binary, gamma binary"), store.buckets, shelf)
    if own:
        sent.unpersist()
    return np.frombuffer(next(r.gamma for r in found if r.gamma)), sum(np.frombuffer(r.xi) for r in found).reshape(n, n)


def train(stream: DataFrame | BlockStore, model: Hmm, block: int = 65536, pi_threshold: float = 0.01, a_threshold: float = 0.01, max_iterations: int = 50, sequential_below: float = SEQUENTIAL_BELOW, force_sequential: bool = False) -> Hmm:
    """Baum-Welch with fixed emissions. A stream with fewer than sequential_below / N**2 words goes to the driver, with force_sequential any stream does; a store is
    trained in its blocks."""
    if isinstance(stream, BlockStore):
        if not stream.length:
            return model
        sent = stream.spark.sparkContext.broadcast(emitted(model.b))
        for _ in range(max_iterations):
            pi, xi = step(stream, model, sent)
            a = normalised(xi, model.a)
            done = np.abs(pi - model.pi).sum() < pi_threshold and np.abs(a - model.a).sum() < a_threshold
            model = Hmm(pi, a, model.b)
            if done:
                break
        sent.unpersist()
        return model
    if force_sequential or stream.count() * model.n**2 <= sequential_below:
        obs = stream.orderBy("pos").select("word_id").toPandas()["word_id"].to_numpy()
        return train_local(model, obs, pi_threshold, a_threshold, max_iterations) if len(obs) else model
    with BlockStore(stream.select("pos", "word_id"), block) as store:
        return train(store, model, block, pi_threshold, a_threshold, max_iterations)


def decode(stream: DataFrame | BlockStore, model: Hmm, block: int = 131072) -> DataFrame:
    """(pos, state), and ts where the stream has it, by Viterbi; a written table. Ties go to the lowest state."""
    if not isinstance(stream, BlockStore):
        with BlockStore(stream, block) as store:
            return decode(store, model)
    store, n, first, width = stream, model.n, stream.first, stream.block
    spark, a, pi = store.spark, model.a, logs(model.pi)
    sent = spark.sparkContext.broadcast(emitted(logs(model.b), 0.0))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, emits = Moves(a), sent.value
        for rows in groups_of_blocks(batches):
            blocks = [r["words"] for r in rows]
            forgets = [bool(a[:, 0].min() > 0 and emits[0][x].min() > LOW) for x in blocks]
            yield leaf_rows(rows, outlines(blocks, place_of(rows, first), lambda x, at: [best_product(ms) for ms in Lanes(emits, x, at).best_products(pi, moves)], thin_scores, forgets), first)

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Moves(a)
        for rows in groups_of_blocks(batches):
            found = paths_of_blocks(sent.value, pi, moves, [r["words"] for r in rows], place_of(rows, first), [r["begin"] for r in rows], [r["end"] for r in rows])
            for row, states in zip(rows, found, strict=True):
                places = np.arange(len(states)) if row["places"] is None else np.frombuffer(row["places"], np.int32)
                columns = {"pos": pa.array(row["block"] * width + places, pa.int64()), "state": pa.array(states, pa.int32())}
                if row["times"] is not None:
                    ts = np.repeat(np.frombuffer(row["times"], np.int64), np.frombuffer(row["counts"], np.int32))
                    columns["ts"] = pa.array(ts, pa.int64()).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_pydict(columns)

    def outer(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.maximum(u[:, None] + v, 2 * LOW)

    def meet(left: bytes | None, u: bytes, v: bytes, right: bytes | None) -> dict:
        at = np.frombuffer
        begin = -1 if left is None else int((at(left) + at(u)).argmax())
        return {"begin": begin, "end": int((at(v) if right is None else at(v) + at(right)).argmax())}

    of = "pos long, state int" + (", ts timestamp" if store.timed else "")
    out = Shelf(spark, "decoded")
    if not store.length:
        return spark.createDataFrame([], of)
    with Shelf(spark, "decode") as shelf:
        leaves = store.rows.select("block", "words").mapInArrow(reach, LEAVES)
        borders = pa.schema([("begin", pa.int32()), ("end", pa.int32())])
        handed, few = handed_on(leaves, store.last - first, outer, meet, best_product, {"begin": -1, "end": -1}, hand_down_states, n, borders, "begin int, end int", shelf)
        found = store.joined(handed.select((F.col("id") + first).alias("block"), "begin", "end"), few).mapInArrow(path, of)
        return out.write(found, "states")
