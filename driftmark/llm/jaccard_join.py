"""Set-similarity self-join on word shingles by prefix filtering under several token orders.

1. Each text becomes its set of shingle hashes; texts with one set are one node (a 128-bit signature of the set). Map tasks combine
   what their own nodes share, so that no task and no row grows with the number of copies.
2. A token that only one node has cannot be part of an intersection. A node that shares less than its least intersection is
   done. The rest is counted again among itself, which gives document frequencies.
3. Orders: rare tokens first, ties by hash, with another hash for each order. Two nodes are candidates only if their prefixes share as many tokens
   as a similar pair of their sizes has to, one at least, under every order. Only candidates are verified, on their whole sets, each pair in a row of its own.
4. What is asked for is which nodes are connected, so pairs within a component need no verification. Hub rounds come first: of
   each list of nodes with one prefix token one node is the hub, and the others are paired with it; the components of the links found are merged.
   Then all candidates are proposed whose nodes are still in different components, each where its first shared token is. Long lists are dealt out in tiles
   of TILE by TILE nodes.

Shingles go by 64-bit hashes (48 bits and the number of a partition). Two sets of 300 shingles have a false match with a chance of
300 * 300 / 2**48 at most, about 3e-10, and it matters only where the similarity is just below the limit.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship_package
from .common import Scratch, binary_rows, partitions_for, slices_by_bytes, utf8_parts
from .words import U64, Words, mix, sequences, stream

SHINGLE = 5
#: Similarity as a percentage of the union.
PERCENT = 80
BATCH_BYTES, BATCH_ROWS = 1_000_000, 50_000
#: Sets that a task unpacks at a time.
SETS = 500
#: MB of Parquet input for each task that counts tokens.
COUNT_MB = 4
#: Rounds in which lists are reduced by hubs, and nodes of a list that meet in one tile.
HUB_ROUNDS, TILE = 2, 256
#: Place of a token that a map task has found with several of its own nodes.
KNOWN = 0xFFFF

#: kind 0: the nodes of a chunk (NODE each); 1: shared tokens of a chunk's nodes; 2: tokens to be counted. A chunk is what a map task handles at a time.
ROWS = "kind int, target int, chunk long, blob binary"
#: kind 0: a document and its node; 1: a node that shares enough, with its shared tokens and their document frequencies.
FOUND = "kind int, doc_id long, sig1 long, sig2 long, n int, blob binary, df binary"
#: A node that may have similar ones: weight (mean document frequency), its prefixes under the orders after `lead` tokens that no other node has, its shared tokens.
NODES = "sig1 long, sig2 long, n int, weight double, lead int, first array<long>, second array<long>, blob binary"
NODE = np.dtype([("doc", np.int64), ("null", np.bool_), ("s1", np.int64), ("s2", np.int64), ("n", np.int32)])


def least_overlap(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """The least intersection that a set of size n has with any similar one."""
    return -(-n * percent // 100)


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of each distinct shingle, sorted; a text of fewer words has its whole sequence as one."""
    words = Words(raw, at)
    h, count, n = words.hashes(lower=True), words.count, len(at) - 1
    keys, doc = sequences(h, k), np.repeat(np.arange(n), count)
    inside = np.flatnonzero(doc[: len(keys)] == doc[k - 1 :]) if len(keys) else np.zeros(0, np.int64)
    docs, tokens = [doc[inside]], [keys[inside]]
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            codes = stream(m, 50 + m)
            docs.append(short)
            tokens.append(mix(sum(h[words.first[short] + i] * codes[i] for i in range(m)) + U64(m)))
    d, t = np.concatenate(docs), np.concatenate(tokens)
    order = np.lexsort((t, d))
    d, t = d[order], t[order]
    fresh = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])][: len(d)]
    return d[fresh], t[fresh]


def batch_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, target, chunk, blob = zip(*rows, strict=True)
    return pa.record_batch([pa.array(kind, pa.int32()), pa.array(target, pa.int32()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], ["kind", "target", "chunk", "blob"])


def home(chunk: int, parts: int) -> int:
    """The partition where what belongs to a chunk is gathered. Chunk numbers have the task's number in their high bits, so all bits have to count."""
    return (int(chunk) * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % parts


def packed(chunk: int, node: np.ndarray, token: np.ndarray, parts: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of kind 2 per target partition: 48 bits of each token (the partition has the rest) and the node's place in the chunk, 8 bytes in all."""
    part = (token % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, place, token = part[order], node[order].astype(np.uint16), token[order]
    high, low = (token >> U64(32)).astype(np.uint32), (token >> U64(16)).astype(np.uint16)
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    for a, b in itertools.pairwise([*edge, len(part)]):
        yield 2, int(part[a]), chunk, high[a:b].tobytes() + low[a:b].tobytes() + place[a:b].tobytes()


def shared_rows(chunk: np.ndarray, node: np.ndarray, token: np.ndarray, df: np.ndarray, parts: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of kind 1 per chunk: places, tokens and document frequencies."""
    order = np.argsort(chunk, kind="stable")
    chunk, node, token, df = chunk[order], node[order].astype(np.uint16), token[order], df[order].astype(np.int32)
    edge = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]][: len(chunk)])
    for a, b in itertools.pairwise([*edge, len(chunk)]):
        yield 1, home(chunk[a], parts), int(chunk[a]), token[a:b].tobytes() + df[a:b].tobytes() + node[a:b].tobytes()


def name_of(token: np.ndarray, parts: int) -> np.ndarray:
    """What is left of a token after packing: 48 bits and the number of its partition."""
    return (token >> U64(16)) | ((token % U64(parts)) << U64(48))


def mapped(raw: np.ndarray, at: np.ndarray, doc_ids: pa.Array, chunk: int, parts: int, k: int) -> pa.RecordBatch:
    """Step 1 for a chunk. Tokens that several of its nodes have are sent to be counted once."""
    doc, token = shingle_sets(raw, at, k)
    n = len(at) - 1
    table = np.zeros(n, NODE)
    table["doc"], table["null"], table["n"] = doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), np.bincount(doc, minlength=n)
    if len(doc):
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        for name, salt in (("s1", 1), ("s2", 0x5851F42D4C957F2D)):
            table[name][doc[begin]] = np.add.reduceat(mix(token ^ U64(salt)), begin).view(np.int64)
    # of documents with one set only the first is a node
    _, first = np.unique(table[["s1", "s2", "n"]], return_index=True)
    chosen = np.zeros(n, bool)
    chosen[first] = True
    node, token = doc[chosen[doc]], token[chosen[doc]]
    rows = [(0, home(chunk, parts), chunk, table.tobytes())]
    order = np.argsort(token, kind="stable")
    same = token[order][1:] == token[order][:-1]
    several, head = np.zeros(len(token), bool), np.zeros(len(token), bool)
    several[order] = (np.r_[False, same] | np.r_[same, False])[: len(token)]
    head[order] = np.r_[True, ~same][: len(token)]
    if several.any():
        own = int(several.sum())
        rows += shared_rows(np.full(own, chunk), node[several], name_of(token[several], parts), np.full(own, 2), parts)
    send = ~several | head
    rows += packed(chunk, np.where(several, KNOWN, node)[send], token[send], parts)
    return batch_of(rows)


def counted(rows: list[tuple[int, int, bytes]], parts: int) -> list[tuple[int, int, int, bytes]]:
    """Step 2 for the rows of kind 2 of one partition: the pairs whose token occurs more than once, by chunk."""
    tokens, places, chunks = [], [], []
    for target, chunk, blob in rows:
        m = len(blob) // 8
        high, low, place = np.frombuffer(blob, np.uint32, m), np.frombuffer(blob, np.uint16, m, 4 * m), np.frombuffer(blob, np.uint16, m, 6 * m)
        tokens.append((U64(target & 0xFFFF) << U64(48)) | (high.astype(U64) << U64(16)) | low)
        places.append(place)
        chunks.append(np.full(m, chunk, np.int64))
    if not tokens:
        return []
    token, place, chunk = np.concatenate(tokens), np.concatenate(places), np.concatenate(chunks)
    order = np.argsort(token)
    token = token[order]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.r_[begin, len(token)])
    df = np.repeat(size, size)
    keep = df > 1
    order = order[keep]
    real = place[order] != KNOWN
    return list(shared_rows(chunk[order][real], place[order][real], token[keep][real], df[keep][real], parts))


def gathered(chunk: list[tuple[int, bytes]], percent: int, documents: bool) -> Iterator[pa.RecordBatch]:
    """Step 2 for one chunk: its documents (if asked for), and its nodes that share their least overlap."""
    table = np.frombuffer(next(b for kind, b in chunk if kind == 0), NODE)
    names = ["kind", "doc_id", "sig1", "sig2", "n", "blob", "df"]
    if documents:
        none = pa.nulls(len(table), pa.binary())
        yield pa.record_batch([pa.array(np.zeros(len(table), np.int32)), pa.array(table["doc"].copy(), mask=table["null"].copy()), *(pa.array(table[c].copy()) for c in ("s1", "s2", "n")), none, none], names)
    blobs = [b for kind, b in chunk if kind == 1]
    if not blobs:
        return
    size = [len(b) // 14 for b in blobs]
    token, df, node = (np.concatenate([np.frombuffer(b, t, m, o * m) for b, m in zip(blobs, size, strict=True)]) for t, o in ((U64, 0), (np.int32, 8), (np.uint16, 12)))
    alive = 100 * np.bincount(node, minlength=len(table)) >= percent * table["n"]
    keep = alive[node]
    order = np.argsort(node[keep], kind="stable")
    node, token, df = node[keep][order], token[keep][order], df[keep][order]
    begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
    own = table[node[begin]]
    yield pa.record_batch([pa.array(np.ones(len(own), np.int32)), pa.nulls(len(own), pa.int64()), *(pa.array(own[c].copy()) for c in ("s1", "s2", "n")), binary_rows(token, begin), binary_rows(df, begin)], names)


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - least_overlap(n, percent) + 1


def prefixes(n: int, token: np.ndarray, df: np.ndarray, percent: int) -> list[np.ndarray]:
    """The prefix under each order, without the tokens that no other node has (these come first in each)."""
    length = prefix_length(n, percent) - (n - len(token))
    if length <= 0:
        return []
    return [token[np.lexsort((key, df))[:length]] for key in (token, mix(token ^ U64(0x2545F4914F6CDD1D)))]


def connected(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the least node reachable over links (x, y), for nodes that have any.

    Labels spread over the links and to the labels' own labels until none changes.
    """
    ends = links.select(F.col("x").alias("node"), F.col("y").alias("hub"))
    both = scratch.write(ends.union(ends.select("hub", "node")), f"{name}_links")
    labels, step = both.groupBy("node").agg(F.least("node", F.min("hub")).alias("label")), 0
    while True:
        labels = labels.withColumnsRenamed({"node": "at", "label": "old"})
        near = both.join(labels, F.col("hub") == F.col("at")).groupBy("node").agg(F.min("old").alias("near"))
        spread = labels.join(near, F.col("at") == F.col("node"), "left").select(F.col("at").alias("node"), "old", F.least("old", F.coalesce("near", "old")).alias("label"))
        jump = spread.select(F.col("node").alias("to"), F.col("label").alias("further"))
        fresh = scratch.write(spread.join(jump, F.col("label") == F.col("to"), "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), f"{name}{step}")
        moved = fresh.where(F.col("label") != F.col("old")).limit(1).count()
        labels = fresh.select("node", "label")
        scratch.drop(*([f"{name}{step - 1}"] if step else []))
        if not moved:
            scratch.drop(f"{name}_links")
            return labels
        step += 1


def shared_at_least(a: str, b: str, percent: int) -> Column:
    """Tokens that the prefixes of similar sets of sizes a and b share at least.

    The intersection has percent * (a + b) / (100 + percent) tokens. Of the set whose prefix ends first in the order, what is not in the prefix is
    least_overlap - 1 tokens; all its other shared tokens are in both prefixes.
    """
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent} - ({percent} * greatest({a}, {b}) + 99) div 100 + 1")


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose prefixes share enough tokens under both orders, and that are similar."""
    own = [nodes.select(*[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "first", "second")]) for side in "xy"]
    met = pairs.join(own[0], F.col("x") == F.col("node_x")).join(own[1], F.col("y") == F.col("node_y"))
    enough = [F.size(F.array_intersect(f"{c}_x", f"{c}_y")) >= shared_at_least("n_x", "n_y", percent) for c in ("first", "second")]
    met = met.where(enough[0] & enough[1]).select("x", "y", "n_x", "n_y")
    for side in "xy":
        met = met.join(nodes.select(F.col("node").alias("of"), F.col("blob").alias(f"blob_{side}")), F.col(side) == F.col("of")).drop("of")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SETS) for b in batches for i in range(0, b.num_rows, SETS)):
            n_x, n_y = (batch.column(c).to_numpy() for c in ("n_x", "n_y"))
            sets = ((np.frombuffer(a, U64), np.frombuffer(b, U64)) for a, b in zip(batch.column("blob_x").to_pylist(), batch.column("blob_y").to_pylist(), strict=True))
            both = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(100 * both >= percent * (n_x + n_y - both)))

    return met.select("x", "y", "n_x", "n_y", "blob_x", "blob_y").mapInArrow(verify, "x long, y long")


def link_components(nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, label) of the nodes that have a link. nodes: node, n, weight, first and second (prefixes under the orders), lead (tokens before these, which no other node has), blob."""
    lists = nodes.select("node", "n", "weight", "lead", F.posexplode("first").alias("pos", "token")).withColumn("left_", F.col("n") - F.col("lead") - F.col("pos")).drop("lead", "pos")
    fits = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    pair = [F.least("node", "node2").alias("x"), F.greatest("node", "node2").alias("y")]
    links, tried, labels = None, None, None

    def labelled() -> DataFrame:
        if labels is None:
            return lists.withColumn("label", F.col("node"))
        return lists.join(labels.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select(*lists.columns, F.coalesce("label", "node").alias("label"))

    def fresh(proposed: DataFrame, name: str) -> DataFrame:
        found = proposed.select(*pair).distinct()
        return scratch.write(found if tried is None else found.join(tried, ["x", "y"], "left_anti"), name)

    for r in range(HUB_ROUNDS):
        # first the node that is likeliest to be what others are copies of, then any
        rank = F.col("weight") if r == 0 else F.xxhash64(F.lit(r), "token", "node").cast("double")
        here = labelled()
        hubs = here.groupBy("token").agg(F.max(F.struct(rank.alias("rank"), "node", "n", "label")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high"))
        hubs = hubs.where("low <> high").select("token", F.col("hub.node").alias("node2"), F.col("hub.n").alias("n2"), F.col("hub.label").alias("label2"))
        pairs = fresh(here.join(hubs, "token").where((F.col("label") != F.col("label2")) & fits), f"pairs{r}")
        new = scratch.write(verified(pairs, nodes, percent), f"links{r}")
        tried = pairs if tried is None else tried.union(pairs)
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        labels = connected(links, scratch, f"round{r}_")
    here = labelled()
    # of a token's nodes those of its commonest label meet the others only, so a list of m nodes with s others is s * m pairs, not m * m
    by_label = here.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
    open_ = by_label.groupBy("token").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("main")).where("m > main.m")
    chunks = lambda m: F.ceil(m / TILE).cast("int")
    open_ = open_.select("token", F.col("main.label").alias("main"), chunks(F.col("m")).alias("all_chunks"), chunks(F.col("m") - F.col("main.m")).alias("other_chunks"))
    dealt = here.join(open_, "token")
    # what a pair needs to be a candidate goes along, so that no other pair leaves the join
    dealt = dealt.join(nodes.select(F.col("node").alias("of"), "first", "second"), F.col("node") == F.col("of")).drop("of", "weight")
    own = ["node", "n", "label", "left_", "first", "second"]

    def tile(rows: DataFrame, mine: str, theirs: str, *columns: Column | str) -> DataFrame:
        """Each row in its chunk, once for each chunk of the other side."""
        place = F.pmod(F.xxhash64(F.lit(9), "node"), F.col(mine)).cast("int").alias(f"of_{mine}")
        return rows.select("token", place, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias(f"of_{theirs}"), *columns)

    left = tile(dealt.where("label <> main"), "other_chunks", "all_chunks", "main", *own)
    right = tile(dealt, "all_chunks", "other_chunks", *[F.col(c).alias(f"{c}2") for c in own])
    # two of the others meet twice
    apart = (F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("main")) | (F.col("node") < F.col("node2")))
    # from the token on, each set has to have as many tokens left as the intersection
    reach = (100 + percent) * F.least("left_", "left_2") >= percent * (F.col("n") + F.col("n2"))
    both, need = F.array_intersect("first", "first2"), shared_at_least("n", "n2", percent)
    enough = (F.size(both) >= need) & (F.element_at(both, 1) == F.col("token")) & (F.size(F.array_intersect("second", "second2")) >= need)
    pairs = fresh(left.join(right, ["token", "of_other_chunks", "of_all_chunks"]).where(apart & fits & reach & enough), "rest")
    new = scratch.write(verified(pairs, nodes, percent), "more_links")
    if not new.isEmpty():
        labels = connected(new if links is None else links.union(new), scratch, "last_")
    scratch.drop("rest", "more_links", *(f"{name}{r}" for name in ("pairs", "links") for r in range(HUB_ROUNDS)))
    return labels if labels is not None else scratch.write(nodes.select("node", F.col("node").alias("label")).limit(0), "none")


def similar_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Words: A-Z lower-cased, split at space and 0x09-0x0D. A text of fewer than k words has its whole sequence as one shingle; null, empty
    and white texts have none and link with nothing. Rows with a null doc_id link as others do, but name a component only where
    all its doc_ids are null. Rows with one doc_id are judged each by its text. An empty table gives no rows; other columns are not read.
    """
    return _components(docs, k, percent)[0]


def _components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, Scratch]:
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "jaccard")
    parts = partitions_for(docs, COUNT_MB)

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(begin, BATCH_ROWS)
                yield mapped(*utf8_parts(some.column("text")), some.column("doc_id"), number, parts, k)
                number += 1

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in (batch.slice(b, 10 * SETS) for b in range(0, batch.num_rows, 10 * SETS)):
                table = np.zeros(some.num_rows, NODE)
                table["s1"], table["s2"], table["n"] = (some.column(c).to_numpy() for c in ("sig1", "sig2", "n"))
                blobs = some.column("blob").to_pylist()
                node = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
                yield batch_of([(0, home(number, parts), number, table.tobytes()), *packed(number, node, np.frombuffer(b"".join(blobs), U64), parts)])
                number += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "target", "chunk", "blob")), strict=True))
            held += [r[1:] for r in rows if r[0] == 2]
            if others := [r for r in rows if r[0] != 2]:
                yield batch_of(others)
        out = counted(held, parts)
        for begin in range(0, len(out), 1000):
            yield batch_of(out[begin : begin + 1000])

    def gather(documents: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, last = [], None
            for batch in batches:
                for kind, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "chunk", "blob")), strict=True):
                    if held and chunk != last:
                        yield from gathered(held, percent, documents)
                        held = []
                    last = chunk
                    held.append((kind, blob))
            if held:
                yield from gathered(held, percent, documents)

        return run

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SETS) for b in batches for i in range(0, b.num_rows, SETS)):
            first, second, weight, lead, keep = [], [], [], [], []
            for n, blob, df in zip(*(batch.column(c).to_pylist() for c in ("n", "blob", "df")), strict=True):
                token, often = np.frombuffer(blob, U64), np.frombuffer(df, np.int32)
                found = prefixes(n, token, often, percent)
                keep.append(bool(found))
                if found:
                    first.append(found[0].view(np.int64))
                    second.append(found[1].view(np.int64))
                    weight.append(often.sum() / n)
                    lead.append(n - len(token))
            some = batch.filter(pa.array(keep, pa.bool_()))
            if some.num_rows:
                arrays = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (first, second)]
                yield pa.record_batch([*(some.column(c) for c in ("sig1", "sig2", "n")), pa.array(weight, pa.float64()), pa.array(lead, pa.int32()), *arrays, some.column("blob")], ["sig1", "sig2", "n", "weight", "lead", "first", "second", "blob"])

    def name_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in one function, so that a task needs one Python worker
        yield from propose(gather(False)(batches))

    def shared(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        counted_ = rows.repartitionById(parts, F.col("target")).mapInArrow(count, ROWS)
        return counted_.repartitionById(parts, F.col("target")).sortWithinPartitions("chunk").mapInArrow(fn, schema)

    first = scratch.write(shared(docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(to_parts, ROWS), gather(True), FOUND), "first")
    names = first.where("kind = 0").select("doc_id", "n", "sig1", "sig2")
    least = F.min("doc_id").alias("component_id")
    # texts with one set in several chunks become one node, and the nodes are counted again among themselves
    nodes = first.where("kind = 1").groupBy("sig1", "sig2").agg(F.first("n").alias("n"), F.first("blob").alias("blob"))
    # numbers that are fixed once the table is written stand for nodes from here on
    table = shared(nodes.mapInArrow(again, ROWS), name_nodes, NODES)
    table = scratch.write(table.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = link_components(table, percent, scratch)
    members = names.groupBy("sig1", "sig2").agg(least)
    named = table.select("node", "sig1", "sig2").join(labels, "node").join(members, ["sig1", "sig2"])
    smallest = named.groupBy(F.col("label").alias("of")).agg(F.min("component_id").alias("component_id"))
    found = scratch.write(named.select("sig1", "sig2", "label").join(smallest, F.col("label") == F.col("of")).select("sig1", "sig2", "component_id"), "components")
    lone = members.join(found, ["sig1", "sig2"], "left_anti")
    all_ = found.unionByName(lone).withColumnsRenamed({"sig1": "s1", "sig2": "s2"})
    joined = names.join(all_, (F.col("sig1") == F.col("s1")) & (F.col("sig2") == F.col("s2")))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), scratch


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each component one row, with all columns: the one with the smallest doc_id, a null one last; ties go to the row whose columns sort first.

    Rows without words are no copies of each other and stay. Where a doc_id is null or repeated, rows are numbered in this order first.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if not repeated.isEmpty():
        order = [F.col("doc_id").asc_nulls_last(), "text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
        rows = docs.orderBy(*order).select(F.monotonically_increasing_id().alias("doc_id"), "text", F.struct(*docs.columns).alias("row"))
        return one_of_each(Scratch(docs.sparkSession, "numbered").write(rows, "rows"), k, percent).select("row.*")
    found, scratch = _components(docs, k, percent)
    gone = scratch.write(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
