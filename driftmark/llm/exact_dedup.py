"""Exact dedup with an extendible-hash index on shared files; DataFrame functions only.

1. One pass groups the 64-bit hashes of the normalised texts: how many rows have each, and the largest doc_id of them.
2. Directory: all hashes start in one bucket. A bucket of local depth d with more entries than the capacity is split by its next bits
   into those of depth d + 1, the directory doubling as it gets deeper, until none is overfull (or has one hash).
   Directory entries (local depth, leading bits, bucket) are a table in the shared folder.
3. Index: owner tasks have ranges of buckets and hashes each. Only texts whose hash occurs again are sent to them, copies combined before they
   are sent; texts with one hash are compared byte by byte, and different ones form a chain under that hash.
4. Each row looks up its bucket in the directory, its hash in the bucket, and, where the hash has a chain, walks the chain comparing bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Entries of a bucket at most, and buckets that a directory should have at most: beyond, buckets get larger instead (the directory is held by the driver).
CAPACITY, BUCKETS = 20_000, 50_000
#: Hashes up to which a list of hashes (8 bytes each) is broadcast; beyond, Spark chooses the join.
BROADCAST_KEYS = 1_000_000


def leading(key: Column | str, depth: int) -> Column:
    """The leading bits of a hash, as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def split_buckets(depth: int, overfull: Iterable[int], deeper: int, cells: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """(local depth, leading bits, entries) of what the overfull buckets of `depth` become. cells: entries by the `deeper` leading bits. Buckets that
    get empty are left out; those of depth `deeper` may still be overfull."""
    inside: dict[int, list[tuple[int, int]]] = {prefix: [] for prefix in overfull}
    for cell, n in cells.items():
        inside[cell >> (deeper - depth)].append((cell, n))
    done, open_ = [], [(depth, prefix, some) for prefix, some in inside.items()]
    while open_:
        d, prefix, some = open_.pop()
        size = sum(n for _, n in some)
        if not size:
            continue
        if size <= capacity or d == deeper:
            done.append((d, prefix, size))
            continue
        halves: tuple[list, list] = ([], [])
        for cell, n in some:
            halves[(cell >> (deeper - d - 1)) & 1].append((cell, n))
        open_ += [(d + 1, prefix * 2 + bit, half) for bit, half in enumerate(halves)]
    return done


def directory(keys: DataFrame, n: int, capacity: int) -> list[tuple[int, int, int]]:
    """(local depth, leading bits, bucket) by depth and bits; keys: the distinct hashes, n of them."""
    done, overfull, depth = [], [0], 0
    deeper = min(64, max(0, math.ceil(math.log2(max(n, 1) / capacity)) + 3)) if n > capacity else 0
    while overfull:
        some = keys if depth == 0 else keys.where(leading("key", depth).isin(overfull))
        mask = (1 << deeper) - 1
        cells = {r.cell & mask: r.n for r in some.groupBy(leading("key", deeper).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
        found = split_buckets(depth, [p & ((1 << depth) - 1) for p in overfull], deeper, cells, capacity)
        full = [p for d, p, m in found if m > capacity and d == deeper < 64]
        done += [(d, p) for d, p, m in found if not (m > capacity and d == deeper < 64)]
        # 64 leading bits are a signed number to Spark
        overfull, depth, deeper = full, deeper, min(64, deeper + 8)
    return [(d, p - (1 << 64) if p >= 1 << 63 else p, i) for i, (d, p) in enumerate(sorted(done, key=lambda b: b[1] << (64 - b[0])))]


def bucketed(rows: DataFrame, slots: DataFrame, depths: list[int]) -> DataFrame:
    """rows (with key) and the bucket that the directory has for it."""
    buckets = []
    for d in depths:
        own = F.broadcast(slots.where(F.col("depth") == d).select(F.col("bits").alias(f"bits{d}"), F.col("bucket").alias(f"bucket{d}")))
        rows = rows.join(own, leading(F.col("key"), d) == F.col(f"bits{d}"), "left")
        buckets.append(F.col(f"bucket{d}"))
    return rows.withColumn("bucket", F.coalesce(*buckets) if buckets else F.lit(None).cast("int")).drop(*(f"{c}{d}" for d in depths for c in ("bits", "bucket")))


def listed(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def exact_dedup(docs: DataFrame, capacity: int | None = None, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest doc_id of equal texts stays; rows that repeat a
    doc_id count each, and all of those with the kept doc_id stay. A null text counts as empty; a null doc_id is smaller than any
    other, so such a row stays only in a group where all are null. An empty table gives no rows; other columns are not read.
    capacity: entries of a bucket at most; none: CAPACITY, or more where there would be more than BUCKETS buckets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    rows = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm")).select("doc_id", "norm", hash_of(F.col("norm")).alias("key"))
    keys = scratch.write(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")), "keys")
    n = keys.count()
    entries = directory(keys, n, capacity or max(CAPACITY, -(-n // BUCKETS)))
    slots = scratch.write(spark.createDataFrame(entries, "depth int, bits long, bucket int").coalesce(1), "directory")
    depths = sorted({d for d, _, _ in entries})
    # texts whose hash no other row has need no comparison
    single = bucketed(keys.where("n = 1"), slots, depths).select("bucket", "key", F.col("top").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).alias("place"), F.lit(1).alias("links"), F.lit(None).cast("string").alias("bytes"))
    again = rows.join(listed(keys.where("n > 1").select("key")), "key").groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    owned = bucketed(again, slots, depths).repartitionByRange("bucket", "key")
    chain = Window.partitionBy("bucket", "key")
    links = F.count(F.lit(1)).over(chain)
    chained = owned.withColumn("place", F.row_number().over(chain.orderBy("norm"))).withColumn("links", links.cast("int")).withColumn("bytes", F.when(F.col("links") > 1, F.col("norm")))
    index = scratch.write(single.unionByName(chained.drop("norm")), "index")
    scratch.drop("keys")
    long = index.where("links > 1").select("key").distinct()
    asked = rows.withColumn("text_sha256", F.sha2("norm", 256))
    if long.isEmpty():
        asked = asked.drop("norm").withColumn("norm", F.lit(None).cast("string"))
    else:
        # texts go along only where there is a chain to walk
        asked = asked.join(listed(long.withColumnRenamed("key", "chain_key")), F.col("key") == F.col("chain_key"), "left").withColumn("norm", F.when(F.col("chain_key").isNotNull(), F.col("norm"))).drop("chain_key")
    asked = bucketed(asked, slots, depths).withColumnsRenamed({"bucket": "b", "key": "k"})
    joined = asked.join(index, (F.col("b") == F.col("bucket")) & (F.col("k") == F.col("key")) & ((F.col("links") == 1) | (F.col("norm") == F.col("bytes"))))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
