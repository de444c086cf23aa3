"""How filters interact: every order of a set of filters is walked as a trie of permutations.

A node of the trie is an ordered prefix of filters, and its rows are those that survive the prefix. These rows depend on the set of filters
only, so nodes with one set share one persisted survivor DataFrame (2^n of them instead of the trie's e * n! nodes), which is made from its
parent's by one more filter. The walk goes depth first: at most n survivor DataFrames are persisted at a time. Each of them is read once to count what
every filter that is left removes from it, by part, and these counts are the trie's edges. The edges stay a table; all orders are then read off it.
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Orders grow with the factorial of the filters: 5,040 for seven, a row of the result for each of their steps and each part.
MOST_FILTERS = 7
#: Copies of a text from which its group is looked up in a broadcast table: at least this share of all rows, so at most 1,000 groups.
HOT_SHARE = 1000
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = "removed long, good_lost long, toxic_lost long"


def least_ids(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with least_id, the smallest doc_id among rows with the same digest (null where no other row has it).

    Digests are counted before they are shuffled. Groups of a thousandth of all rows or more, at most 1,000, are broadcast, so no key of the join has more.
    """
    groups = docs.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    groups = scratch.write(groups.where("n > 1"), "copies")
    most = max(2, docs.count() // HOT_SHARE)
    hot, rest = groups.where(F.col("n") >= most), groups.where(F.col("n") < most)
    seen = docs.join(F.broadcast(hot.select("digest", F.col("least_id").alias("hot_id"), F.lit(True).alias("is_hot"))), "digest", "left")
    common = seen.where("is_hot").withColumn("least_id", F.col("hot_id"))
    rare = seen.where("is_hot is null").join(rest.select("digest", "least_id"), "digest", "left")
    return common.drop("hot_id", "is_hot").unionByName(rare.drop("hot_id", "is_hot"))


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the filters and the counts read of each document, as a written table: part, doc_id, n_words, n_distinct, n_upper, n_chars, marked, least_id, good, toxic.

    Whole texts are read once here, by built-in functions; nothing after it carries a text.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split("text", SPACES), "")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", F.sha2("text", 256).alias("digest"), F.char_length("text").alias("n_chars"),
        F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_upper"), F.col("text").rlike("[#$%&*|]").alias("marked"), words.alias("words"),
    )
    rows = rows.select("*", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct")).drop("words")
    rows = scratch.write(rows, "measures")
    rows = scratch.write(least_ids(rows, scratch).drop("digest"), "with-least")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id have no labels, and would all meet as one key
    with_id = rows.where("doc_id is not null").join(marks.where("doc_id is not null"), "doc_id", "left")
    without = rows.where("doc_id is null").select("*", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    return with_id.unionByName(without)


#: When each filter rejects a row of `measured`.
FILTERS: dict[str, str] = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_upper > 5 * n_chars",
    "D": "marked",
    "E": "coalesce(doc_id > least_id, false)",
}


class Trie:
    """The permutation trie over rows with a part, good and toxic (0 or 1, or null) and one boolean column for each filter that tells what it rejects."""

    def __init__(self, rows: DataFrame, names: list[str], scratch: Scratch):
        self.rows, self.names, self.scratch = rows, names, scratch
        self.counted: dict[int, DataFrame] = {}

    def walk(self) -> DataFrame:
        """The edges: part, state (bit i: filter i was applied before), n (survivors before), counts (for each filter what it removes from them; null if applied)."""
        self.visit(0, self.rows)
        return self.scratch.spark.read.schema(f"part string, n long, counts array<struct<{COUNTS}>>, state int").parquet(*(f"{self.scratch.root}/edges-{s}" for s in self.counted))

    def visit(self, state: int, survivors: DataFrame) -> None:
        """Count the edges out of a set of filters and go down each of them, unless another order led there before."""
        left = [i for i in range(len(self.names)) if not state >> i & 1]
        if not left or state in self.counted:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.counted[state] = self.scratch.write(self.edges(state, survivors), f"edges-{state}")
            for i in left:
                self.visit(state | 1 << i, survivors.where(~F.col(self.names[i])))
        finally:
            survivors.unpersist()

    def edges(self, state: int, survivors: DataFrame) -> DataFrame:
        """One row per part: survivors, and what each filter that is left removes."""

        def removed(name: str) -> Column:
            lost = lambda mark: F.count_if(F.col(name) & (F.col(mark) == 1))
            return F.struct(F.count_if(name).alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))

        none = F.lit(None).cast(f"struct<{COUNTS}>")
        counts = F.array(*(none if state >> i & 1 else removed(name) for i, name in enumerate(self.names)))
        return survivors.groupBy("part").agg(F.count(F.lit(1)).alias("n"), counts.alias("counts")).withColumn("state", F.lit(state))


def interactions(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """What each filter removes in each order of all filters, by part.

    rows: part, good, toxic (1, 0 or null) and the columns that the filters read; filters: name and the SQL condition that rejects a row (null counts as
    not rejected). One row per part, order and step: part, filter_order (names joined), step (from 1), kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley. A part has all orders and steps, with zeros where nothing happens. Rows may repeat, each counts; an empty table gives no rows.
    """
    names = list(filters)
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"between one and {MOST_FILTERS} filters are needed")
    scratch, n = Scratch(rows.sparkSession, "filter-trie"), len(names)
    columns = [f"rejected_{i}" for i in range(n)]
    judged = rows.select("part", "good", "toxic", *(F.coalesce(F.expr(f), F.lit(False)).alias(c) for f, c in zip(filters.values(), columns, strict=True)))
    edges = Trie(judged, columns, scratch).walk()
    # one row per part: at most one entry for each set of filters
    parts = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("n", "counts")))).alias("by_state"))

    def edge(state: Column, i: Column) -> Column:
        return F.element_at("by_state", state)["counts"][i]

    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    states = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(math.factorial(k := s.bit_count()) * math.factorial(n - 1 - k) if s < 2**n - 1 else 0).cast("long").alias("weight")) for s in range(2**n)))

    def shapley(i: int) -> Column:
        """Over all orders: a set before the filter stands in as many orders as its members and the others can be arranged."""
        return F.aggregate(states, F.lit(0).cast("long"), lambda total, s: total + s["weight"] * zero(edge(s["state"], F.lit(i))["removed"]))

    parts = parts.withColumn("shapleys", F.array(*map(shapley, range(n))))
    steps = []
    for order in itertools.permutations(range(n)):
        for step, i in enumerate(order):
            steps.append(("".join(names[j] for j in order), step + 1, i, sum(1 << j for j in order[:step]), 2**n - 1 - (1 << i)))
    # of fixed size: n * n! rows, each of them met by every part through its place
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, i int, state int, others int")
    names_of = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "by_state", "shapleys")
    found, first, alone = edge(F.col("state"), F.col("i")), edge(F.lit(0), F.col("i"))["removed"], edge(F.col("others"), F.col("i"))["removed"]
    removed = zero(found["removed"])
    return names_of.join(F.broadcast(orders), "i").select(
        "part", "filter_order", "step", (zero(F.element_at("by_state", F.col("state"))["n"]) - removed).alias("kept"), removed.alias("removed"), (zero(first) - removed).alias("redundant"),
        zero(alone).alias("unique_fails"), zero(found["good_lost"]).alias("good_lost"), zero(found["toxic_lost"]).alias("toxic_lost"), F.col("shapleys")[F.col("i")].alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`interactions` of FILTERS on documents, by source.

    A null text counts as empty, a null source as ''. Rows with one doc_id are judged one by one; a text is a copy if a row with a smaller doc_id has it,
    so rows with the smallest doc_id, repeated or not, are none, and neither is a row without a doc_id (nor is one a copy of it). Of several labels of a doc_id any 1 counts; rows
    without a label or a doc_id are neither good nor toxic. Texts of one sha256 count as identical. Other columns are not read; an empty table gives no rows.
    """
    return interactions(measured(docs, labels), FILTERS)
