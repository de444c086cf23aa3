"""Cleaning a corpus in stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch, ascii_lower, table
from driftmark.llm.decontaminate import decontaminate
from driftmark.llm.exact_dedup import BROADCAST_KEYS, exact_dedup
from driftmark.llm.jaccard_join import one_of_each
from driftmark.llm.mixing import mix_sources
from driftmark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts show nothing and stay; rows with a null or repeated doc_id are judged by their texts. Without labels all stay.
    An empty table gives no rows. Columns may have any names.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, one with the largest doc_id; of several with that doc_id the one whose columns sort first.

    Null and empty texts are equal, so one row of them stays; a null doc_id is smaller than any other. An empty table gives no rows. Columns
    may have any names.
    """
    scratch = Scratch(spark, "exact-stage")
    found = exact_dedup(docs).groupBy(F.col("doc_id").alias("marked_id"), F.col("text_sha256").alias("marked_sha"))
    marked = scratch.write(found.agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"), "marked")
    digest = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    same = docs["doc_id"].eqNullSafe(marked["marked_id"]) & (digest == marked["marked_sha"])
    several, ids = marked.where("kept"), marked.select("marked_id").distinct()
    if ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        # most rows have no marked doc_id and stay where they are; only the others are dealt out with their texts
        named = docs["doc_id"].eqNullSafe(ids["marked_id"])
        untouched, asked = (docs.join(F.broadcast(ids), named, how) for how in ("left_anti", "left_semi"))
        single = untouched.unionByName(asked.join(marked, same, "left_anti"))
    else:
        single = docs.join(marked, same, "left_anti")
    if several.isEmpty():
        return single
    again = docs.join(several, same).select(several["marked_id"], several["marked_sha"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return single.unionByName(again.groupBy(several["marked_id"], several["marked_sha"]).agg(F.min("row").alias("row")).select("row.*"))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id (a null one comes last).

    Texts without words (null, empty, white) are no copies of each other and all stay; of rows with one doc_id each is judged by its text,
    ties go to the row whose columns sort first. An empty table gives no rows. Columns may have any names.
    """
    return one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and empty texts have no words and stay; rows with a null or repeated doc_id are judged by their texts. Without a benchmark all
    stay. An empty table gives no rows. Columns may have any names.
    """
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"), whole_rows=True)
    return judged.where("not contaminated").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to equal shares of the text that is left.

    Null and empty texts weigh nothing and are drawn at their source's rate, a null source is one of its own. An empty table gives no rows. Columns
    may have any names; n_copies, copy_no and order_key are added or replaced.
    """
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", jaccard), ("benchmark decontamination", contamination), ("mixing", mixing)]

#: SQL can't express the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the tables between them are in the shared folder."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = len(Scratch.made)
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
        Scratch.release(before)
        if i:
            scratch.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
