"""Articles: from XML files by year, and as a view over a documents table."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import BROADCAST_PERIODS
from ..ship import ship_package

STREAMS = ("GDL", "JDG")
META = "id string, name string, page_no int, publication string, issue_date string"
XML_SCHEMA = f"entity array<struct<full_text: string, meta: struct<{', '.join(x.replace(' ', ': ', 1) for x in META.split(', '))}>>>"


def year_files(begin: dt.datetime, end: dt.datetime) -> list[str]:
    """One file per calendar year that the period touches."""
    return [f"articles{year}.xml" for year in range(begin.year, end.year + 1)]


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Missing files are no articles, but Spark refuses a missing path."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if (q := path(p)).getFileSystem(conf).exists(q)]


def read_article_xml(spark: SparkSession, folders: list[str], begin: dt.datetime, end: dt.datetime, max_page: int = 3, part_separator: str = "") -> DataFrame:
    """(article_id, title, stream, page_no, issue_ts, full_text) of the articles strictly inside the period, up to a page.

    Metadata are those of the first entity; the texts of all entities are joined. An article without entity, or with any field missing, is
    left out, alone. Of unknown publications too. A year without file has no articles.
    """
    paths = existing(spark, [f"{folder}/{name}" for folder in folders for name in year_files(begin, end)])
    schema = "article_id string, title string, stream string, page_no int, issue_ts timestamp, full_text string"
    if not paths:
        return spark.createDataFrame([], schema)
    raw = spark.read.format("xml").option("rowTag", "article").schema(XML_SCHEMA).load(",".join(paths))
    meta = F.element_at("entity", 1)["meta"]
    text = F.concat_ws(part_separator, F.transform("entity", lambda e: e["full_text"]))
    built = raw.where(F.size("entity") > 0).select(
        meta["id"].alias("article_id"), meta["name"].alias("title"), meta["publication"].alias("stream"), meta["page_no"].alias("page_no"),
        F.try_to_timestamp(F.concat(meta["issue_date"], F.lit("-12")), F.lit("dd/MM/yyyy-HH")).alias("issue_ts"), text.alias("full_text"))
    return select_articles(built.dropna().where(F.col("full_text") != ""), begin, end, max_page)


def write_article_xml(articles: DataFrame, path: str) -> None:
    """Articles as XML files that read_article_xml reads, one entity each; path stands for one year's file."""
    meta = F.struct(F.col("article_id").cast("string").alias("id"), F.col("title").alias("name"), "page_no", F.col("stream").alias("publication"), F.date_format("issue_ts", "dd/MM/yyyy").alias("issue_date"))
    rows = articles.select(F.array(F.struct("full_text", meta.alias("meta"))).alias("entity"))
    rows.write.format("xml").option("rowTag", "article").option("rootTag", "articles").save(path)


def select_articles(articles: DataFrame, begin: dt.datetime | None = None, end: dt.datetime | None = None, max_page: int | None = None, strict: bool = False) -> DataFrame:
    """Known streams, strictly inside the period, up to a page. With strict an unknown stream is an error when the row is read."""
    known = F.col("stream").isin(*STREAMS)
    out = articles.where(F.assert_true(known, F.concat(F.lit("unknown stream "), F.coalesce("stream", F.lit("null")))).isNull()) if strict else articles.where(known)
    if begin is not None and end is not None:
        out = out.where((F.col("issue_ts") > F.lit(begin)) & (F.col("issue_ts") < F.lit(end)))
    return out if max_page is None else out.where(F.col("page_no") <= max_page)


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """The documents table as articles: pages, streams and dates follow from doc_id; lang is kept."""
    d = F.col("doc_id")
    return documents.select(
        d.alias("article_id"), F.concat(F.lit("doc-"), d.cast("string")).alias("title"), F.when(d % 2 == 0, "GDL").otherwise("JDG").alias("stream"),
        (1 + F.expr("doc_id div 2") % 6).cast("int").alias("page_no"), F.expr("TIMESTAMP '2024-01-01 12:00:00' + make_dt_interval(cast(doc_id % 56 as int))").alias("issue_ts"),
        F.col("text").alias("full_text"), "lang")


#: The begin of an article element, with its prefix.
OPENING = re.compile(r"<([\w.-]+:)?article(?=[\s>])")
#: What an article consists of, by local tag name.
FIELDS = ("id", "name", "page_no", "publication", "issue_date", "full_text")
PARTS = "fields map<string,string>, n_entities int"


def article_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each article element of the text chunks: its fields by local tag name, and how many entities it has.

    Names are matched without their prefix and wherever the element stands. Up to the end of the first entity every field is taken, after it only texts, which go on where the last
    one ended. What is no well-formed XML is no article.
    """
    from xml.parsers import expat

    def parse(xml: str) -> tuple[dict[str, str], int] | None:
        found: dict[str, str] = {}
        state = {"n": 0, "text": []}
        local = lambda name: name.rsplit(":", 1)[-1]

        def start(name: str, _: dict) -> None:
            state["text"] = []

        def end(name: str) -> None:
            tag, text = local(name), "".join(state["text"])
            state["text"] = []
            if tag == "entity":
                state["n"] += 1
            elif tag == "full_text":
                found[tag] = found.get(tag, "") + text
            elif tag in FIELDS and not state["n"]:
                found[tag] = text

        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, lambda data: state["text"].append(data)
        try:
            parser.Parse(xml, True)
        except expat.ExpatError:
            return None
        return found, state["n"]

    for batch in batches:
        rows = []
        for text in batch.column("value").to_pylist():
            begin = OPENING.search(text or "")
            # a namespace of the file's root is not declared here, and names are compared without it
            if begin and (parsed := parse(f"{text[begin.start() :]}</{begin.group(1) or ''}article>")):
                rows.append({"fields": [*parsed[0].items()], "n_entities": parsed[1]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("fields", pa.map_(pa.string(), pa.string())), ("n_entities", pa.int32())]))


def read_nested_xml(spark: SparkSession, folders: list[str], begin: dt.datetime, end: dt.datetime, max_page: int = 3, prefix: str = "") -> DataFrame:
    """What read_article_xml gives, for files in which the fields stand at any depth: (article_id, title, stream, page_no, issue_ts, full_text).

    Files are split at the end tags of articles, so that a large one is read by many tasks; prefix: that of the article's tag, with its colon.
    """
    paths = existing(spark, [f"{folder}/{name}" for folder in folders for name in year_files(begin, end)])
    schema = "article_id string, title string, stream string, page_no int, issue_ts timestamp, full_text string"
    if not paths:
        return spark.createDataFrame([], schema)
    ship_package(spark)
    parts = spark.read.option("lineSep", f"</{prefix}article>").text(paths).mapInArrow(article_parts, PARTS).where("n_entities > 0")
    field = lambda name: F.element_at("fields", name)
    built = parts.select(
        field("id").alias("article_id"), field("name").alias("title"), field("publication").alias("stream"), F.expr("try_cast(element_at(fields, 'page_no') AS int)").alias("page_no"),
        F.try_to_timestamp(F.concat(field("issue_date"), F.lit("-12")), F.lit("dd/MM/yyyy-HH")).alias("issue_ts"), field("full_text").alias("full_text"))
    filled = built.dropna().where((F.col("full_text") != "") & (F.col("article_id") != "") & (F.col("title") != ""))
    return select_articles(filled, begin, end, max_page)


def write_article_store(articles: DataFrame, path: str) -> None:
    """Articles as Parquet by year and stream. Rows are dealt by both and by month, so that no folder has a file of every task and none is one task's."""
    kept = articles.withColumn("year", F.year("issue_ts"))
    kept.repartition("year", "stream", F.date_trunc("month", "issue_ts")).write.mode("overwrite").partitionBy("year", "stream").option("compression", "zstd").parquet(path)


def read_article_store(spark: SparkSession, path: str, begin: dt.datetime | None = None, end: dt.datetime | None = None, streams: tuple[str, ...] | None = None) -> DataFrame:
    """Articles of a store strictly inside the period; only the folders of its years and of the streams are read."""
    rows = spark.read.parquet(path)
    if begin is not None and end is not None:
        rows = rows.where(F.col("year").between(begin.year, end.year) & (F.col("issue_ts") > F.lit(begin)) & (F.col("issue_ts") < F.lit(end)))
    return rows if streams is None else rows.where(F.col("stream").isin(*streams))


def articles_of_periods(store: DataFrame, periods: DataFrame) -> DataFrame:
    """Each article of a store once for each period that it lies strictly inside; only the folders of years that periods touch are read.

    These years are listed before: there are no more than calendar years, however many periods there are.
    """
    years = periods.withColumn("year", F.explode(F.sequence(F.year("p_from"), F.year("p_to"))))
    touched = [r.year for r in years.select("year").distinct().orderBy("year").collect()]
    spread = F.broadcast(years) if periods.limit(BROADCAST_PERIODS + 1).count() <= BROADCAST_PERIODS else years
    return store.where(F.col("year").isin(touched)).join(spread, "year").where((F.col("issue_ts") > F.col("p_from")) & (F.col("issue_ts") < F.col("p_to")))
