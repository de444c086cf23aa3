"""Theme catalogues: text reports, JSON documents, strength series as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THEME = "i int, start string, end string, noData string, wl array<struct<w:string,p:double>>"


def word_map(text: Column) -> Column:
    """'{w=p, w=p}' as an array of (w, p), in the order of the text; white space is dropped."""
    clean = F.regexp_replace(text, r"[{}\s]", "")
    parts = F.filter(F.split(clean, ","), lambda x: F.instr(x, "=") > 0)
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("w"), F.substring_index(x, "=", -1).cast("double").alias("p")))


def parse_theme_maps(lines: DataFrame) -> DataFrame:
    """(i, wl) of every map in a whole text (column value), numbered by place."""
    found = lines.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(\{[^{}]*\})"), 1)).alias("i", "m"))
    return found.select("i", word_map(F.col("m")).alias("wl"))


def parse_series(lines: DataFrame) -> DataFrame:
    """(i, ts_ms, strength) of series in a whole text (column value): lines 'ts,strength', separated by lines without a comma."""
    blocks = lines.select(F.filter(F.split("value", r"(?m)^[^,\n]*$\n?"), lambda b: F.instr(b, ",") > 0).alias("bs")).select(F.posexplode("bs").alias("i", "b"))
    rows = blocks.select("i", F.explode(F.split("b", "\n")).alias("line")).where(F.instr("line", ",") > 0)
    part = F.split("line", ",")
    return rows.select("i", F.trim(part[0]).cast("long").alias("ts_ms"), F.trim(part[1]).cast("double").alias("strength"))


def pair_up(themes: DataFrame, series: DataFrame) -> DataFrame:
    """Themes and series of one ordinal, as far as both go."""
    return themes.join(series, "i")


def import_word_maps(lines: DataFrame) -> DataFrame:
    """(i, wl) of a JSON array of JSON-object strings word -> p (column value, whole text)."""
    maps = lines.select(F.posexplode(F.from_json("value", "array<string>")).alias("i", "m"))
    return maps.select("i", F.transform(F.map_entries(F.from_json("m", "map<string,double>")), lambda e: F.struct(e["key"].alias("w"), e["value"].alias("p"))).alias("wl"))


def read_themes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(THEME).json(paths)


def page(themes: DataFrame, first: int, size: int = 50) -> DataFrame:
    """The themes first .. first + size - 1; missing numbers are skipped."""
    return themes.where(F.col("i").between(first, first + size - 1))


def read_series(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """(ts, strength) of lines 'epochSeconds,strength' with begin <= ts < end."""
    rows = spark.read.schema("ts long, strength double").csv(path).dropna()
    rows = rows if begin is None else rows.where(F.col("ts") >= begin)
    return rows if end is None else rows.where(F.col("ts") < end)


def write_themes(themes: DataFrame, path: str) -> None:
    themes.write.mode("overwrite").json(path)


def write_series(series: DataFrame, path: str) -> None:
    """Series in milliseconds as lines 'epochSeconds,strength', one folder per theme."""
    series.select("i", F.floor(F.col("ts_ms") / 1000).alias("ts"), "strength").repartition("i").sortWithinPartitions("i", "ts").write.mode("overwrite").partitionBy("i").csv(path)


def synthetic_themes(spark: SparkSession, n: int = 300, words: int = 15, vocabulary: list[str] | None = None, seed: int = 0) -> DataFrame:
    """n random themes of `words` words, likeliest first; for tests."""
    names = F.array(*[F.lit(w) for w in (vocabulary or [f"word{j}" for j in range(words)])])
    each = spark.range(n).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("j")).withColumn("p", F.rand(seed))
    word = F.element_at(names, (F.pmod(F.xxhash64("i", "j"), F.size(names)) + 1).cast("int"))
    return each.groupBy("i").agg(F.reverse(F.array_sort(F.collect_list(F.struct("p", word.alias("w"))))).alias("x")).select("i", F.transform("x", lambda e: F.struct(e["w"].alias("w"), e["p"].alias("p"))).alias("wl"))


def series_lines(strengths: DataFrame) -> DataFrame:
    """(theme, ts, line): the report of strengths, a head line per theme (ts null) and its rows; sort by theme and ts (nulls first)."""
    head = strengths.select("theme").distinct().select("theme", F.lit(None).cast("timestamp").alias("ts"), F.concat(F.lit("Theme "), F.col("theme")).alias("line"))
    return head.unionByName(strengths.select("theme", "ts", F.concat_ws(",", F.unix_millis("ts"), "n").alias("line")))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Lines of a report (column line) as text files that follow each other in the order: part-00000 has the first ones, and so on."""
    ranged = lines.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    ranged.select("line").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of what write_lines wrote; files sort by name."""
    return spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("line"))


def strength_lines(lists: DataFrame) -> DataFrame:
    """(theme, line): each theme's (strength, ts) as a line of text 'theme: (strength;milliseconds), ...', as a display reads it."""
    point = lambda p: F.concat(F.lit("("), p["strength"], F.lit(";"), F.unix_millis(p["ts"]), F.lit(")"))
    return lists.select("theme", F.concat(F.col("theme"), F.lit(": "), F.array_join(F.transform("points", point), ", ")).alias("line"))
