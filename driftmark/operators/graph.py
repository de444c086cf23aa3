"""Evolution graph: directed links from themes to later ones by smoothed Kullback-Leibler divergence or total variation.

A word that only the earlier theme has adds the same to the divergence from it whatever the later theme is, so a pair costs its shared words
only. Below a threshold most pairs need not be looked at: a theme's rarest words are its prefix, as many of them that a theme without any of them is too far away, and only pairs that
meet in a prefix are candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import settle
from ..sources.catalog import write_lines


#: Themes from which candidates are looked for before divergences are summed up.
MANY = 200


def _log(p: Column, q: Column, log_max: float) -> Column:
    return F.greatest(F.lit(-log_max), F.least(F.lit(log_max), F.ln(p / q)))


def candidates(themes: DataFrame, theme_words: DataFrame, metric: str, threshold: float, epsilon: float, log_max: float) -> DataFrame:
    """(src, dst) of later themes that can be nearer than the threshold, each once.

    A later theme without the words X of the source is at least so far away (in total variation) as X has mass p(X). Its divergence, times 1 + n * epsilon, is at least the sum
    of what X adds and r * ln(r / (1 + n * epsilon)) with r the mass of the other words, by the log-sum inequality. A prefix is the shortest X, from
    the rarest word on, for which that reaches the threshold. Where even all words do not, every later theme is near. By total variation the later theme has a prefix, too:
    two themes with enough mass in common, in one order of words, share a word in both prefixes.
    """
    kl = metric == "kl"
    p, e = F.col("p"), F.lit(epsilon)
    order = Window.partitionBy("theme_id").orderBy("df", "word")
    whole = Window.partitionBy("theme_id")
    often = theme_words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rows = theme_words.join(often, "word").select("theme_id", "word", "df", F.greatest(p, F.lit(0.0)).alias("p"))
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("own", (p + e) * _log(p + e, e, log_max) if kl else p).withColumn("mass", F.sum("p").over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("all", F.sum("own").over(whole)).withColumn("cum", before("own")).withColumn("left", F.greatest(F.col("mass") - before("p"), F.lit(0.0)))
    slack = F.lit(1e-6)
    if kl:
        scale = 1 + F.col("n") * epsilon
        rest = F.when(F.col("left") > 0, F.col("left") * F.ln(F.col("left") / scale)).otherwise(0.0)
        reached, near = F.col("cum") + F.least(rest, F.lit(0.0)) >= threshold * scale + slack, F.col("all") < threshold * scale + slack
    else:
        reached, near = F.col("cum") >= threshold + slack, F.col("all") < threshold + slack
    rows = rows.withColumn("done", F.max(reached).over(order)).withColumn("near", near)
    source = rows.where("not done and not near").select(F.col("theme_id").alias("src"), "word").join(themes.select(F.col("theme_id").alias("src"), F.col("p_to").alias("a_to")), "src")
    target = rows
    if not kl:
        # mass in common that each source demands, and what of a target stands before it
        least = rows.where("not near").agg(F.min(F.col("mass") - threshold).alias("need"))
        target = rows.crossJoin(F.broadcast(least)).where(F.col("left") > F.col("need") - slack)  # one row
    target = target.select(F.col("theme_id").alias("dst"), "word").join(themes.select(F.col("theme_id").alias("dst"), F.col("p_from").alias("b_from")), "dst")
    met = source.join(target, "word").where("a_to <= b_from").select("src", "dst").distinct()
    free = rows.where("near").select(F.col("theme_id").alias("src")).distinct().join(themes.select(F.col("theme_id").alias("src"), F.col("p_to").alias("a_to")), "src")
    later = themes.select(F.col("theme_id").alias("dst"), F.col("p_from").alias("b_from"))
    # those are links, or as near to one as rounding is
    return met.unionByName(free.join(later, F.col("a_to") <= F.col("b_from")).select("src", "dst"))


def transitions(themes: DataFrame, theme_words: DataFrame, metric: str = "kl", threshold: float | None = 8.0, epsilon: float = 1e-7, log_max: float = 1000.0, digits: int | None = None) -> DataFrame:
    """(src, dst, divergence) for themes whose period ends before the other's begins, below the threshold.

    themes: (theme_id, p_from, p_to); theme_words: (theme_id, word, p), each word of a theme once. With a threshold, and from MANY themes on, only candidates are summed up.
    """
    kl = metric == "kl"
    if threshold is not None and themes.limit(MANY).count() == MANY:
        found = settle(candidates(themes, theme_words, metric, threshold, epsilon, log_max), "candidates")
    else:
        found = None
    ps, pt, e = F.col("ps"), F.col("pt"), F.lit(epsilon)
    own = (ps + e) * _log(ps + e, e, log_max) if kl else F.greatest(F.lit(0.0), ps)
    source = theme_words.select(F.col("theme_id").alias("src"), "word", F.col("p").alias("ps"))
    target = theme_words.select(F.col("theme_id").alias("dst"), "word", F.col("p").alias("pt"))
    base = source.groupBy("src").agg(F.sum(own).alias("base"), F.count(F.lit(1)).alias("n"))
    a = themes.select(F.col("theme_id").alias("src"), F.col("p_to").alias("a_to"))
    b = themes.select(F.col("theme_id").alias("dst"), F.col("p_from").alias("b_from"))
    if found is None:
        pairs = a.join(b, F.col("a_to") <= F.col("b_from")).select("src", "dst")
        later = source.join(a, "src").join(target.join(b, "dst"), "word").where("a_to <= b_from")
    else:
        pairs = found
        later = pairs.join(source, "src").join(target, ["dst", "word"])
    change = ((ps + e) * _log(ps + e, pt + e, log_max) if kl else F.greatest(F.lit(0.0), ps - pt)) - own
    shared = later.groupBy("src", "dst").agg(F.sum(change).alias("change"))
    value = F.col("base") + F.coalesce("change", F.lit(0.0))
    value = value / (1 + F.col("n") * epsilon) if kl else value
    value = value if digits is None else F.round(value, digits)
    out = pairs.join(base, "src").join(shared, ["src", "dst"], "left").select("src", "dst", value.alias("divergence"))
    return out if threshold is None else out.where(F.col("divergence") < threshold)


def nodes(themes: DataFrame, labels: DataFrame, begin=None, end=None) -> DataFrame:
    """(p_from, labels): sorted labels of the themes by begin, of periods inside the window."""
    inside = themes if begin is None else themes.where((F.col("p_from") >= F.lit(begin)) & (F.col("p_to") <= F.lit(end)))
    return inside.join(labels, "theme_id").groupBy("p_from").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def edges(links: DataFrame, themes: DataFrame, begin=None, end=None, max_pen_width: float = 3.0) -> DataFrame:
    """(src, dst, divergence, pen_width): links with both ends inside the window; the closest has 0.2 + max_pen_width, so have all where all are equal."""
    if begin is not None:
        ok = themes.where((F.col("p_from") >= F.lit(begin)) & (F.col("p_to") <= F.lit(end))).select("theme_id")
        links = links.join(ok.withColumnRenamed("theme_id", "src"), "src", "left_semi").join(ok.withColumnRenamed("theme_id", "dst"), "dst", "left_semi")
    # read for the bounds and for the links
    links = settle(links, "links")
    bounds = links.agg(F.min("divergence").alias("lo"), F.max("divergence").alias("hi"))
    share = F.coalesce(F.try_divide(F.col("hi") - F.col("divergence"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(1.0))
    return links.crossJoin(F.broadcast(bounds)).select("src", "dst", "divergence", (0.2 + share * max_pen_width).alias("pen_width"))


def edge_report(edge_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, line): both ends of each link by their labels, and the divergence."""
    end = lambda c: labels.select(F.col("theme_id").alias(c), F.trim("label").alias(f"{c}_label"))
    named = edge_rows.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    name = lambda c: F.concat(F.lit("["), F.coalesce(f"{c}_label", F.lit("")), F.lit("]"))
    return named.select("src", "dst", F.concat(name("src"), F.lit(" -> "), name("dst"), F.lit(" : "), F.format_number("divergence", 4)).alias("line"))


def dot_lines(themes: DataFrame, labels: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(part, line) of a GraphViz file: dates as a spine, themes of a date on one rank, edges with their width. Sort by both and write as text."""
    day = F.date_format("p_from", "yyyy-MM-dd")
    named = themes.join(labels, "theme_id")
    days = themes.select(day.alias("d")).distinct()
    q = F.lit('"')
    spine = days.agg(F.array_join(F.array_sort(F.collect_list(F.concat(q, F.col("d"), q))), " -> ").alias("x")).select(F.lit(1).alias("part"), F.concat(F.col("x"), F.lit(";")).alias("line"))
    head = themes.sparkSession.createDataFrame([(0, "digraph evolution {"), (9, "}")], "part int, line string")
    node = named.select(F.lit(2).alias("part"), F.concat(F.lit("{rank=same; "), q, day, q, F.lit("; t"), F.col("theme_id"), F.lit(' [label="'), F.col("label"), F.lit('"];}')).alias("line"))
    edge = edge_rows.select(F.lit(3).alias("part"), F.concat(F.lit("t"), F.col("src"), F.lit(" -> t"), F.col("dst"), F.lit(" [penwidth="), F.round("pen_width", 4), F.lit("];")).alias("line"))
    return head.unionByName(spine).unionByName(node).unionByName(edge)


def write_dot(themes: DataFrame, labels: DataFrame, edge_rows: DataFrame, path: str) -> None:
    """A GraphViz drawing as text files that make one when they are put together by name."""
    write_lines(dot_lines(themes, labels, edge_rows), ["part", "line"], path)


def read_dot_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, pen_width) of a written drawing."""
    part = lambda i, kind: F.regexp_extract("value", r"^t(\d+) -> t(\d+) \[penwidth=([0-9.E-]+)\];$", i).cast(kind)
    return spark.read.text(path).where(F.col("value").rlike(r"^t\d+ -> t")).select(part(1, "long").alias("src"), part(2, "long").alias("dst"), part(3, "double").alias("pen_width"))


def reachable(edge_rows: DataFrame, start: int) -> DataFrame:
    """(theme_id, step): all themes that links lead to from one, with the fewest links. Links go on in time, so it ends."""
    links = settle(edge_rows.select("src", "dst").distinct(), "links")
    found = links.sparkSession.createDataFrame([(start, 0)], "theme_id long, step int")
    step = 0
    while True:
        step += 1
        front = found.where(F.col("step") == step - 1)
        new = front.join(links, front["theme_id"] == links["src"]).select(F.col("dst").alias("theme_id")).distinct().join(found, "theme_id", "left_anti").withColumn("step", F.lit(step))
        new = settle(new, "step")
        if new.isEmpty():
            return found
        found = found.unionByName(new)


def components(edge_rows: DataFrame) -> DataFrame:
    """(theme_id, component): the least theme that links connect, whatever their direction. Themes are few; labels spread by joins until none changes."""
    both = edge_rows.select("src", "dst").union(edge_rows.select("dst", "src")).distinct()
    both = settle(both, "links")
    labels = both.select(F.col("src").alias("theme_id"), F.col("src").alias("component")).distinct()
    while True:
        near = both.join(labels, both["dst"] == labels["theme_id"]).groupBy("src").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels["theme_id"] == near["src"]).select("theme_id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        new = settle(spread, "labels")
        labels = new.select("theme_id", "component")
        if new.where("old <> component").isEmpty():
            return labels


def trans_collection_themes(edge_rows: DataFrame, theme_words: DataFrame) -> DataFrame:
    """(component, word, p): the mean distribution of each component's themes."""
    member = components(edge_rows)
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return theme_words.join(member, "theme_id").join(size, "component").groupBy("component", "word").agg(F.sum(F.col("p") / F.col("n")).alias("p"))
