"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the budget over its size. Each document draws its count by inverting the Poisson
distribution at a number that a hash of seed and doc_id gives, is exploded by that count, and takes a hashed place in a global order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of all sources' distributions together up to which they are broadcast (8 bytes each); beyond, Spark chooses the join.
BROADCAST_STEPS = 2_000_000
#: ln(k!) is taken from a list below this k, and from Stirling's series (exact to the last bits there) from it on.
EXACT_FACTORIALS = 32


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def ln_factorial(k: Column) -> Column:
    """ln(k!) for a whole number k >= 0."""
    known = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(EXACT_FACTORIALS)])
    x = k.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(k < EXACT_FACTORIALS, F.element_at(known, (F.least(k, F.lit(EXACT_FACTORIALS - 1)) + 1).cast("int"))).otherwise(series)


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(src, low, steps): P(X <= k) for k = low, low + 1, ... over all k that a 52-bit number can tell from never and always.

    About 24 standard deviations of k, so a source of rate r has 24 * sqrt(r) + 80 steps; sums run over sorted rows, in linear time.
    """
    spread = 12 * F.sqrt("rate") + 40
    low, top = F.greatest(F.floor(F.col("rate") - spread), F.lit(0)), F.ceil(F.col("rate") + spread)
    each = rates.select("src", "rate", low.cast("long").alias("low"), top.cast("long").alias("top")).select("src", "rate", "low", F.explode(F.sequence("low", "top")).alias("k"))
    mass = F.exp(F.col("k") * F.ln("rate") - F.col("rate") - ln_factorial(F.col("k")))
    order = Window.partitionBy("src").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.select("src", "low", "k", F.sum(mass).over(order).alias("c"))
    return summed.groupBy("src", "low").agg(F.array_sort(F.collect_list("c")).alias("steps"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """(src, size, rate) per source: rate = share * budget / size, sizes in bytes of text.

    weights: target shares by source (scaled to sum 1; sources not named get 0); none: equal shares. Sources without text get the rate 0
    and their share goes to the others. budget: bytes of the mixture; none: as many as there are.
    """
    sizes = docs.groupBy(F.col("source").alias("src")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")).alias("size"))
    if weights is None:
        share: Column = F.lit(1.0)
    else:
        pairs = [F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in weights.items()]
        named = F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,double>")
        share = F.coalesce(F.when(F.col("src").isNotNull(), F.element_at(named, F.col("src"))), F.lit(0.0))
    shares = sizes.withColumn("share", F.when(F.col("size") > 0, share).otherwise(0.0))
    totals = shares.agg(F.sum("share").alias("all_shares"), F.sum("size").alias("all_bytes"))
    goal = F.col("all_bytes") if budget is None else F.lit(float(budget))
    rate = F.when((F.col("share") > 0) & (F.col("all_shares") > 0), F.col("share") / F.col("all_shares") * goal / F.col("size")).otherwise(0.0)
    return shares.join(F.broadcast(totals)).select("src", "size", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, seed: int = 17) -> DataFrame:
    """The mixture: all columns of docs, n_copies, copy_no (1 to n_copies), order_key; sorted by order_key.

    A null source is a source of its own; a null doc_id draws as the text 'null' does; rows with one doc_id get the same count each. Null and
    empty texts weigh nothing but are drawn at their source's rate. An empty table gives no rows. Columns of docs that are called as the
    three new ones are replaced; any other name may occur.
    """
    rates = source_rates(docs, weights, budget).where("rate > 0").select("src", "rate")
    steps = poisson_steps(rates)
    total = rates.agg(F.sum(24 * F.sqrt("rate") + 90).alias("n")).first().n or 0
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))
    # the documents' own columns stay in a struct until the end, so that none of their names can clash
    own = docs.drop("n_copies", "copy_no", "order_key")
    rows = own.select(F.struct(*[own[c] for c in own.columns]).alias("row"))
    joined = rows.join(F.broadcast(steps) if total <= BROADCAST_STEPS else steps, F.col("row.source").eqNullSafe(F.col("src")))
    drawn = joined.select("row", "low", "steps", uniform(F.lit(str(seed)), key).alias("u"))
    count = F.col("low") + F.size(F.filter("steps", lambda c: c <= F.col("u")))
    counted = drawn.select("row", count.cast("int").alias("n_copies")).where("n_copies > 0")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key, F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("long")
    ordered = copies.withColumn("order_key", place).orderBy("order_key", "row.doc_id", "copy_no")
    return ordered.select("row.*", "n_copies", "copy_no", "order_key")
