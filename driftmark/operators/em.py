"""Theme extraction: a mixture of themes and a fixed background, fitted by expectation-maximisation.

Three forms with the same semantics: single steps on DataFrames with one array of K numbers per row, a grouped-map kernel that
runs all iterations of a (period, run) in one task, and blocks of large periods (`em_blocks`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship_package

#: Triples whose posteriors are held at once.
PIECE = 1 << 18
THEMES = "period_id int, run int, ll double, kind string, theme int, doc_id long, word string, p double"


def init_weight(word: Column, theme: Column | int, run: Column | int) -> Column:
    """A whole number from 1 to 1000 by hash."""
    lit = lambda x: F.lit(str(x)) if isinstance(x, int) else x.cast("string")
    return 1 + F.conv(F.substring(F.md5(F.concat_ws("|", word, lit(theme), lit(run))), 1, 7), 16, 10).cast("long") % 1000


def init_themes(terms: DataFrame, k: int, run: int = 0) -> DataFrame:
    """(period_id, word, theme, p): weights of each period's words, scaled to sum 1."""
    words = terms.select("period_id", "word").distinct()
    drawn = words.withColumn("theme", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("w", init_weight(F.col("word"), F.col("theme"), run))
    return drawn.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("period_id", "theme"))).drop("w")


def start_state(terms: DataFrame, k: int, run: int = 0) -> tuple[DataFrame, DataFrame]:
    """(doc: period_id, doc_id, pi) and (word: period_id, word, pw), with arrays over themes."""
    pw = init_themes(terms, k, run).groupBy("period_id", "word").agg(F.array_sort(F.collect_list(F.struct("theme", "p"))).alias("a"))
    docs = terms.select("period_id", "doc_id").distinct().withColumn("pi", F.array_repeat(F.lit(1.0 / k), k))
    return docs, pw.select("period_id", "word", F.transform("a", lambda x: x["p"]).alias("pw"))


def posteriors(terms: DataFrame, background: DataFrame, docs: DataFrame, words: DataFrame, lam: float) -> DataFrame:
    """Per document and word: z (array over themes) and z_b of the background; where no theme can have a word, z is 0."""
    joined = terms.join(words, ["period_id", "word"]).join(docs, ["period_id", "doc_id"]).join(background.select("word", F.col("p").alias("pb")), "word")
    mass = joined.withColumn("m", F.zip_with("pi", "pw", lambda a, b: a * b)).withColumn("s", F.aggregate("m", F.lit(0.0), lambda a, b: a + b))
    z = F.transform("m", lambda x: F.coalesce(F.try_divide(x, F.col("s")), F.lit(0.0)))
    mixture = lam * F.col("pb") + (1 - lam) * F.col("s")
    return mass.select("period_id", "doc_id", "word", "cnt", z.alias("z"), F.coalesce(F.try_divide(lam * F.col("pb"), mixture), F.lit(0.0)).alias("z_b"), mixture.alias("mixture"))


def em_step(terms: DataFrame, background: DataFrame, docs: DataFrame, words: DataFrame, lam: float, k: int) -> tuple[DataFrame, DataFrame]:
    """One iteration: new arrays for documents and words. Both are computed from the same posteriors."""
    post = posteriors(terms, background, docs, words, lam)
    weight = [(F.col("cnt") * (1 - F.col("z_b")) * F.col("z")[j]) for j in range(k)]
    scaled = lambda total: F.array(*[F.coalesce(F.try_divide(F.col(f"s{j}"), total(j)), F.lit(0.0)) for j in range(k)])
    per_doc = post.groupBy("period_id", "doc_id").agg(*[F.sum(w).alias(f"s{j}") for j, w in enumerate(weight)])
    whole = sum((F.col(f"s{j}") for j in range(1, k)), F.col("s0"))
    new_docs = per_doc.select("period_id", "doc_id", scaled(lambda j: whole).alias("pi"))
    per_word = post.groupBy("period_id", "word").agg(*[F.sum(w).alias(f"s{j}") for j, w in enumerate(weight)])
    totals = per_word.groupBy("period_id").agg(*[F.sum(f"s{j}").alias(f"t{j}") for j in range(k)])
    new_words = per_word.join(totals, "period_id").select("period_id", "word", scaled(lambda j: F.col(f"t{j}")).alias("pw"))
    return new_docs, new_words


def log_likelihood(terms: DataFrame, background: DataFrame, docs: DataFrame, words: DataFrame, lam: float) -> DataFrame:
    """(period_id, ll): mean over documents of the mean over distinct words of cnt * ln(mixture)."""
    post = posteriors(terms, background, docs, words, lam)
    per_doc = post.groupBy("period_id", "doc_id").agg((F.sum(F.col("cnt") * F.ln("mixture")) / F.count(F.lit(1))).alias("x"))
    return per_doc.groupBy("period_id").agg(F.avg("x").alias("ll"))


def best_run(runs: DataFrame) -> DataFrame:
    """(period_id, run, ll): the run with the greatest ll, the lowest run on ties; NaN comes last."""
    order = Window.partitionBy("period_id").orderBy(F.when(F.isnan("ll"), None).otherwise(F.col("ll")).desc_nulls_last(), "run")
    return runs.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("period_id", "run", "ll")


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


def mixture_step(doc: np.ndarray, word: np.ndarray, cnt: np.ndarray, pb: np.ndarray, pi: np.ndarray, pw: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """One iteration over sparse triples: new pi (documents x K), and the weight of each theme and word (K x words), not scaled yet. pb: by word.

    Triples are worked through in pieces, so that what is held for each theme does not grow with them.
    """
    d, w, by_theme = np.zeros(pi.shape[::-1]), np.zeros(pw.shape), np.ascontiguousarray(pi.T)
    for at in range(0, len(doc), PIECE):
        i, j, c = doc[at : at + PIECE], word[at : at + PIECE], cnt[at : at + PIECE]
        m = np.empty((len(pw), len(i)))
        for row, a, b in zip(m, by_theme, pw, strict=True):
            np.multiply(a[i], b[j], out=row)
        s, known = m.sum(0), lam * pb[j]
        each = c * ratio(1 - ratio(known, known + (1 - lam) * s), s)
        first, n = int(i.min()), int(i.max()) + 1
        for theme, row in enumerate(m):
            row *= each
            d[theme, first:n] += np.bincount(i - first, row)
            w[theme] += np.bincount(j, row, minlength=pw.shape[1])
    return ratio(d, np.broadcast_to(d.sum(0), d.shape)).T, w


def document_likelihoods(doc: np.ndarray, word: np.ndarray, cnt: np.ndarray, pb: np.ndarray, pi: np.ndarray, pw: np.ndarray, lam: float) -> np.ndarray:
    """Of each document the mean over its distinct words of cnt * ln(mixture)."""
    x, by_theme = np.zeros(len(pi)), np.ascontiguousarray(pi.T)
    for at in range(0, len(doc), PIECE):
        i, j, c = doc[at : at + PIECE], word[at : at + PIECE], cnt[at : at + PIECE]
        s = sum(a[i] * b[j] for a, b in zip(by_theme, pw, strict=True))
        x += np.bincount(i, c * np.log(lam * pb[j] + (1 - lam) * s), minlength=len(pi))
    return x / np.bincount(doc, minlength=len(pi))


def scaled(w: np.ndarray) -> np.ndarray:
    return ratio(w, np.broadcast_to(w.sum(1, keepdims=True), w.shape))


def drawn_weights(words: list[str], k: int, run: int) -> np.ndarray:
    """init_weight of all words, K x words, scaled to sum 1."""
    weights = np.array([np.fromiter((1 + int(hashlib.md5(f"{w}|{j}|{run}".encode()).hexdigest()[:7], 16) % 1000 for w in words), float, len(words)) for j in range(k)])
    return weights / weights.sum(1, keepdims=True)


def kernel(doc: np.ndarray, word: np.ndarray, cnt: np.ndarray, pb: np.ndarray, pw: np.ndarray, lam: float, iterations: int) -> tuple[np.ndarray, np.ndarray, float]:
    """EM on sparse triples. pw: K x words at the start; pb: by triple. Returns pi (documents x K), pw and the log-likelihood."""
    pi = np.full((int(doc.max()) + 1, len(pw)), 1.0 / len(pw))
    by_word = np.zeros(pw.shape[1])
    by_word[word] = pb
    for _ in range(iterations):
        pi, w = mixture_step(doc, word, cnt, by_word, pi, pw, lam)
        pw = scaled(w)
    return pi, pw, float(document_likelihoods(doc, word, cnt, by_word, pi, pw, lam).mean())


def extract_themes(terms: DataFrame, background: DataFrame, k: int = 10, lam: float = 0.95, runs: int = 1, iterations: int = 25) -> DataFrame:
    """All runs of all periods: rows of kind 'pi' (doc_id, theme, p) and 'word' (word, theme, p), with the run's ll.

    A period with its documents is one group (the unit of the model), held with its words as text; groups are spread over tasks by period and run. terms may have any
    int key as period_id, e.g. chunks of one long period. For small periods: `em_blocks.fit_periods` gives the same for any.
    """
    ship_package(terms.sparkSession)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        period, run = int(pdf["period_id"].iloc[0]), int(pdf["run"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "word"])
        doc, docs = pd.factorize(pdf["doc_id"], sort=True)
        word, words = pd.factorize(pdf["word"], sort=True)
        pi, pw, ll = kernel(doc, word, pdf["cnt"].to_numpy(float), pdf["pb"].to_numpy(), drawn_weights(list(words), k, run), lam, iterations)
        a = pd.DataFrame({"kind": "pi", "theme": np.tile(np.arange(k), len(docs)), "doc_id": np.repeat(np.asarray(docs), k), "word": None, "p": pi.ravel()})
        b = pd.DataFrame({"kind": "word", "theme": np.repeat(np.arange(k), len(words)), "doc_id": pd.array([None] * (k * len(words)), "Int64"), "word": np.tile(np.asarray(words), k), "p": pw.ravel()})
        a["doc_id"] = a["doc_id"].astype("Int64")
        out = pd.concat([a, b], ignore_index=True)
        return out.assign(period_id=period, run=run, ll=ll)[["period_id", "run", "ll", "kind", "theme", "doc_id", "word", "p"]]

    rows = terms.join(background.select("word", F.col("p").alias("pb")), "word").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return rows.groupBy("period_id", "run").applyInPandas(fit, THEMES)


def select_themes(fitted: DataFrame, k: int, theme_filter: float | None = 0.9, few: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """few: the periods are so few that what is known of each is broadcast, so that words are not shuffled. Of the best run of each period: (period_id, theme, score), (.., word, p), (.., doc_id, pi). score: mean pi over documents; themes are kept above theme_filter / k."""
    told = F.broadcast if few else lambda df: df
    best = best_run(fitted.select("period_id", "run", "ll").distinct()).select("period_id", "run")
    chosen = fitted.join(told(best), ["period_id", "run"], "left_semi")
    pi = chosen.where("kind = 'pi'").select("period_id", "theme", "doc_id", F.col("p").alias("pi"))
    scores = theme_scores(pi)
    if theme_filter is not None:
        scores = scores.where(F.col("score") > theme_filter / k)
    keep = told(scores.select("period_id", "theme"))
    words = chosen.where("kind = 'word'").select("period_id", "theme", "word", "p").join(keep, ["period_id", "theme"], "left_semi")
    return scores, words, pi.join(keep, ["period_id", "theme"], "left_semi")


def theme_scores(pi: DataFrame) -> DataFrame:
    return pi.groupBy("period_id", "theme").agg(F.avg("pi").alias("score"))
