"""The two end-to-end plans: evolution graph, and strength of themes over time."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions import periods as P
from ..functions.text import tokenize
from ..operators import background, em, em_blocks, em_packed, graph, hmm, hmm_blocks, strength, terms
from ..operators import themes as theme_reports
from ..shared import settle
from ..sources.articles import select_articles


@dataclass
class Fitted:
    themes: DataFrame
    words: DataFrame
    docs: DataFrame
    #: The background model.
    model: DataFrame


def fit_themes(articles: DataFrame, periods: DataFrame, params: Params, frame: DataFrame | None = None) -> Fitted:
    """Themes of each period. frame: the articles of the background model (none: the same). Page filter as in params."""
    # texts are tokenised once
    found = settle(terms.counted_texts(select_articles(articles, max_page=params.max_page)), "counted")
    model = settle(background.model_of_counts(background.counted_words(found), params.min_count) if frame is None else background.background_model(tokenize(select_articles(frame, max_page=params.max_page)), params.min_count), "model")
    fitted = em_packed.fit_documents(found, model, periods, params.themes, params.lambda_background, params.runs, params.iterations, params.min_tokens, params.min_distinct)
    few = periods.limit(P.BROADCAST_PERIODS + 1).count() <= P.BROADCAST_PERIODS
    scores, words, docs = em.select_themes(fitted, params.themes, params.theme_filter, few)
    named = lambda df: df.withColumn("theme_id", F.col("period_id").cast("long") * params.themes + F.col("theme"))
    themes = named(scores).join(F.broadcast(periods), "period_id").select("theme_id", "period_id", "theme", "p_from", "p_to", "score")
    titles = articles.select(F.col("article_id").alias("doc_id"), "title")
    return Fitted(themes, named(words).select("theme_id", "word", "p"), named(docs).join(titles, "doc_id").select("theme_id", "doc_id", "title", "pi"), model)


def evolution_graph(articles: DataFrame, periods: DataFrame, params: Params) -> DataFrame:
    """(src, dst, divergence, pen_width)."""
    fitted = fit_themes(articles, periods, params)
    links = graph.transitions(fitted.themes, fitted.words, "tv" if params.total_variation else "kl", params.threshold, params.epsilon, params.log_max)
    return graph.edges(links, fitted.themes, max_pen_width=params.max_pen_width)


def draw_evolution_graph(articles: DataFrame, periods: DataFrame, params: Params) -> DataFrame:
    """evolution_graph, written as a drawing to params.output, with the themes' labels."""
    fitted = fit_themes(articles, periods, params)
    links = graph.transitions(fitted.themes, fitted.words, "tv" if params.total_variation else "kl", params.threshold, params.epsilon, params.log_max)
    found = settle(graph.edges(links, fitted.themes, max_pen_width=params.max_pen_width), "edges")
    graph.write_dot(fitted.themes, theme_reports.labels(fitted.words), found, params.output)
    return found


def themes_of_long_period(articles: DataFrame, chunks: int, k: int, params: Params, periods: DataFrame | None = None) -> DataFrame:
    """The k best themes (of all runs) of one long period that is split in chunks. periods: that one period (none: all articles); several are an error."""
    if periods is not None:
        begin, end = P.only(periods)
        articles = select_articles(articles, begin, end)
    found = settle(terms.counted_texts(select_articles(articles, max_page=params.max_page)), "counted")
    model = settle(background.model_of_counts(background.counted_words(found), params.min_count), "model")
    whole = articles.sparkSession.sql("SELECT 0 AS period_id, TIMESTAMP '0001-01-02' AS p_from, TIMESTAMP '9999-01-01' AS p_to")
    packed = em_packed.pack(found, model, whole, params.themes, params.min_tokens, params.min_distinct)
    rows = (settle(terms.terms_of(found, model, whole, params.min_tokens, params.min_distinct), "rows") if packed is None else packed.rows).drop("period_id")
    part = terms.period_chunks(rows.select(F.col("doc_id").alias("article_id")).distinct(), chunks).withColumnRenamed("article_id", "doc_id")
    chunked = settle(rows.join(part, "doc_id").withColumnRenamed("chunk", "period_id"), "terms")
    if packed is None:
        fitted = em_blocks.fit_periods(chunked, model, params.themes, params.lambda_background, params.runs, params.iterations)
    else:
        fitted = em_packed.fit_packed(replace(packed, rows=chunked), params.themes, params.lambda_background, params.runs, params.iterations)
    scores = fitted.where("kind = 'pi'").groupBy("period_id", "run", "theme").agg(F.avg("p").alias("score"))
    return scores.orderBy(F.desc("score"), "period_id", "run", "theme").limit(k)


def hmm_frame(params: Params) -> tuple[dt.datetime, dt.datetime] | None:
    """The frame whose words the HMM reads: hmm_days from hmm_start on."""
    if params.hmm_start is None:
        return None
    begin = dt.datetime.fromisoformat(params.hmm_start)
    return begin, begin + dt.timedelta(days=params.hmm_days)


def theme_strength(articles: DataFrame, periods: DataFrame, params: Params, frame: tuple[dt.datetime, dt.datetime] | None = None) -> DataFrame:
    """(ts, theme, n) of the themes of the periods over the stream of articles, zero-filled.

    frame: begin and end of the articles of the background model (none: all). The periods, and the frame of the HMM if
    params name one, have to lie inside it. No kept theme or no known word gives no rows.
    """
    own = hmm_frame(params)
    if frame is not None:
        P.require_inside(frame, P.bounds(periods), "the periods")
        if own is not None:
            P.require_inside(frame, own, "the frame of the HMM")
        articles = select_articles(articles, *frame)
    fitted = fit_themes(articles, periods, params)
    # the background is that of the fit, and only the frame of the HMM is tokenised again
    words = settle(background.lexicon(fitted.model), "lexicon")
    seen = settle(tokenize(select_articles(articles, *(own or (None, None)), max_page=params.max_page)), "tokens")
    ids = [r.theme_id for r in fitted.themes.select("theme_id").orderBy("theme_id").collect()]
    model = hmm.star(len(ids), hmm.emissions(words, fitted.words, ids))
    return strength.zero_fill(settle(strength_of(terms.word_stream(seen, words), model, params), "strength"), len(ids))


def strength_of(stream: DataFrame, model: hmm.Hmm, params: Params) -> DataFrame:
    """(ts, theme, n) over a stream (pos, word_id, ts): training, then decoding. The stream is dealt into blocks once for both, unless decoding is to have other blocks."""
    stream = settle(stream, "stream")
    with hmm_blocks.BlockStore(stream, params.block_size) as store:
        alone = params.force_sequential or store.length * model.n**2 <= params.sequential_below
        trained = hmm_blocks.train(stream if alone else store, model, params.block_size, params.pi_threshold, params.a_threshold, params.max_iterations, force_sequential=params.force_sequential)
        other = params.viterbi_block_size not in (None, params.block_size)
        decoded = hmm_blocks.decode(stream if other else store, trained, params.viterbi_block_size or params.block_size)
    return strength.strength_by_ts(decoded)
