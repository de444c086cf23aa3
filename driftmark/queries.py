"""The registered queries over the engine's operators, with their SQL where SQL can express them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Params
from .functions import periods as P
from .functions.text import tokenize, words
from .operators import background, em, em_blocks, em_packed, graph, hmm, hmm_blocks, spatial, strength, terms, themes
from .plans import pipelines
from .sources import catalog, svg
from .shared import settle, shared_path
from .sources import articles as article_files
from .sources.articles import articles_from_documents, select_articles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
START = dt.datetime(2024, 1, 1)
PARAMS = Params()
LANGS = ("de", "en", "es", "fr")
K, LAM = 3, 0.95


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(select_articles(articles(spark, sf_dir), max_page=PARAMS.max_page))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def weeks(spark: SparkSession) -> DataFrame:
    return P.tumbling(spark, START, 7, 8)


def model_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Background model and weekly document terms, written: several joins of one query read them."""
    docs = settle(terms.counted(tokens(spark, sf_dir)), "counted")
    model = settle(background.model_of_counts(background.counted_words(docs), PARAMS.min_count), "model")
    return model, settle(terms.terms_of(docs, model, weeks(spark)), "terms")


def simple_themes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Deterministic themes: the unigram distribution of each week and language. (themes, theme_words)."""
    rows = P.assign(articles(spark, sf_dir), weeks(spark))
    lang = F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang")).cast("long")
    # texts are read once, however often a query reads the themes
    counts = settle(terms.word_counts(rows.where(lang > 0).select((F.col("period_id") * 10 + lang).alias("key"), "full_text")).withColumnRenamed("key", "theme_id"), "counts")
    total = settle(counts.groupBy("theme_id").agg(F.sum("cnt").alias("total")), "total")
    found = total.join(F.broadcast(weeks(spark)), F.floor(F.col("theme_id") / 10) == F.col("period_id")).select("theme_id", "p_from", "p_to")
    # themes are four a week, so what is known of them goes to their words
    return found, counts.join(F.broadcast(total), "theme_id").select("theme_id", "word", (F.col("cnt") / F.col("total")).alias("p"))


def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a decoded stream: the state follows from event_id."""
    return events(spark, sf_dir).select(F.date_trunc("day", "ts").alias("ts"), F.pmod("event_id", F.lit(5)).cast("int").alias("state"))


ARTICLES = """articles AS (
  SELECT doc_id AS article_id, 'doc-' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'GDL' ELSE 'JDG' END AS stream,
    CAST(1 + (doc_id // 2) % 6 AS INTEGER) AS page_no, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(doc_id % 56 AS INTEGER)) AS issue_ts, text AS full_text, lang FROM documents
)"""
TOKENS = ARTICLES + r""", alltok AS (
  SELECT article_id, issue_ts, page_no, lang, list_filter(regexp_split_to_array(lower(full_text), '[^\p{L}]+'), lambda w: w <> '') AS words FROM articles
), tok AS (SELECT * FROM alltok WHERE page_no <= 3)"""
MODEL = TOKENS + """, counts AS (
  SELECT word, count(*) AS cnt FROM (SELECT unnest(words) AS word FROM tok) GROUP BY word
), kept AS (SELECT * FROM counts WHERE cnt >= 30
), bg AS (SELECT word, cnt, CAST(sum(cnt) OVER () AS BIGINT) AS total, cnt / sum(cnt) OVER () AS p FROM kept)"""
WEEKS = """, weeks AS (
  SELECT CAST(i AS INTEGER) AS period_id, TIMESTAMP '2024-01-01' + to_days(CAST(7 * i AS INTEGER)) AS p_from, TIMESTAMP '2024-01-01' + to_days(CAST(7 * i + 7 AS INTEGER)) AS p_to FROM generate_series(0, 7) t(i)
)"""
TERMS = MODEL + WEEKS + """, dw AS (
  SELECT article_id AS doc_id, issue_ts, word, count(*) AS cnt FROM (SELECT article_id, issue_ts, unnest(words) AS word FROM tok WHERE len(words) >= 50) GROUP BY ALL
), dk AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM dw WHERE word IN (SELECT word FROM bg)
), dt AS (SELECT period_id, doc_id, word, cnt FROM dk JOIN weeks ON issue_ts > p_from AND issue_ts < p_to WHERE n > 50)"""
INIT = TERMS + """, vocab AS (SELECT DISTINCT period_id, word FROM dt
), drawn AS (
  SELECT period_id, word, j AS theme, r AS run, 1 + CAST('0x' || substr(md5(word || '|' || j || '|' || r), 1, 7) AS BIGINT) % 1000 AS w FROM vocab, generate_series(0, 2) t(j), generate_series(0, 1) u(r)
), tw0 AS (SELECT period_id, run, word, theme, w / sum(w) OVER (PARTITION BY period_id, run, theme) AS p FROM drawn
), pi0 AS (SELECT DISTINCT period_id, run, doc_id, theme, 1.0 / 3 AS pi FROM dt JOIN (SELECT DISTINCT period_id AS q, run, theme FROM drawn) ON q = period_id)"""


def em_sql(i: int) -> str:
    """Posteriors e<i> from state i."""
    return f""", s{i} AS (
  SELECT d.period_id, t.run, d.doc_id, d.word, d.cnt, t.theme, i.pi * t.p AS m, sum(i.pi * t.p) OVER (PARTITION BY d.period_id, t.run, d.doc_id, d.word) AS s, b.p AS pb
  FROM dt d JOIN tw{i} t ON t.period_id = d.period_id AND t.word = d.word JOIN pi{i} i ON i.period_id = d.period_id AND i.run = t.run AND i.doc_id = d.doc_id AND i.theme = t.theme JOIN bg b ON b.word = d.word
), e{i} AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE m / s END AS z, 0.95 * pb / (0.95 * pb + 0.05 * s) AS z_b, 0.95 * pb + 0.05 * s AS mixture FROM s{i})"""


def step_sql(i: int) -> str:
    return em_sql(i) + f""", g{i} AS (SELECT *, cnt * (1 - z_b) * z AS x FROM e{i}
), pi{i + 1} AS (SELECT period_id, run, doc_id, theme, x / sum(x) OVER (PARTITION BY period_id, run, doc_id) AS pi FROM (SELECT period_id, run, doc_id, theme, sum(x) AS x FROM g{i} GROUP BY ALL)
), tw{i + 1} AS (SELECT period_id, run, word, theme, x / sum(x) OVER (PARTITION BY period_id, run, theme) AS p FROM (SELECT period_id, run, word, theme, sum(x) AS x FROM g{i} GROUP BY ALL))"""


LL = INIT + step_sql(0) + step_sql(1) + em_sql(2) + """, ll AS (
  SELECT period_id, run, avg(x) AS ll FROM (SELECT period_id, run, doc_id, sum(cnt * ln(mixture)) / count(*) AS x FROM e2 WHERE theme = 0 GROUP BY ALL) GROUP BY ALL
)"""
THEMES = TOKENS + WEEKS + """, tc AS (
  SELECT period_id * 10 + list_position(['de', 'en', 'es', 'fr'], lang) AS theme_id, p_from, p_to, word, count(*) AS cnt
  FROM (SELECT period_id, p_from, p_to, lang, unnest(words) AS word FROM alltok JOIN weeks ON issue_ts > p_from AND issue_ts < p_to WHERE list_position(['de', 'en', 'es', 'fr'], lang) > 0) GROUP BY ALL
), theme AS (SELECT theme_id, p_from, p_to, sum(cnt) AS total FROM tc GROUP BY ALL
), tw AS (SELECT theme_id, word, cnt / total AS p FROM tc JOIN theme USING (theme_id))"""
LABELS = THEMES + """, lw AS (
  SELECT theme_id, word, row_number() OVER (PARTITION BY theme_id ORDER BY p DESC, word) AS rn FROM tw WHERE length(word) > 5
), labels AS (SELECT theme_id, string_agg(word, ' ' ORDER BY rn) || ' ' AS label FROM lw WHERE rn <= 4 GROUP BY theme_id)"""


def link_sql(metric: str) -> str:
    kl = "greatest(-1000.0, least(1000.0, ln((ps + 1e-7) / (pt + 1e-7))))"
    value = f"sum((ps + 1e-7) * {kl}) / (1 + count(*) * 1e-7)" if metric == "kl" else "sum(greatest(0.0, ps - pt))"
    return f""", pairs AS (SELECT a.theme_id AS src, b.theme_id AS dst FROM theme a JOIN theme b ON a.p_to <= b.p_from
), joined AS (SELECT src, dst, s.p AS ps, coalesce(t.p, 0) AS pt FROM pairs JOIN tw s ON s.theme_id = src LEFT JOIN tw t ON t.theme_id = dst AND t.word = s.word
), links AS (SELECT src, dst, round({value}, 6) AS divergence FROM joined GROUP BY src, dst)"""


DECODED = "decoded AS (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, CAST(event_id % 5 AS INTEGER) AS state FROM events)"
BY_TS = DECODED + ", st AS (SELECT ts, state AS theme, count(*) AS n FROM decoded WHERE state <> 0 GROUP BY ALL)"


@query(f"WITH {TOKENS} SELECT article_id, CAST(len(words) AS BIGINT) AS n_tokens, CAST(len(list_distinct(words)) AS BIGINT) AS n_words FROM alltok")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokenize(articles(spark, sf_dir))
    return rows.select("article_id", F.size("words").cast("long").alias("n_tokens"), F.size(F.array_distinct("words")).cast("long").alias("n_words"))


@query(f"WITH {MODEL} SELECT word, cnt, total, round(p, 12) AS p FROM bg")
def background_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return background.background_model(tokens(spark, sf_dir), PARAMS.min_count).withColumn("p", F.round("p", 12))


@query(f"WITH {MODEL} SELECT cnt, count(*) AS n_words FROM counts WHERE cnt BETWEEN 1 AND 49 GROUP BY cnt")
def count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return background.count_histogram(tokens(spark, sf_dir))


DATED = ARTICLES.replace("to_days(CAST(doc_id % 56 AS INTEGER))", "to_days(CAST(doc_id % 4000 AS INTEGER))").replace("2024-01-01 12:00:00", "1990-03-01 12:00:00")


def dated_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose days go over eleven years."""
    day = F.expr("TIMESTAMP '1990-03-01 12:00:00' + make_dt_interval(cast(article_id % 4000 as int))")
    return articles(spark, sf_dir).withColumn("issue_ts", day)


@query(f"""WITH {DATED}, p AS (SELECT * FROM (VALUES (0, TIMESTAMP '1990-12-20', TIMESTAMP '1991-02-01'), (1, TIMESTAMP '1991-01-15', TIMESTAMP '1991-06-01'), (2, TIMESTAMP '1993-05-01', TIMESTAMP '1993-05-21')) t(period_id, p_from, p_to))
SELECT CAST(period_id AS INTEGER) AS period_id, CAST(year(issue_ts) AS INTEGER) AS year, stream, count(*) AS n_articles, CAST(sum(strlen(full_text)) AS BIGINT) AS n_bytes FROM articles JOIN p ON issue_ts > p_from AND issue_ts < p_to GROUP BY ALL""")
def article_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written by year and stream, and of these what lies in three periods of four years."""
    path = shared_path(spark, "store")
    article_files.write_article_store(dated_articles(spark, sf_dir), path)
    periods = P.from_rows(spark, [(dt.datetime(1990, 12, 20), dt.datetime(1991, 2, 1)), (dt.datetime(1991, 1, 15), dt.datetime(1991, 6, 1)), (dt.datetime(1993, 5, 1), dt.datetime(1993, 5, 21))])
    found = article_files.articles_of_periods(article_files.read_article_store(spark, path), periods)
    return found.groupBy("period_id", "year", "stream").agg(F.count(F.lit(1)).alias("n_articles"), F.sum(F.octet_length("full_text").cast("long")).alias("n_bytes"))


@query("SELECT 'articles' || year(o_orderdate) || '.xml' AS file, count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1999-06-01' GROUP BY file")
def year_file_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin, end = dt.datetime(1996, 3, 1), dt.datetime(1999, 6, 1)
    from .sources.articles import year_files

    files = spark.createDataFrame([(f,) for f in year_files(begin, end)], "file string")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where((F.col("o_orderdate") > F.lit(begin)) & (F.col("o_orderdate") < F.lit(end)))
    named = rows.groupBy(F.concat(F.lit("articles"), F.year("o_orderdate"), F.lit(".xml")).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return named.join(F.broadcast(files), "file", "left_semi")


@query(f"WITH {ARTICLES} SELECT article_id, title, stream, page_no, issue_ts FROM articles WHERE page_no <= 3 AND stream IN ('GDL', 'JDG') AND issue_ts > TIMESTAMP '2024-01-03 12:00:00' AND issue_ts < TIMESTAMP '2024-02-10'")
def page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select_articles(articles(spark, sf_dir), dt.datetime(2024, 1, 3, 12), dt.datetime(2024, 2, 10), PARAMS.max_page)
    return rows.select("article_id", "title", "stream", "page_no", "issue_ts")


def events_sql(width: str, step: str, n: int) -> str:
    return f"""WITH p AS (SELECT CAST(i AS INTEGER) AS period_id, TIMESTAMP '2024-01-01' + i * INTERVAL '{step}' AS p_from, TIMESTAMP '2024-01-01' + i * INTERVAL '{step}' + INTERVAL '{width}' AS p_to FROM generate_series(0, {n - 1}) t(i))
      SELECT period_id, p_from, p_to, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN p ON ts > p_from AND ts < p_to GROUP BY ALL"""


def per_period(rows: DataFrame) -> DataFrame:
    return rows.groupBy("period_id", "p_from", "p_to").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(events_sql("5 days", "5 days", 8))
def tumbling_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_period(P.assign(events(spark, sf_dir), P.tumbling(spark, START, 5, 8), "ts"))


@query(events_sql("242 hours", "7 days", 5))
def sliding_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_period(P.assign(events(spark, sf_dir), P.sliding(spark, START, dt.timedelta(days=10, hours=2), dt.timedelta(days=7), 5), "ts", bucket_days=7))


@query(f"WITH {ARTICLES}{WEEKS} SELECT min(p_from) AS p_from, max(p_to) AS p_to, (SELECT count(*) FROM articles, (SELECT min(p_from) AS a, max(p_to) AS b FROM weeks) WHERE issue_ts > a AND issue_ts < b) AS n FROM weeks")
def englobing_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = P.englobing(weeks(spark))
    return P.assign(articles(spark, sf_dir), frame).groupBy("p_from", "p_to").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ARTICLES}{WEEKS} SELECT period_id, count(*) AS n_articles FROM articles JOIN weeks ON issue_ts > p_from AND issue_ts < p_to GROUP BY period_id")
def articles_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.articles_per_period(articles(spark, sf_dir), weeks(spark))


@query(f"WITH {TERMS} SELECT * FROM dt")
def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_terms(spark, sf_dir)[1]


@query(f"WITH {MODEL} SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id, round(p, 12) AS p FROM bg")
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return background.lexicon(background.background_model(tokens(spark, sf_dir))).withColumn("p", F.round("p", 12))


@query(f"""WITH {MODEL}, lex AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM bg
), each AS (SELECT article_id, issue_ts, unnest(words) AS word, unnest(generate_series(1, len(words))) AS o FROM tok)
SELECT row_number() OVER (ORDER BY issue_ts, article_id, o) - 1 AS pos, word_id, issue_ts AS ts FROM each JOIN lex USING (word)""")
def word_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokens(spark, sf_dir)
    return terms.word_stream(tok, background.lexicon(background.background_model(tok)))


@query(f"""WITH {MODEL}, lex AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM bg
), each AS (SELECT article_id, issue_ts, unnest(words) AS word, unnest(generate_series(1, len(words))) AS o FROM tok)
SELECT row_number() OVER (ORDER BY issue_ts, article_id, o) - 1 AS pos, word_id FROM each JOIN lex USING (word) ORDER BY issue_ts, article_id, o LIMIT 50""")
def stream_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 words of the stream, for a look."""
    return word_stream(spark, sf_dir).orderBy("pos").limit(50).select("pos", "word_id")


@query(f"WITH {TOKENS} SELECT CAST(a.article_id AS VARCHAR) AS article_id, title, stream, a.page_no, a.issue_ts, array_to_string(words, ' ') AS full_text FROM alltok t JOIN articles a USING (article_id) WHERE a.page_no <= 3 AND len(words) > 0 AND a.issue_ts > TIMESTAMP '2023-12-31' AND a.issue_ts < TIMESTAMP '2024-02-20'")
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles, their words as text, written as XML and read again from year files, of which one year has none."""
    folder = shared_path(spark, "xml")
    rows = articles(spark, sf_dir).withColumn("full_text", F.array_join(words(F.col("full_text")), " "))
    article_files.write_article_xml(rows, f"{folder}/articles2024.xml")
    return article_files.read_article_xml(spark, [folder], dt.datetime(2023, 12, 31), dt.datetime(2024, 2, 20), PARAMS.max_page)


@query(ORACLE_SQL["xml_round_trip"])
def nested_xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles written with their fields at other depths (a namespace, texts beside the metadata and below a body), and read by local tag names."""
    folder = shared_path(spark, "nested")
    rows = articles(spark, sf_dir).withColumn("full_text", F.array_join(words(F.col("full_text")), " "))
    tag = lambda name, value: F.concat(F.lit(f"<d:{name}>"), value, F.lit(f"</d:{name}>"))
    head = F.concat(tag("id", F.col("article_id").cast("string")), F.lit("<d:head><d:where>"), tag("publication", F.col("stream")), tag("page_no", F.col("page_no").cast("string")), F.lit("</d:where>"), tag("name", F.col("title")), F.lit("</d:head>"))
    half = F.floor(F.length("full_text") / 2).cast("int")
    first, second = F.substring("full_text", F.lit(1), half), F.substring("full_text", half + 1, F.length("full_text"))
    entities = F.concat(F.lit("<d:entity><d:body>"), tag("full_text", first), F.lit("</d:body>"), head, tag("issue_date", F.date_format("issue_ts", "dd/MM/yyyy")), F.lit("</d:entity><d:entity>"), tag("name", F.lit("later")), tag("full_text", second), F.lit("</d:entity>"))
    rows.select(F.concat(F.lit("<d:article>"), entities, F.lit("</d:article>")).alias("value")).write.text(f"{folder}/articles2024.xml")
    return article_files.read_nested_xml(spark, [folder], dt.datetime(2023, 12, 31), dt.datetime(2024, 2, 20), PARAMS.max_page, prefix="d:")


@query(f"WITH {INIT} SELECT period_id, word, CAST(theme AS INTEGER) AS theme, round(p, 12) AS p FROM tw0 WHERE run = 0")
def theme_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return em.init_themes(model_terms(spark, sf_dir)[1], K).withColumn("p", F.round("p", 12))


@query(f"WITH {INIT}{em_sql(0)} SELECT period_id, doc_id, word, CAST(theme AS INTEGER) AS theme, round(z, 8) AS z, round(z_b, 8) AS z_b FROM e0 WHERE run = 0")
def em_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = model_terms(spark, sf_dir)
    post = em.posteriors(rows, model, *em.start_state(rows, K), LAM)
    return post.select("period_id", "doc_id", "word", F.posexplode("z").alias("theme", "z"), "z_b").select("period_id", "doc_id", "word", "theme", F.round("z", 8).alias("z"), F.round("z_b", 8).alias("z_b"))


@query(f"WITH {INIT}{step_sql(0)}{step_sql(1)} SELECT period_id, word, CAST(theme AS INTEGER) AS theme, round(p, 8) AS p FROM tw2 WHERE run = 0")
def em_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = model_terms(spark, sf_dir)
    fitted = em_blocks.fit_periods(rows, model, K, LAM, 1, 2).where("kind = 'word'")
    return fitted.select("period_id", "word", "theme", F.round("p", 8).alias("p"))


@query(ORACLE_SQL["em_iterations"])
def em_block_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by blocks of documents, as very large periods are fitted."""
    model, rows = model_terms(spark, sf_dir)
    fitted = em_blocks.fit_blocks(rows, model, K, LAM, 1, 2, block_rows=20_000).where("kind = 'word'")
    return fitted.select("period_id", "word", "theme", F.round("p", 8).alias("p"))


def likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = model_terms(spark, sf_dir)
    return em_blocks.fit_periods(rows, model, K, LAM, 2, 2).select("period_id", "run", "ll").distinct()


@query(f"WITH {LL} SELECT period_id, CAST(run AS INTEGER) AS run, round(ll, 6) AS ll FROM ll")
def em_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihoods(spark, sf_dir).withColumn("ll", F.round("ll", 6))


@query(f"WITH {LL} SELECT period_id, CAST(arg_max(run, (round(ll, 6), -run)) AS INTEGER) AS run, max(round(ll, 6)) AS ll FROM ll GROUP BY period_id")
def em_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return em.best_run(likelihoods(spark, sf_dir).withColumn("ll", F.round("ll", 6)))


@query(f"WITH {INIT}{step_sql(0)}{step_sql(1)} SELECT period_id, CAST(theme AS INTEGER) AS theme, round(avg(pi), 8) AS score FROM pi2 WHERE run = 0 GROUP BY ALL HAVING avg(pi) > 0.9 / 3")
def theme_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = model_terms(spark, sf_dir)
    fitted = em_blocks.fit_periods(rows, model, K, LAM, 1, 2)
    return em.select_themes(fitted, K, PARAMS.theme_filter)[0].withColumn("score", F.round("score", 8))


@query(f"WITH {THEMES}, r AS (SELECT theme_id, row_number() OVER (PARTITION BY theme_id ORDER BY p DESC, word) AS rank, word, p FROM tw WHERE length(word) >= 4) SELECT theme_id, CAST(rank AS INTEGER) AS rank, word, round(p, 9) AS p FROM r WHERE rank <= 13")
def theme_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.top_words(simple_themes(spark, sf_dir)[1], 12).withColumn("p", F.round("p", 9))


@query(f"WITH {LABELS} SELECT theme_id, label FROM labels")
def theme_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.labels(simple_themes(spark, sf_dir)[1])


def pi_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of documents in themes: what part of a document's tokens are among its week's words of three letters or fewer, by language."""
    rows = P.assign(tokenize(articles(spark, sf_dir)), weeks(spark))
    lang = F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang")).cast("long")
    short = F.size(F.filter("words", lambda w: F.length(w) <= 3)) / F.greatest(F.size("words"), F.lit(1))
    return rows.where(lang > 0).select((F.col("period_id") * 10 + lang).alias("theme_id"), F.col("article_id").alias("doc_id"), "title", F.round(short, 9).alias("pi"))


@query(f"""WITH {TOKENS}{WEEKS}, pd AS (
  SELECT period_id * 10 + list_position(['de', 'en', 'es', 'fr'], lang) AS theme_id, article_id, 'doc-' || article_id AS title, round(len(list_filter(words, lambda w: length(w) <= 3)) / greatest(len(words), 1), 9) AS pi
  FROM alltok JOIN weeks ON issue_ts > p_from AND issue_ts < p_to WHERE list_position(['de', 'en', 'es', 'fr'], lang) > 0
), r AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY pi DESC, article_id) AS rank FROM pd) SELECT theme_id, CAST(rank AS INTEGER) AS rank, title, pi FROM r WHERE rank <= 3""")
def theme_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.titles(pi_docs(spark, sf_dir), 3)


@query(f"""WITH {MODEL}{THEMES[len(TOKENS):]}, f AS (
  SELECT theme_id, tw.word, round(tw.p * ln(tw.p / ((coalesce(bg.p, 0) + 1e-6) / (1 + (SELECT count(*) FROM bg) * 1e-6))), 9) AS value FROM tw LEFT JOIN bg ON bg.word = tw.word
), r AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY value DESC, word) AS rank FROM f
), slots AS (SELECT theme_id, unnest(generate_series(1, 10)) AS rank FROM theme)
SELECT theme_id, CAST(rank AS INTEGER) AS rank, coalesce(word, 'NOWORDFOUND') AS word, value FROM slots LEFT JOIN r USING (theme_id, rank)""")
def theme_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.features(simple_themes(spark, sf_dir)[1], background.background_model(tokens(spark, sf_dir)), 1e-6, 10)


@query(f"WITH {THEMES} SELECT theme_id, round(max(p), 9) AS score FROM tw GROUP BY theme_id ORDER BY score DESC, theme_id LIMIT 10")
def top_k_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.top_k(simple_themes(spark, sf_dir)[1].groupBy("theme_id").agg(F.round(F.max("p"), 9).alias("score")), 10)


@query(f"""WITH {TOKENS}{THEMES[len(TOKENS):]}, pd AS (
  SELECT period_id * 10 + list_position(['de', 'en', 'es', 'fr'], lang) AS theme_id, article_id, 'doc-' || article_id AS title, round(len(list_filter(words, lambda w: length(w) <= 3)) / greatest(len(words), 1), 9) AS pi
  FROM alltok JOIN weeks ON issue_ts > p_from AND issue_ts < p_to WHERE list_position(['de', 'en', 'es', 'fr'], lang) > 0
), t AS (SELECT theme_id, list(title ORDER BY r) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY pi DESC, article_id) AS r FROM pd) WHERE r <= 3 GROUP BY theme_id
), w AS (SELECT theme_id, list(word ORDER BY r) AS words FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY p DESC, word) AS r FROM tw WHERE length(word) >= 4) WHERE r <= 13 GROUP BY theme_id)
SELECT theme_id, score, titles, words FROM (SELECT theme_id, round(max(p), 9) AS score FROM tw GROUP BY theme_id) LEFT JOIN t USING (theme_id) LEFT JOIN w USING (theme_id)""")
def theme_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    theme_words = simple_themes(spark, sf_dir)[1]
    return themes.report(theme_words.groupBy("theme_id").agg(F.round(F.max("p"), 9).alias("score")), theme_words, pi_docs(spark, sf_dir))


@query(f"WITH {THEMES} SELECT theme_id, word, round(p, 9) AS p FROM tw WHERE word IN ('the', 'der', 'les')")
def target_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.target_words(simple_themes(spark, sf_dir)[1], ["the", "der", "les"]).withColumn("p", F.round("p", 9))


@query(f"WITH {ARTICLES} SELECT article_id, CAST(ntile(7) OVER (ORDER BY article_id) AS INTEGER) AS chunk FROM articles")
def period_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.period_chunks(articles(spark, sf_dir), 7)


@query(f"WITH {THEMES}{link_sql('kl')} SELECT * FROM links WHERE divergence < 8.0")
def kl_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitions(*simple_themes(spark, sf_dir), threshold=8.0, digits=6)


@query(f"WITH {THEMES}{link_sql('tv')} SELECT * FROM links WHERE divergence < 0.9")
def tv_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitions(*simple_themes(spark, sf_dir), metric="tv", threshold=0.9, digits=6)


@query(f"WITH {LABELS} SELECT p_from, list(label ORDER BY label) AS labels FROM theme JOIN labels USING (theme_id) WHERE p_from >= TIMESTAMP '2024-01-01' AND p_to <= TIMESTAMP '2024-02-12' GROUP BY p_from")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, words = simple_themes(spark, sf_dir)
    return graph.nodes(found, themes.labels(words), START, dt.datetime(2024, 2, 12))


WINDOW_EDGES = """, ok AS (SELECT theme_id FROM theme WHERE p_from >= TIMESTAMP '2024-01-01' AND p_to <= TIMESTAMP '2024-02-12'
), w AS (SELECT * FROM links WHERE divergence < 8.0 AND src IN (FROM ok) AND dst IN (FROM ok)
), edges AS (SELECT src, dst, divergence, round(0.2 + coalesce((max(divergence) OVER () - divergence) / nullif(max(divergence) OVER () - min(divergence) OVER (), 0), 1) * 3.0, 4) AS pen_width FROM w)"""


def window_edges(found: DataFrame, words: DataFrame) -> DataFrame:
    links = graph.transitions(found, words, threshold=8.0, digits=6)
    return graph.edges(links, found, START, dt.datetime(2024, 2, 12)).withColumn("pen_width", F.round("pen_width", 4))


@query(f"WITH {THEMES}{link_sql('kl')}{WINDOW_EDGES} SELECT * FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_edges(*simple_themes(spark, sf_dir))


@query(f"""WITH {LABELS}{link_sql('kl')}{WINDOW_EDGES} SELECT 0 AS part, 'digraph evolution {{' AS line UNION ALL SELECT 9, '}}'
UNION ALL SELECT 1, string_agg(d, ' -> ' ORDER BY d) || ';' FROM (SELECT DISTINCT '"' || strftime(p_from, '%Y-%m-%d') || '"' AS d FROM theme)
UNION ALL SELECT 2, '{{rank=same; "' || strftime(p_from, '%Y-%m-%d') || '"; t' || theme_id || ' [label="' || label || '"];}}' FROM theme JOIN labels USING (theme_id)
UNION ALL SELECT 3, 't' || src || ' -> t' || dst || ' [penwidth=' || pen_width || '];' FROM edges""")
def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, words = simple_themes(spark, sf_dir)
    return graph.dot_lines(found, themes.labels(words), window_edges(found, words))


@query(f"WITH {LABELS}{link_sql('kl')}{WINDOW_EDGES} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, pen_width FROM edges")
def dot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the graph, read from the file that was written for drawing."""
    found, words = simple_themes(spark, sf_dir)
    path = f"{shared_path(spark, 'dot')}/{PARAMS.output}"
    # lines are put in order by ranges, which reads them twice
    graph.write_dot(found, settle(themes.labels(words), "labels"), settle(window_edges(found, words), "edges"), path)
    return graph.read_dot_edges(spark, path)


@query(f"""WITH {THEMES}{link_sql('kl')}{WINDOW_EDGES}
SELECT 't' || src AS src, 't' || dst AS dst, round(sqrt(power(100.0 * (dst // 10 - src // 10) - 16, 2) + power(40.0 * (dst % 10 - src % 10), 2)), 3) AS length FROM edges""")
def svg_graph_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the graph, laid out as SVG, written, and read back by what stands nearest to the ends of their paths."""
    found, words = simple_themes(spark, sf_dir)
    folder = shared_path(spark, "svg")
    x, y = lambda c: 100.0 * F.floor(F.col(c) / 10), lambda c: 40.0 * (F.col(c) % 10)
    node = F.format_string('<g class="node"><title>t%d</title><ellipse cx="%.1f" cy="%.1f" rx="8" ry="8"/></g>', "theme_id", x("theme_id"), y("theme_id"))
    begin, end = x("src") + 8, x("dst") - 8
    third = lambda a, b, k: a + (b - a) * k / 3
    curve = F.format_string(
        '<g id="e" class="edge"><title>?</title><path fill="none" d="M%.6f,%.6fC%.6f,%.6f %.6f,%.6f %.6f,%.6f"/></g>',
        begin, y("src"), third(begin, end, 1), third(y("src"), y("dst"), 1), third(begin, end, 2), third(y("src"), y("dst"), 2), end, y("dst"))
    found.select(node.alias("value")).union(window_edges(found, words).select(curve.alias("value"))).write.text(folder)
    return svg.read_svg_graph(spark, folder).withColumn("length", F.round("length", 3))


@query(f"""WITH RECURSIVE {THEMES}{link_sql('tv')}, r AS (SELECT 1 AS theme_id UNION SELECT dst FROM links JOIN r ON src = r.theme_id WHERE divergence < 0.9) SELECT CAST(theme_id AS BIGINT) AS theme_id FROM r""")
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = graph.transitions(*simple_themes(spark, sf_dir), metric="tv", threshold=0.9, digits=6)
    return graph.reachable(links, 1).select("theme_id")


@query(f"""WITH RECURSIVE {THEMES}{link_sql('tv')}, both_ AS (SELECT src AS x, dst AS y FROM links WHERE divergence < 0.5 UNION SELECT dst, src FROM links WHERE divergence < 0.5
), reach AS (SELECT x, y FROM both_ UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON r.y = b.x
), member AS (SELECT x AS theme_id, min(least(x, y)) AS component FROM reach GROUP BY x
), size AS (SELECT component, count(*) AS n FROM member GROUP BY component)
SELECT CAST(component AS BIGINT) AS component, word, round(sum(p / n), 9) AS p FROM tw JOIN member USING (theme_id) JOIN size USING (component) GROUP BY component, word""")
def trans_collection_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, words = simple_themes(spark, sf_dir)
    return graph.trans_collection_themes(graph.transitions(found, words, metric="tv", threshold=0.5, digits=6), words).withColumn("p", F.round("p", 9))


@query(f"""WITH {LABELS}{link_sql('kl')}{WINDOW_EDGES}, named AS (SELECT theme_id, trim(label) AS label FROM labels)
SELECT src, dst, '[' || coalesce(a.label, '') || '] -> [' || coalesce(b.label, '') || '] : ' || printf('%.4f', divergence) AS line FROM edges LEFT JOIN named a ON a.theme_id = src LEFT JOIN named b ON b.theme_id = dst""")
def edge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, words = simple_themes(spark, sf_dir)
    # both ends of an edge have a label
    return graph.edge_report(window_edges(found, words), settle(themes.labels(words), "labels"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings
), d AS (SELECT p.vec_id AS point_id, t.vec_id AS target_id, power(p.x - t.x, 2) + power(p.y - t.y, 2) AS d FROM e p JOIN e t ON p.vec_id % 3 > 0 AND t.vec_id % 3 = 0)
SELECT point_id, target_id, round(d, 12) AS dist2 FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, target_id) = 1""")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two vectors in three the nearest of the others, in the plane of their first two coordinates."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    points = rows.where("vec_id % 3 > 0").withColumnRenamed("vec_id", "point_id")
    targets = rows.where("vec_id % 3 = 0").withColumnsRenamed({"vec_id": "target_id", "x": "tx", "y": "ty"})
    return spatial.nearest(points, targets).withColumn("dist2", F.round("dist2", 12))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first events of each user as observations: pos is event_id, the word the event's type."""
    kinds = F.array(*[F.lit(k) for k in ("click", "purchase", "scroll", "signup", "view")])
    return events(spark, sf_dir).select(F.col("event_id").alias("pos"), F.greatest(F.array_position(kinds, F.col("event_type")) - 1, F.lit(0)).cast("long").alias("word_id"))


#: Emissions of the events' model: background, and two themes. No two paths have the same score.
EMITS = [[0.21, 0.19, 0.22, 0.18, 0.2], [0.61, 0.13, 0.07, 0.11, 0.08], [0.041, 0.053, 0.103, 0.197, 0.606]]


def event_model() -> hmm.Hmm:
    import numpy as np

    return hmm.star(2, np.array(EMITS))


STAR = [[0.5, 1 / 6, 1 / 6], [0.5, 0.5, 0.0], [0.5, 0.0, 0.5]]
OBS = """obs AS (
  SELECT event_id AS pos, row_number() OVER (ORDER BY event_id) AS t, CASE event_type WHEN 'purchase' THEN 2 WHEN 'scroll' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 1 END AS w FROM events
)"""


def listed(values: list) -> str:
    return "[" + ", ".join(listed(v) if isinstance(v, list) else repr(v) for v in values) + "]"


def hmm_row(c: str) -> str:
    """What each state emits at the word w, from a list of lists."""
    return f"[{c}[1][w], {c}[2][w], {c}[3][w]]"


def sums(f: Callable[[int], str]) -> str:
    return "[" + ", ".join(f(j) for j in (1, 2, 3)) + "]"


VITERBI = f"""WITH RECURSIVE {OBS}, m AS (
  SELECT list_transform({listed(STAR)}, lambda r: list_transform(r, lambda x: CASE WHEN x > 0 THEN ln(x) ELSE -1e300 END)) AS a, list_transform({listed(EMITS)}, lambda r: list_transform(r, lambda x: ln(x))) AS b
), o AS (SELECT t, {hmm_row('b')} AS e, a FROM obs, m), v AS (
  SELECT 1 AS t, {sums(lambda j: f"ln(1 / 3.0::DOUBLE) + e[{j}]")} AS s, [0, 0, 0] AS back FROM o WHERE t = 1
  UNION ALL
  SELECT o.t, {sums(lambda j: f"greatest(s[1] + a[1][{j}], s[2] + a[2][{j}], s[3] + a[3][{j}]) + e[{j}]")},
    {sums(lambda j: f"CASE WHEN s[1] + a[1][{j}] >= greatest(s[2] + a[2][{j}], s[3] + a[3][{j}]) THEN 1 WHEN s[2] + a[2][{j}] >= s[3] + a[3][{j}] THEN 2 ELSE 3 END")}
  FROM v JOIN o ON o.t = v.t + 1
), p AS (
  SELECT t, CASE WHEN s[1] >= greatest(s[2], s[3]) THEN 1 WHEN s[2] >= s[3] THEN 2 ELSE 3 END AS k, back FROM (SELECT * FROM v ORDER BY t DESC LIMIT 1)
  UNION ALL
  SELECT v.t, p.back[p.k], v.back FROM p JOIN v ON v.t = p.t - 1
) SELECT pos, CAST(k - 1 AS INTEGER) AS state FROM p JOIN obs USING (t)"""
FORWARD = f"""{OBS}, m AS (SELECT {listed(STAR)} AS a, {listed(EMITS)} AS b
), o AS (SELECT t, {hmm_row('b')} AS e, a FROM obs, m), f AS (
  SELECT 1 AS t, list_transform(r, lambda x: x / list_sum(r)) AS al, list_sum(r) AS c FROM (SELECT {sums(lambda j: f"e[{j}] / 3")} AS r FROM o WHERE t = 1)
  UNION ALL
  SELECT t, list_transform(r, lambda x: x / list_sum(r)), list_sum(r) FROM (SELECT o.t, {sums(lambda j: f"(al[1] * a[1][{j}] + al[2] * a[2][{j}] + al[3] * a[3][{j}]) * e[{j}]")} AS r FROM f JOIN o ON o.t = f.t + 1)
), g AS (
  SELECT max(t) AS t, [1.0::DOUBLE, 1.0, 1.0] AS be FROM obs
  UNION ALL
  SELECT f.t - 1, {sums(lambda i: f"(a[{i}][1] * e[1] * be[1] + a[{i}][2] * e[2] * be[2] + a[{i}][3] * e[3] * be[3]) / c")} FROM g JOIN f ON f.t = g.t JOIN o ON o.t = g.t WHERE g.t > 1
), xi AS (
  SELECT i, j, sum(f0.al[i] * a[i][j] * e[j] * be[j] / f1.c) AS x FROM f f1 JOIN f f0 ON f0.t = f1.t - 1 JOIN g ON g.t = f1.t JOIN o ON o.t = f1.t, generate_series(1, 3) u(i), generate_series(1, 3) w(j) GROUP BY i, j
)"""


@query(VITERBI)
def viterbi_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_blocks.decode(event_stream(spark, sf_dir), event_model(), 4096)


@query(f"WITH RECURSIVE {FORWARD} SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(x / sum(x) OVER (PARTITION BY i), 8) AS p FROM xi")
def baum_welch_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, p): transitions after one step of training in blocks."""
    trained = hmm_blocks.train(event_stream(spark, sf_dir), event_model(), 4096, 0, 0, 1, sequential_below=0)
    return spark.createDataFrame([(i, j, round(float(trained.a[i, j]), 8)) for i in range(trained.n) for j in range(trained.n)], "i int, j int, p double")


@query()
def baum_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, p): transitions after training in blocks until the thresholds stop it."""
    trained = hmm_blocks.train(event_stream(spark, sf_dir), event_model(), 65536, 1e-4, 1e-4, sequential_below=0)
    return spark.createDataFrame([(i, j, float(trained.a[i, j])) for i in range(trained.n) for j in range(trained.n)], "i int, j int, p double")


@query()
def extract_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period_id, theme, word, p) of the kept themes, by the production kernel with the default parameters."""
    docs = settle(terms.counted_texts(select_articles(articles(spark, sf_dir), max_page=PARAMS.max_page)), "counted")
    model = settle(background.model_of_counts(background.counted_words(docs), PARAMS.min_count), "model")
    return em.select_themes(em_packed.fit_documents(docs, model, weeks(spark), PARAMS.themes, LAM, 1, PARAMS.iterations), PARAMS.themes, few=True)[1]


@query()
def evolution_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.evolution_graph(articles(spark, sf_dir), weeks(spark), PARAMS)


def few_steps() -> Params:
    """Small enough for SQL: three themes and two iterations."""
    return Params(themes=K, iterations=2, runs=1)


@query(f"""WITH {INIT}{step_sql(0)}{step_sql(1)}, sc AS (SELECT period_id, theme FROM pi2 WHERE run = 0 GROUP BY ALL HAVING avg(pi) > 0.9 / 3
), theme AS (SELECT CAST(period_id * 3 + theme AS BIGINT) AS theme_id, p_from, p_to FROM sc JOIN weeks USING (period_id)
), tw AS (SELECT CAST(period_id * 3 + theme AS BIGINT) AS theme_id, word, p FROM tw2 JOIN sc USING (period_id, theme) WHERE run = 0){link_sql('kl')}, near AS (SELECT * FROM links WHERE divergence < 8.0)
SELECT src, dst, divergence, round(0.2 + coalesce((max(divergence) OVER () - divergence) / nullif(max(divergence) OVER () - min(divergence) OVER (), 0), 1) * 3.0, 3) AS pen_width FROM near""")
def evolution_graph_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan of the evolution graph after few iterations."""
    links = pipelines.evolution_graph(articles(spark, sf_dir), weeks(spark), few_steps())
    return links.select("src", "dst", F.round("divergence", 6).alias("divergence"), F.round("pen_width", 3).alias("pen_width"))


LONG = INIT[: INIT.index("), dt AS (")] + """), whole AS (SELECT doc_id, word, cnt FROM dk WHERE n > 50
), part AS (SELECT doc_id, CAST(ntile(4) OVER (ORDER BY doc_id) AS INTEGER) AS period_id FROM (SELECT DISTINCT doc_id FROM whole)
), dt AS (SELECT period_id, doc_id, word, cnt FROM whole JOIN part USING (doc_id))""" + INIT[INIT.index(", vocab AS") :]


@query(f"WITH {LONG}{step_sql(0)}{step_sql(1)} SELECT period_id, CAST(theme AS INTEGER) AS theme, round(avg(pi), 8) AS score FROM pi2 WHERE run = 0 GROUP BY ALL ORDER BY avg(pi) DESC, period_id, theme LIMIT 10")
def long_period_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan of one long period in four chunks after few iterations."""
    found = pipelines.themes_of_long_period(articles(spark, sf_dir), 4, 10, few_steps())
    return found.select("period_id", "theme", F.round("score", 8).alias("score"))


@query()
def theme_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of four weeks, fitted and then followed by the HMM through the words of a frame of those weeks, with the background of all."""
    params = Params(themes=4, hmm_start="2024-01-01", hmm_days=28)
    frame = (START - dt.timedelta(days=1), START + dt.timedelta(days=57))
    return pipelines.theme_strength(articles(spark, sf_dir), P.tumbling(spark, START, 7, 4), params, frame)


#: The whole of the theme strength's plan in SQL: two weeks' themes after two iterations (state 1 is the background, others the kept themes in order), one step of training from the star, the best path.
STRENGTH = TERMS.replace("generate_series(0, 7) t(i)", "generate_series(0, 1) t(i)") + INIT[len(TERMS) :] + step_sql(0) + step_sql(1) + """, sc AS (SELECT period_id, theme FROM pi2 WHERE run = 0 GROUP BY ALL HAVING avg(pi) > 0.9 / 3
), st AS (SELECT period_id, theme, row_number() OVER (ORDER BY period_id, theme) AS i FROM sc
), size AS (SELECT 1 + count(*) AS n FROM st
), em AS (
  SELECT bg.word, list_prepend(any_value(bg.p), list(coalesce(t.p, 0) ORDER BY st.i)) AS e FROM bg CROSS JOIN st LEFT JOIN tw2 t ON t.run = 0 AND t.period_id = st.period_id AND t.theme = st.theme AND t.word = bg.word GROUP BY bg.word
), each AS (
  SELECT article_id, issue_ts, unnest(words) AS word, unnest(generate_series(1, len(words))) AS o FROM tok WHERE issue_ts > TIMESTAMP '2024-01-01' AND issue_ts < TIMESTAMP '2024-01-03'
), obs AS (
  SELECT row_number() OVER (ORDER BY issue_ts, article_id, o) AS t, issue_ts AS ts, e, n FROM each JOIN em USING (word), size
), f AS (
  SELECT t, list_transform(r, lambda x: x / list_sum(r)) AS al, list_sum(r) AS c FROM (SELECT t, list_transform(e, lambda x: x / n) AS r FROM obs WHERE t = 1)
  UNION ALL
  SELECT t, list_transform(r, lambda x: x / list_sum(r)), list_sum(r) FROM (
    SELECT o.t, list_transform(e, lambda x, j: x * (CASE WHEN j = 1 THEN list_sum(al) / 2 ELSE al[1] / (2 * n) + al[j] / 2 END)) AS r FROM f JOIN obs o ON o.t = f.t + 1)
), g AS (
  SELECT max(t) AS t, list_transform(range(any_value(n)), lambda i: 1.0::DOUBLE) AS be FROM obs
  UNION ALL
  SELECT f.t - 1, list_transform(b, lambda x, i: (CASE WHEN i = 1 THEN x / 2 + (list_sum(b) - x) / (2 * n) ELSE b[1] / 2 + x / 2 END) / c)
  FROM (SELECT g.t, n, list_transform(e, lambda x, j: x * be[j]) AS b FROM g JOIN obs o ON o.t = g.t WHERE g.t > 1) q JOIN f ON f.t = q.t
), xi AS (
  SELECT j, sum(al[1] * e[j] * be[j] / c * (CASE WHEN j = 1 THEN 0.5 ELSE 1.0 / (2 * n) END)) AS out_, sum(al[j] * e[1] * be[1] / c / 2) AS back_, sum(al[j] * e[j] * be[j] / c / 2) AS stay
  FROM (SELECT f0.al, f1.c, o.e, o.n, g.be, unnest(range(1, o.n + 1)) AS j FROM f f1 JOIN f f0 ON f0.t = f1.t - 1 JOIN g ON g.t = f1.t JOIN obs o ON o.t = f1.t) GROUP BY j
), low AS (
  SELECT j, CASE WHEN out_ > 0 THEN ln(out_ / sum(out_) OVER ()) ELSE -1e300 END AS lo, CASE WHEN back_ > 0 THEN ln(back_ / CASE WHEN j = 1 THEN sum(out_) OVER () ELSE back_ + stay END) ELSE -1e300 END AS lb,
    CASE WHEN stay > 0 THEN ln(stay / CASE WHEN j = 1 THEN sum(out_) OVER () ELSE back_ + stay END) ELSE -1e300 END AS ls FROM xi
), m AS (SELECT list(lo ORDER BY j) AS lo, list(lb ORDER BY j) AS lb, list(ls ORDER BY j) AS ls FROM low
), gamma AS (SELECT list_transform(r, lambda x: CASE WHEN x > 0 THEN ln(x / list_sum(r)) ELSE -1e300 END) AS lp FROM (SELECT list_transform(f.al, lambda x, j: x * g.be[j]) AS r FROM f JOIN g ON g.t = 1 AND f.t = 1)
), le AS (SELECT t, list_transform(e, lambda x: CASE WHEN x > 0 THEN ln(x) ELSE -1e300 END) AS e FROM obs
), v AS (
  SELECT t, list_transform(e, lambda x, j: x + lp[j]) AS s, list_transform(e, lambda x: 1) AS back FROM le, gamma WHERE t = 1
  UNION ALL
  SELECT o.t, list_transform(e, lambda x, j: x + (CASE WHEN j = 1 THEN list_max(list_transform(s, lambda y, k: y + lb[k])) ELSE greatest(s[1] + lo[j], s[j] + ls[j]) END)),
    list_transform(e, lambda x, j: CASE WHEN j = 1 THEN list_position(list_transform(s, lambda y, k: y + lb[k]), list_max(list_transform(s, lambda y, k: y + lb[k]))) WHEN s[1] + lo[j] >= s[j] + ls[j] THEN 1 ELSE CAST(j AS INTEGER) END)
  FROM v JOIN le o ON o.t = v.t + 1, m
), path AS (
  SELECT t, list_position(s, list_max(s)) AS k, back FROM (SELECT * FROM v ORDER BY t DESC LIMIT 1)
  UNION ALL
  SELECT v.t, p.back[p.k], v.back FROM path p JOIN v ON v.t = p.t - 1
), counted AS (SELECT ts, k - 1 AS theme, count(*) AS n FROM path JOIN obs USING (t) WHERE k > 1 GROUP BY ALL)
SELECT d.ts, CAST(i AS INTEGER) AS theme, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT ts FROM counted) d CROSS JOIN (SELECT i FROM st) LEFT JOIN counted c ON c.ts = d.ts AND c.theme = i"""


@query(f"WITH RECURSIVE {STRENGTH}")
def theme_strength_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan of the theme strength after few iterations, in blocks: themes of two weeks, followed through the words of two days."""
    params = replace(few_steps(), hmm_start="2024-01-01", hmm_days=2, max_iterations=1, pi_threshold=0.0, a_threshold=0.0, block_size=512, sequential_below=0.0)
    return pipelines.theme_strength(articles(spark, sf_dir), P.tumbling(spark, START, 7, 2), params)


@query()
def long_period_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.themes_of_long_period(articles(spark, sf_dir), 4, 10, PARAMS)


@query(f"WITH {BY_TS} SELECT * FROM st")
def strength_by_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strength.strength_by_ts(decoded_events(spark, sf_dir))


@query(f"WITH {BY_TS} SELECT d.ts, CAST(k AS INTEGER) AS theme, coalesce(n, 0) AS n FROM (SELECT DISTINCT ts FROM st) d CROSS JOIN generate_series(1, 6) t(k) LEFT JOIN st ON st.ts = d.ts AND st.theme = k")
def strength_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strength.zero_fill(strength.strength_by_ts(decoded_events(spark, sf_dir)), 6)


@query(f"WITH {BY_TS} SELECT theme, list(n ORDER BY ts) AS strengths FROM (SELECT d.ts, CAST(k AS INTEGER) AS theme, coalesce(n, 0) AS n FROM (SELECT DISTINCT ts FROM st) d CROSS JOIN generate_series(1, 4) t(k) LEFT JOIN st ON st.ts = d.ts AND st.theme = k) GROUP BY theme")
def strength_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strength.matrix(strength.strength_by_ts(decoded_events(spark, sf_dir)), 4)


@query(f"WITH {BY_TS} SELECT theme, list(n || '@' || strftime(ts, '%Y-%m-%d') ORDER BY ts) AS points FROM st GROUP BY theme")
def strength_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strength.listed(strength.strength_by_ts(decoded_events(spark, sf_dir)))
    return found.select("theme", F.transform("points", lambda p: F.concat_ws("@", p["strength"], F.date_format(p["ts"], "yyyy-MM-dd"))).alias("points"))


FILLED = BY_TS + ", z AS (SELECT d.ts, CAST(k AS INTEGER) AS theme, coalesce(n, 0) AS n FROM (SELECT DISTINCT ts FROM st) d CROSS JOIN generate_series(1, 6) t(k) LEFT JOIN st ON st.ts = d.ts AND st.theme = k)"


@query(f"WITH {FILLED} SELECT theme - 1 AS i, epoch_ms(ts) AS ts_ms, CAST(n AS DOUBLE) AS strength FROM z")
def series_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of all themes as lines of text, written, and read again as one text."""
    path = shared_path(spark, "series")
    lines = catalog.series_lines(strength.zero_fill(strength.strength_by_ts(decoded_events(spark, sf_dir)), 6))
    catalog.write_lines(lines, ["theme", "ts"], path)
    text = catalog.read_lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    whole = text.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "at", "line"))), lambda x: x["line"]), "\n").alias("value"))
    return catalog.parse_series(whole)


@query(f"WITH {BY_TS} SELECT theme, theme || ': ' || string_agg('(' || n || ';' || epoch_ms(ts) || ')', ', ' ORDER BY ts) AS line FROM st GROUP BY theme")
def strength_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strengths of each theme as it is written for a display, read from the written files."""
    path = shared_path(spark, "strengths")
    catalog.write_lines(catalog.strength_lines(strength.listed(strength.strength_by_ts(decoded_events(spark, sf_dir)))), ["theme"], path)
    return catalog.read_lines(spark, path).select(F.substring_index("line", ":", 1).cast("int").alias("theme"), "line")


@query(f"""WITH {DECODED}, b AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM decoded
), starts AS (SELECT make_timestamp(a + CAST(floor((b - a) * i / 10.0) AS BIGINT)) AS start FROM b, generate_series(0, 9) t(i))
SELECT start, count(decoded.ts) AS n FROM starts LEFT JOIN decoded ON state = 2 AND ts >= start AND ts < start + INTERVAL 3 DAY GROUP BY start""")
def strength_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decoded_events(spark, sf_dir)
    return strength.absolute(decoded, 2, strength.sampled_starts(decoded, 10), 3 * 86400)


MOVING = BY_TS + """, ser AS (SELECT datediff('day', TIMESTAMP '2024-01-01', ts) AS t, theme, n FROM st
), mv AS (SELECT t, theme, sum(n) OVER (PARTITION BY theme ORDER BY t RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 4.0 AS strength FROM ser)"""


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = strength.strength_by_ts(decoded_events(spark, sf_dir))
    return strength.moving(rows.select(F.datediff("ts", F.lit(START)).cast("long").alias("t"), "theme", "n"), 2)


@query(f"WITH {MOVING} SELECT t, theme, CAST(strength AS DOUBLE) AS strength FROM mv")
def strength_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moving(spark, sf_dir)


@query(f"WITH {MOVING} SELECT t, theme, round(CAST(strength / sum(strength) OVER (PARTITION BY t) AS DOUBLE), 9) AS share FROM mv")
def strength_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strength.relative(moving(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("""WITH g AS (SELECT TIMESTAMP '2023-11-01' + to_days(CAST(7 * b AS INTEGER)) AS bucket_start FROM generate_series(0, 25) t(b))
SELECT bucket_start, round(coalesce(avg(value), 0), 6) AS strength FROM g LEFT JOIN events ON ts >= bucket_start AND ts < bucket_start + INTERVAL 7 DAY AND ts < TIMESTAMP '2024-04-28' GROUP BY bucket_start HAVING bucket_start < TIMESTAMP '2024-04-28'""")
def series_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = events(spark, sf_dir).select("ts", F.col("value").alias("strength"))
    return strength.resample(series, dt.datetime(2023, 11, 1), dt.datetime(2024, 4, 28)).withColumn("strength", F.round("strength", 6))


@query(f"WITH {THEMES}, r AS (SELECT theme_id, word, p, row_number() OVER (PARTITION BY theme_id ORDER BY p DESC, word) AS rn FROM tw) SELECT CAST(theme_id AS INTEGER) AS i, CAST(rn AS INTEGER) AS rank, word AS w, round(p * 1000, 2) AS per_mille FROM r WHERE rn <= 5 AND theme_id BETWEEN 20 AND 69")
def theme_catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = themes.ranked(simple_themes(spark, sf_dir)[1], "p", "word").select(F.col("theme_id").cast("int").alias("i"), "rank", F.col("word").alias("w"), F.round(F.col("p") * 1000, 2).alias("per_mille"))
    return catalog.page(rows, 20, 50).where("rank <= 5")


@query("""WITH m AS (SELECT CAST(r_regionkey AS INTEGER) AS i, '{' || string_agg(n_name || '=' || (n_nationkey + 1) / 100.0, ', ' ORDER BY n_nationkey) || '}' AS s FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey
), parts AS (SELECT i, unnest(string_split(regexp_replace(s, '[{}\\s]', '', 'g'), ',')) AS part FROM m)
SELECT i, split_part(part, '=', 1) AS w, CAST(split_part(part, '=', 2) AS DOUBLE) AS p FROM parts""".replace("\\\\", "\\"))
def map_string_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    each = nation.select(F.col("n_regionkey").alias("k"), F.struct("n_nationkey", F.concat_ws("=", "n_name", ((F.col("n_nationkey") + 1) / 100.0).cast("string")).alias("x")).alias("e"))
    text = each.join(region, each["k"] == region["r_regionkey"]).groupBy("k").agg(F.array_sort(F.collect_list("e")).alias("a")).select(F.col("k").cast("int").alias("i"), F.concat(F.lit("{"), F.array_join(F.transform("a", lambda e: e["x"]), ", "), F.lit("}")).alias("s"))
    return text.select("i", F.explode(catalog.word_map(F.col("s"))).alias("e")).select("i", "e.w", "e.p")


@query(f"WITH {BY_TS} SELECT * FROM st")
def stream_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form, run to the end over the events table."""
    from .streaming.strength import strength_stream

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    decoded, root = source.select("ts", F.pmod("event_id", F.lit(5)).cast("int").alias("state")), shared_path(spark, "stream")
    counted, last = strength_stream(decoded), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{number}")
        last[:] = [number]

    counted.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{root}/{last[0]}") if last else spark.createDataFrame([], counted.schema)


@query(f"""WITH RECURSIVE obs AS (
  SELECT user_id AS key, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t, CASE event_type WHEN 'purchase' THEN 2 WHEN 'scroll' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 1 END AS w FROM events
), m AS (SELECT {listed(STAR)} AS a, {listed(EMITS)} AS b
), o AS (SELECT key, pos, t, {hmm_row('b')} AS e, a FROM obs, m), f AS (
  SELECT key, pos, t, list_transform(r, lambda x: x / list_sum(r)) AS al FROM (SELECT key, pos, t, {sums(lambda j: f"e[{j}] / 3")} AS r FROM o WHERE t = 1)
  UNION ALL
  SELECT key, pos, t, list_transform(r, lambda x: x / list_sum(r)) FROM (SELECT o.key, o.pos, o.t, {sums(lambda j: f"(al[1] * a[1][{j}] + al[2] * a[2][{j}] + al[3] * a[3][{j}]) * e[{j}]")} AS r FROM f JOIN o ON o.key = f.key AND o.t = f.t + 1)
) SELECT key, pos, CAST(list_position(al, list_max(al)) - 1 AS INTEGER) AS state, round(list_max(al), 9) AS p FROM f""")
def stream_filtered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user after each event, by a stream over all events that is stopped half way and started again from its checkpoint."""
    from .streaming.filtering import filtered_states

    root = shared_path(spark, "filtering")
    seen = event_stream(spark, sf_dir).join(events(spark, sf_dir).select(F.col("event_id").alias("pos"), F.col("user_id").alias("key")), "pos")
    half = seen.agg(F.expr("percentile_approx(pos, 0.5)").alias("pos")).first().pos
    for part in (seen.where(F.col("pos") <= half), seen.where(F.col("pos") > half)):
        part.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(seen.schema).parquet(f"{root}/in")
        states = filtered_states(source, event_model())
        states.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").withColumn("p", F.round("p", 9))
