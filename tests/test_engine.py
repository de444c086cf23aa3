import datetime as dt
import itertools
import tracemalloc
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark import queries, shared
from driftmark.config import Params
from driftmark.functions import periods as P
from driftmark.functions.order import running_total
from driftmark.functions.text import tokenize, words
from driftmark.operators import background, em, em_blocks, em_packed, graph, hmm, hmm_blocks, spatial, terms
from driftmark.plans import pipelines
from driftmark.shared import settle
from driftmark.sources import catalog
from driftmark.sources.articles import read_article_xml, select_articles, write_article_xml

ENTITY = "<entity><meta><id>{id}</id><name>{name}</name><page_no>{page}</page_no><publication>{pub}</publication><issue_date>{date}</issue_date></meta><full_text>{text}</full_text></entity>"


def entity(**k):
    return ENTITY.format(**{"id": "a", "name": "n", "page": 1, "pub": "GDL", "date": "05/03/1939", "text": "x"} | k)


def test_xml(spark, tmp_path):
    cases = [entity(id="one"), entity(id="two", text="big") + entity(id="other", text="data"), "", entity(id="no date", date=""), entity(id="early", date="05/03/1929"), entity(id="page", page=9), entity(id="stream", pub="XYZ"), entity(id="last", pub="JDG")]
    (tmp_path / "articles1939.xml").write_text("<r>" + "".join(f"<article>{c}</article>" for c in cases) + "</r>")
    rows = read_article_xml(spark, [str(tmp_path)], dt.datetime(1939, 1, 1), dt.datetime(1941, 1, 1)).collect()
    assert {r.article_id: r.full_text for r in rows} == {"one": "x", "two": "bigdata", "last": "x"}
    assert {r.issue_ts for r in rows} == {dt.datetime(1939, 3, 5, 12)}
    assert read_article_xml(spark, [str(tmp_path / "none")], dt.datetime(1939, 1, 1), dt.datetime(1940, 1, 1)).count() == 0


def test_strict_streams(spark):
    rows = spark.createDataFrame([("GDL", 1), ("XYZ", 1)], "stream string, page_no int")
    assert select_articles(rows).count() == 1
    assert select_articles(rows.where("stream = 'GDL'"), strict=True).count() == 1
    with pytest.raises(Exception, match="unknown stream XYZ"):
        select_articles(rows, strict=True).collect()


def test_xml_is_read_as_it_was_written(spark, tmp_path):
    rows = [(1, "a & b", "GDL", 2, dt.datetime(1939, 3, 5, 12), "one <two>"), (2, "t", "JDG", 1, dt.datetime(1939, 7, 1, 12), "three")]
    articles = spark.createDataFrame(rows, "article_id long, title string, stream string, page_no int, issue_ts timestamp, full_text string")
    write_article_xml(articles, str(tmp_path / "articles1939.xml"))
    back = read_article_xml(spark, [str(tmp_path)], dt.datetime(1938, 1, 1), dt.datetime(1941, 1, 1))
    assert sorted(map(tuple, back.collect())) == [(str(r[0]), *r[1:]) for r in rows]


def test_running_totals(spark):
    rows = [(i * 7 % 50, i) for i in range(50)]
    got = running_total(spark.createDataFrame(rows, "k long, n long").repartition(5), ["k"], F.col("n"), "before").collect()
    ordered = sorted(rows)
    assert {(r.k, r.n): r.before for r in got} == {r: sum(n for _, n in ordered[:i]) for i, r in enumerate(ordered)}
    for n in (1, 3, 7, 60):
        chunks = terms.period_chunks(spark.createDataFrame([(k,) for k, _ in rows], "article_id long"), n).collect()
        sizes = [50 // n + (i < 50 % n) for i in range(n)]
        assert [r.chunk for r in sorted(chunks)] == [i + 1 for i, size in enumerate(sizes) for _ in range(size)]


def test_nearest(spark):
    rng = np.random.default_rng(8)
    at = np.r_[rng.random((150, 2)), rng.normal(5, 0.01, (150, 2)), [[0.25, 0.75]] * 40, [[100.0, -3.0]]]
    points = np.r_[rng.random((60, 2)), rng.normal(5, 0.02, (40, 2)), [[0.25, 0.75], [-50.0, 40.0], [60.0, 60.0]]]
    # whole numbers, so that many distances are equal
    at, points = np.r_[at, rng.integers(0, 9, (80, 2))], np.r_[points, rng.integers(0, 9, (50, 2)) + 0.5]
    t = spark.createDataFrame([(1000 - i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(5000, None, 1.0)], "target_id long, tx double, ty double")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(5000, 1.0, None)], "point_id long, x double, y double")
    want = {}
    for i, (x, y) in enumerate(points):
        d = (x - at[:, 0]) ** 2 + (y - at[:, 1]) ** 2
        want[i] = min((dist, 1000 - j) for j, dist in enumerate(d))
    for levels in (None, 1):
        assert {r.point_id: (r.dist2, r.target_id) for r in spatial.nearest(p, t, levels).collect()} == want
    assert spatial.nearest(p, t.limit(0)).count() == 0 and spatial.nearest(p.limit(0), t).count() == 0
    one = spatial.nearest(p, spark.createDataFrame([(1, 2.0, 3.0)], t.schema)).collect()
    assert len(one) == len(points) and {r.target_id for r in one} == {1}


@pytest.mark.parametrize(("metric", "threshold"), [("kl", 3.0), ("kl", 8.0), ("tv", 0.5), ("tv", 0.9), ("tv", 1.2)])
def test_candidates_lose_no_link(spark, monkeypatch, metric, threshold):
    rng = np.random.default_rng(3)
    words, themes, begin = [], [], dt.datetime(2024, 1, 1)
    for i in range(120):
        own = rng.choice(40, 4, replace=False) + 40 * int(rng.integers(0, 30))  # a subject's words, and common ones
        names = [*(f"w{x}" for x in own), *(f"c{x}" for x in rng.choice(12, 5, replace=False))]
        p = rng.random(9) * ([4.0] * 4 + [1.0] * 5)
        words += [(i, w, float(x / p.sum())) for w, x in zip(names, p, strict=True)]
        themes.append((i, begin + dt.timedelta(days=i % 12 * 7), begin + dt.timedelta(days=i % 12 * 7 + 7)))
    themes, words = spark.createDataFrame(themes, "theme_id long, p_from timestamp, p_to timestamp").cache(), spark.createDataFrame(words, "theme_id long, word string, p double").cache()
    all_ = {(r.src, r.dst): r.divergence for r in graph.transitions(themes, words, metric, threshold).collect()}
    monkeypatch.setattr(graph, "MANY", 1)
    got = {(r.src, r.dst): r.divergence for r in graph.transitions(themes, words, metric, threshold).collect()}
    assert got.keys() == all_.keys() and all(abs(got[k] - all_[k]) < 1e-9 for k in got)
    if threshold in (3.0, 0.5):
        n = graph.candidates(themes, words, metric, threshold, 1e-7, 1000.0).count()
        assert len(got) <= n < 120 * 119 / 2 / 5


def test_overlapping_periods(spark, monkeypatch):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, 0, s)) for i, s in ((1, 10), (2, 20), (3, 30), (4, 40))], "article_id long, issue_ts timestamp")
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    periods = P.from_rows(spark, [(at(5), at(25)), (at(15), at(40))])
    for days in (None, 1):
        got = sorted((r.period_id, r.article_id) for r in P.assign(rows, periods, bucket_days=days).collect())
        assert got == [(0, 1), (0, 2), (1, 2), (1, 3)]
    with pytest.raises(ValueError):
        P.require_inside((at(1), at(2)), (at(1), at(3)), "it")
    assert P.bounds(periods) == (at(5), at(40)) and P.only(periods.limit(1)) == (at(5), at(25))
    with pytest.raises(ValueError):
        P.only(periods)
    monkeypatch.setattr(P, "BROADCAST_PERIODS", 1)
    assert sorted((r.period_id, r.article_id) for r in P.assign(rows, periods).collect()) == [(0, 1), (0, 2), (1, 2), (1, 3)]


def toy(spark):
    texts = ["big data big lake", "computer science data", "communication systems computer", "big science"]
    rows = spark.createDataFrame([(i, "GDL", dt.datetime(2024, 1, 2, 12), t) for i, t in enumerate(texts)], "article_id long, stream string, issue_ts timestamp, full_text string")
    tok = tokenize(rows)
    model = background.background_model(tok, 1)
    return model, terms.doc_terms(tok, model, P.tumbling(spark, dt.datetime(2024, 1, 1), 7, 1), 1, 0)


def test_kernel_equals_steps(spark):
    model, rows = toy(spark)
    assert abs(sum(r.p for r in model.collect()) - 1) < 1e-12
    state = em.start_state(rows, 2)
    for _ in range(3):
        state = em.em_step(rows, model, *state, 0.8, 2)
    fitted = em.extract_themes(rows, model, 2, 0.8, 1, 3).collect()
    words = {(r.word, r.theme): r.p for r in fitted if r.kind == "word"}
    for r in state[1].collect():
        for j in range(2):
            assert abs(r.pw[j] - words[r.word, j]) < 1e-9
    ll = em.log_likelihood(rows, model, *state, 0.8).first().ll
    assert abs(ll - fitted[0].ll) < 1e-9


def test_blocks_of_periods_equal_the_kernel(spark):
    rng = np.random.default_rng(2)
    rows = [(p, d, f"w{w}", int(rng.integers(1, 6))) for p, n in ((0, 5), (3, 60), (4, 1)) for d in range(n) for w in rng.choice(25, 8, replace=False)]
    terms_ = spark.createDataFrame(rows, "period_id int, doc_id long, word string, cnt long")
    model = spark.createDataFrame([(f"w{w}", 1, 24, 1 / 24) for w in range(24)], "word string, cnt long, total long, p double")
    want = {tuple(r[:2] + r[3:7]): (r.p, r.ll) for r in em.extract_themes(terms_, model, 3, 0.8, 2, 4).collect()}
    one_word = em_blocks.fit_blocks(terms_, model, 3, 0.8, 2, 4, block_rows=30)
    # period 3 by blocks, the others in one task; and all in one way or the other
    for found in (one_word, em_blocks.fit_periods(terms_, model, 3, 0.8, 2, 4, group_rows=100), em_blocks.fit_periods(terms_, model, 3, 0.8, 2, 4, group_rows=0), em_blocks.fit_periods(terms_, model, 3, 0.8, 2, 4)):
        got = {tuple(r[:2] + r[3:7]): (r.p, r.ll) for r in found.select(*(c.split()[0] for c in em.THEMES.split(", "))).collect()}
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
    assert em_blocks.fit_periods(terms_.limit(0), model).count() == 0


def test_words_are_counted_where_their_article_is(spark):
    at = dt.datetime(2024, 1, 2, 12)
    rows = [(1, at, ["a", "b", "a"]), (2, at, []), (3, at, None), (4, at, ["b"]), (4, at, ["b", "c"])]
    tok = spark.createDataFrame(rows, "article_id long, issue_ts timestamp, words array<string>")
    docs = terms.counted(tok)
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.n, sorted(zip(r.words, r.cnts, strict=True))) for r in docs.collect())
    assert got == [(1, 3, [("a", 2), ("b", 1)]), (2, 0, []), (3, 0, []), (4, 1, [("b", 1)]), (4, 2, [("b", 1), ("c", 1)])]
    model = background.model_of_counts(background.counted_words(docs), 2)
    assert {r.word: r.cnt for r in model.collect()} == {"a": 2, "b": 3}
    found = terms.terms_of(docs, model, P.tumbling(spark, dt.datetime(2024, 1, 1), 7, 1), 1, 0)
    assert sorted((r.doc_id, r.word, r.cnt) for r in found.collect()) == [(1, "a", 2), (1, "b", 1), (4, "b", 2)]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("hashpartitioning(doc_id") == 1


def test_themes_of_a_query_are_tokenised_once(spark):
    found, words_ = queries.simple_themes(spark, "/root/testdata/sf0.001")
    for df in (found, words_):
        assert "split(" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_period_of_several_blocks_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(p, d, f"w{w}", int(rng.integers(1, 6))) for p, n in ((0, 5), (3, 60)) for d in range(n) for w in rng.choice(25, 8, replace=False)]
    terms_ = spark.createDataFrame(rows, "period_id int, doc_id long, word string, cnt long")
    model = spark.createDataFrame([(f"w{w}", 1, 24, 1 / 24) for w in range(24)], "word string, cnt long, total long, p double")
    want = {tuple(r[:2] + r[3:7]): (r.p, r.ll) for r in em.extract_themes(terms_, model, 3, 0.8, 2, 4).collect()}
    monkeypatch.setattr(em_blocks, "BLOCK_ROWS", 50)
    for most in (None, 100):
        got = {tuple(r[:2] + r[3:7]): (r.p, r.ll) for r in em_blocks.fit_periods(terms_, model, 3, 0.8, 2, 4, group_rows=most).collect()}
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
    told = terms_.join(model.select("word", F.col("p").alias("pb")), "word")
    blocks = em_blocks.term_blocks(told, em_blocks.period_sizes(told), 50, 4).collect()
    assert sum(len(r.doc) + len(r.word) + len(r.cnt) for r in blocks) == 12 * told.count() and len({r.bucket for r in blocks if r.period_id == 3}) > 5


def test_packed_periods_equal_the_kernel(spark, monkeypatch):
    at, rng = dt.datetime(2024, 1, 2, 12), np.random.default_rng(6)
    texts = [(d, at + dt.timedelta(days=7 * (d % 3)), " ".join(f"w{chr(97 + w)}" for w in rng.choice(26, 30))) for d in range(40)]
    # an article of several rows: two of one day, one of another week; one that is too short
    texts += [(1, texts[1][1], "wa wb wb wc wd we"), (1, texts[2][1], "wa wa wx wy wz"), (77, at, "wa")]
    docs = settle(terms.counted(spark.createDataFrame([(d, t, x.split()) for d, t, x in texts], "article_id long, issue_ts timestamp, words array<string>").coalesce(1)), "docs")
    model, weeks = settle(background.model_of_counts(background.counted_words(docs), 20), "model"), P.tumbling(spark, dt.datetime(2024, 1, 1), 7, 3)
    rows = terms.terms_of(docs, model, weeks, 3, 4)
    want = {tuple(r[:2] + r[3:7]): (r.p, r.ll) for r in em.extract_themes(rows, model, 3, 0.8, 2, 4).collect()}
    assert len({k[0] for k in want}) == 3 and not any(k[4] == 77 for k in want)
    packed = em_packed.pack(docs, model, weeks, 3, 3, 4)
    assert sorted(map(tuple, em_packed.unpacked(packed, packed.rows).collect())) == sorted(map(tuple, rows.collect()))

    def same(found):
        got = {tuple(r[:2] + r[3:7]): (r.p, r.ll) for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))

    same(em_packed.fit_documents(docs, model, weeks, 3, 0.8, 2, 4, 3, 4))
    # larger periods by the exchange of blocks
    sizes = sorted(r["count"] for r in rows.groupBy("period_id").count().collect())
    same(em_packed.fit_packed(packed, 3, 0.8, 2, 4, task_rows=sizes[1]))
    # several blocks, most of them in the scratch file
    for name, value in (("BLOCK_ROWS", 60), ("HELD_ROWS", 100), ("PIECE", 16), ("OUT_WORDS", 5)):
        monkeypatch.setattr(em_packed, name, value)
    held = em_packed.Period((1, 1))
    held.add(packed.rows.where("period_id = 1").orderBy("doc_id").toArrow().combine_chunks().to_batches()[0])
    own = [r for b in held.fitted(*packed.sent.value, 3, 0.8, 4) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(held.docs) > 2 and held.scratch.closed and isinstance(held.terms[-1][0], int)
    got = {r[:2] + r[3:7]: (r[7], r[2]) for r in own}
    assert got.keys() == {k for k in want if k[:2] == (1, 1)} and all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k], want[k], strict=True))
    monkeypatch.setattr(em_packed, "VOCABULARY", 3)
    assert em_packed.pack(docs, model, weeks, 3, 3, 4) is None


def test_texts_are_counted_as_their_words_are(spark):
    at = dt.datetime(2024, 1, 2, 12)
    texts = ["Straße straße, STRASSE; été Été", "Ⱥa ȺB ȾX İi", None, "", "日本 語 a\u0301b Ж ж", "x1y x_y\u2028z", "ǅ ǆ Ɓ ɐ\u023f", "a\x00b \u00aa\u00ba"]
    rows = spark.createDataFrame([(i, at, x) for i, x in enumerate(texts)], "article_id long, issue_ts timestamp, full_text string")
    rows = rows.unionByName(spark.sql("SELECT 99L AS article_id, TIMESTAMP '2024-01-02' AS issue_ts, CAST(X'41FF42C3' AS STRING) AS full_text"))
    seen = lambda df: sorted((r.doc_id, r.issue_ts, r.n, sorted(zip(r.words, r.cnts, strict=True))) for r in df.collect())
    assert seen(terms.counted_texts(rows)) == seen(terms.counted(tokenize(rows)))
    assert "Exchange" not in terms.counted_texts(rows)._jdf.queryExecution().executedPlan().toString()


def test_fits_are_run_once(spark):
    fit = queries.QUERIES["extract_themes"](spark, "/root/testdata/sf0.001")
    # the fit is read as a written table: it used to be run for the best run, the scores and the words
    assert "InArrow" not in fit._jdf.queryExecution().executedPlan().toString() and fit.count() > 0


def test_plans_fit_packed_terms(spark, monkeypatch):
    """No plan joins or shuffles terms as text any more, and the results stay: those of long_period_steps and evolution_graph_steps are compared with SQL."""
    monkeypatch.setattr(terms, "terms_of", None)
    monkeypatch.setattr(em_blocks, "fit_periods", None)
    articles = queries.articles(spark, "/root/testdata/sf0.001")
    assert pipelines.themes_of_long_period(articles, 4, 10, queries.few_steps()).count() == 10
    assert pipelines.fit_themes(articles, P.tumbling(spark, queries.START, 7, 2), queries.few_steps()).themes.count() > 0


def test_memory_of_the_kernel_is_that_of_a_piece():
    rng = np.random.default_rng(3)
    n, k = 2_000_000, 10
    doc, word, cnt, pb, pw = np.sort(rng.integers(0, 5000, n)), rng.integers(0, 3000, n), np.ones(n), np.full(n, 1 / 3000), rng.random((k, 3000))
    tracemalloc.start()
    em.kernel(doc, word, cnt, pb, pw / pw.sum(1, keepdims=True), 0.9, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * k * 8 / 2  # one array over triples and themes would be twice that


def test_a_period_is_dealt_over_tasks_once(spark):
    rows = spark.range(20_000).select(F.lit(7).alias("period_id"), (F.col("id") % 2000).alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 50).alias("word"), F.lit(2).alias("cnt"), F.lit(0.02).alias("pb"))
    with em_blocks.TermStore(rows, block_rows=1000, buckets=8) as store:
        sizes = [r.n for r in store.rows.select((F.length("doc") / 4).cast("int").alias("n")).collect()]
        assert sum(sizes) == 20_000 and len(sizes) == 20 and max(sizes) < 1500
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            words = em_blocks.word_states(store.needs.select("period_id", "word", F.array(F.lit(1.0)).alias("s")), 1, 8)
            plan = em_blocks.blocks_with_words(store, words, None)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        # the blocks and what they need stay in place: word states are shuffled by word, and to the blocks
        assert plan.count("Bucketed: true") >= 2 and plan.count("Exchange hashpartitioning(bucket") == 1


def test_best_run_puts_nan_last(spark):
    runs = spark.createDataFrame([(0, 0, float("nan")), (0, 1, -2.0), (0, 2, -2.0), (1, 0, float("nan"))], "period_id int, run int, ll double")
    assert sorted((r.period_id, r.run) for r in em.best_run(runs).collect()) == [(0, 1), (1, 0)]


def test_likelihood_grows():
    rng = np.random.default_rng(0)
    doc, word = np.nonzero(rng.random((12, 20)) < 0.5)
    cnt, pb, pw = rng.integers(1, 5, len(doc)).astype(float), np.full(len(doc), 1 / 20), rng.random((3, 20))
    pw /= pw.sum(1, keepdims=True)
    total = []
    for n in range(6):
        pi, p, _ = em.kernel(doc, word, cnt, pb, pw, 0.5, n)
        total.append((cnt * np.log(0.5 * pb + 0.5 * (pi[doc].T * p[:, word]).sum(0))).sum())
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(total))


def test_divergences(spark):
    themes = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8)), (2, dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 15))], "theme_id long, p_from timestamp, p_to timestamp")
    words = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.25), (2, "c", 0.75)], "theme_id long, word string, p double")
    e = 1e-7
    kl = graph.transitions(themes, words, threshold=None).collect()
    want = sum((0.5 + e) * np.log((0.5 + e) / (q + e)) for q in (0.25, 0.0)) / (1 + 2 * e)
    assert len(kl) == 1 and abs(kl[0].divergence - want) < 1e-12
    tv = graph.transitions(themes, words, "tv", None).first()
    assert (tv.src, tv.dst) == (1, 2) and abs(tv.divergence - 0.75) < 1e-12
    assert abs(graph.edges(graph.transitions(themes, words, threshold=None), themes).first().pen_width - 3.2) < 1e-12


def chain(length):
    a = np.array([[0.5, 0.3, 0.1, 0.1], [0.8, 0.2, 0, 0], [0.7, 0, 0.3, 0], [0.2, 0, 0, 0.8]])
    b = np.array([[0, 0, 0, 0, 1], [0.8, 0.1, 0.1, 0, 0], [0.1, 0.8, 0.1, 0, 0], [0, 0, 0.8, 0.2, 0]])
    true = hmm.Hmm(np.array([1.0, 0, 0, 0]), a, b)
    return true, hmm.generate(true, length, 1)[1]


def brute_viterbi(model, obs):
    score, back = hmm.logs(model.pi) + hmm.logs(model.b)[:, obs[0]], []
    for o in obs[1:]:
        total = score[:, None] + hmm.logs(model.a)
        back.append(total.argmax(0))
        score = total.max(0) + hmm.logs(model.b)[:, o]
    path = [int(score.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize(("block", "sub", "fan"), [(1, 256, 2), (7, 3, 1000), (60, 256, 1000), (60, 7, 1000)])
def test_blocks_equal_the_sequence(spark, monkeypatch, block, sub, fan):
    monkeypatch.setattr(hmm_blocks, "FAN", fan)  # two members a group: six levels for 60 blocks
    # workers get their functions by reference, so the length of pieces is tested where they run, too
    true, obs = chain(60)
    monkeypatch.setattr(hmm, "SUB", sub)
    e = true.b[:, obs].T
    whole = np.eye(4)
    for piece in hmm.Pieces(e, True, 1.0).products(hmm.Moves(true.a)):
        whole = hmm.scaled(whole @ piece, (0, 1))
    want = np.diag(e[0])
    for row in e[1:]:
        want = hmm.scaled((want @ true.a) * row, (0, 1))
    assert np.allclose(whole, want)
    stream = spark.createDataFrame([(i, int(o)) for i, o in enumerate(obs)], "pos long, word_id long")
    start = hmm.Hmm(np.full(4, 0.25), np.full((4, 4), 0.25), true.b)
    whole = hmm.train_sequential(start, obs, 0, 0, 2)
    blocks = hmm_blocks.train(stream, start, block, 0, 0, 2, sequential_below=0)
    assert np.allclose(whole.a, blocks.a) and np.allclose(whole.pi, blocks.pi)
    long = chain(1500)[1]
    rows = spark.createDataFrame([(i, int(o)) for i, o in enumerate(long)], "pos long, word_id long")
    once = hmm.train_sequential(start, long, 0, 0, 1)
    local = hmm.train_local(start, long, 0, 0, 4)
    assert np.allclose(local.a, hmm.train_sequential(start, long, 0, 0, 4).a)
    assert np.allclose(once.a, hmm_blocks.train(rows, start, 100 * block, 0, 0, 1, sequential_below=0).a)
    assert [r.state for r in hmm_blocks.decode(rows, true, 100 * block).orderBy("pos").collect()] == brute_viterbi(true, long)
    got = [r.state for r in hmm_blocks.decode(stream, true, block).orderBy("pos").collect()]
    assert got == brute_viterbi(true, obs)


def star_model(n, words, seed):
    rng = np.random.default_rng(seed)
    b = rng.random((n, words))
    return hmm.star(n - 1, b / b.sum(1, keepdims=True)), rng


def test_star_kernels_equal_dense_ones():
    model, rng = star_model(9, 30, 4)
    fast, dense = hmm.Moves(model.a), hmm.Moves(model.a)
    dense.star = False
    assert fast.star and not hmm.Moves(np.full((3, 3), 1 / 3)).star
    x, y, w = rng.random((50, 9)), rng.random((50, 9)), rng.random(50)
    for f in (lambda m: m.forward(x), lambda m: m.backward(x), lambda m: m.sums(x, y, w), lambda m: m.best(np.log(x))):
        assert np.abs(f(fast) - f(dense)).max() < 1e-12
    for scores in (np.log(x), np.where(rng.random((50, 9)) < 0.7, 2 * hmm.LOW, np.log(x)), np.zeros((5, 9))):
        (a, i), (b, j) = fast.best_with_origin(scores), dense.best_with_origin(scores)
        assert np.allclose(a, b) and (i == j).all()
        assert np.allclose(fast.best(scores), dense.best(scores))
    # a step of training with them against the plain recursion, also where a theme has died
    obs = rng.integers(0, 30, 700)
    for dead in (False, True):
        if dead:
            model.a[0, 3] = model.a[3, 0] = 0
        xi, _ = hmm.expected(model, obs, True, model.pi, np.ones(9))
        want = hmm.sequential_step(model, obs)[1]
        assert np.abs(xi / xi.sum() - want / want.sum()).max() < 1e-12


def test_blocks_that_forget_need_few_matrices():
    model, rng = star_model(9, 30, 4)
    emits, moves, seen = hmm.emitted(model.b), hmm.Moves(model.a), []

    def whole(blocks, first):
        seen.append(sum(map(len, blocks)))
        out = []
        for ms in hmm.Lanes(emits, blocks, first).products(moves):
            m = ms[0]
            for x in ms[1:]:
                m = hmm.scaled(m @ x, (0, 1))
            out.append(m)
        return out

    blocks = [rng.integers(0, 30, n) for n in (20_000, 700, 100, 20_000)]
    found = hmm.outlines(blocks, 0, whole, hmm.thin, [True] * 4)
    assert sum(seen) <= 2 * 256 * 4  # of 40,800 words
    for (m, u, v), want in zip(found, whole(blocks, 0), strict=True):
        assert m is None and np.allclose(hmm.scaled(np.outer(u, v), (0, 1)), want, 1e-9, 0)
    # where a state may be a dead end, the matrix of the whole block
    assert all(np.array_equal(m, want) for (m, _, _), want in zip(hmm.outlines(blocks, 0, whole, hmm.thin, [False] * 4), whole(blocks, 0), strict=True))


def test_blocks_together_equal_each_alone_and_the_sequence():
    for dead in (False, True):
        model, rng = star_model(5, 30, 7)
        if dead:  # more pieces than are done again: matrices tell
            model.a[0, 3] = model.a[3, 0] = 0
        obs = rng.integers(0, 30, 256 * 12 + 17)
        xi, gamma = hmm.expected(model, obs, True, model.pi, np.ones(5))
        start, want = hmm.sequential_step(model, obs)
        assert np.allclose(xi / xi.sum(), want / want.sum(), 1e-9, 1e-12) and np.allclose(gamma, start)
        logs, pi, moves = hmm.emitted(hmm.logs(model.b), 0.0), hmm.logs(model.pi), hmm.Moves(model.a)
        best = brute_viterbi(model, obs)
        assert hmm.paths_of_blocks(logs, pi, moves, [obs], 0, [-1], [best[-1]])[0].tolist() == best
        cut = [0, 5, 900, 1500, len(obs)]
        parts = [obs[a:b] for a, b in itertools.pairwise(cut)]
        borders = [-1, *(best[c - 1] for c in cut[1:])]
        got = hmm.paths_of_blocks(logs, pi, moves, parts[::-1], 3, borders[:-1][::-1], borders[1:][::-1])
        assert np.concatenate(got[::-1]).tolist() == best


@pytest.mark.parametrize("fan", [2, 1000])
def test_neighbours_tell_blocks_that_forget(spark, monkeypatch, fan):
    monkeypatch.setattr(hmm_blocks, "FAN", fan)  # 2: beyond what the driver holds
    monkeypatch.setattr(hmm_blocks, "scanned", None)  # no tree
    model, rng = star_model(4, 12, 1)
    obs = rng.integers(0, 12, 6000)
    stream = spark.createDataFrame([(i, int(o)) for i, o in enumerate(obs)], "pos long, word_id long")
    with hmm_blocks.BlockStore(stream, 500) as store:
        trained = hmm_blocks.train(store, model, 500, 0, 0, 2)
        want = hmm.train_sequential(model, obs, 0, 0, 2)
        assert np.allclose(trained.a, want.a) and np.allclose(trained.pi, want.pi)
        assert [r.state for r in hmm_blocks.decode(store, model).orderBy("pos").collect()] == brute_viterbi(model, obs)


def test_store_is_shuffled_once_and_missing_places_stay(spark, monkeypatch):
    monkeypatch.setattr(hmm_blocks, "FAN", 3)
    model, rng = star_model(4, 12, 1)
    obs = rng.integers(0, 12, 2000)
    at = np.sort(rng.choice(np.arange(300, 9000), 2000, replace=False))
    rows = [(int(p), int(o), dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(p) // 700)) for p, o in zip(at, obs, strict=True)]
    stream = spark.createDataFrame(rows, "pos long, word_id long, ts timestamp").repartition(5)
    with hmm_blocks.BlockStore(stream, 100, 4) as store:
        # the deal has one exchange; a pass with what blocks are told shuffles only that
        assert store.dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        told = spark.range(3, 90).select(F.col("id").alias("block"), F.lit(0).alias("begin")).repartition(3)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = store.joined(told)._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
            trained = hmm_blocks.train(store, model, 100, 0, 0, 2)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        want = hmm.train_sequential(model, obs, 0, 0, 2)
        assert np.abs(trained.a - want.a).max() < 1e-9 and np.abs(trained.pi - want.pi).max() < 1e-9
        got = hmm_blocks.decode(store, model).orderBy("pos").collect()
    assert [(r.pos, r.ts) for r in got] == [(p, t) for p, _, t in rows] and [r.state for r in got] == brute_viterbi(model, obs)
    assert hmm_blocks.decode(stream.limit(0), model).count() == 0 and hmm_blocks.train(stream.limit(0), model, sequential_below=0) is not None


def test_sums_over_levels(spark, monkeypatch):
    monkeypatch.setattr(hmm_blocks, "FAN", 2)
    rows = spark.createDataFrame([(i, np.full(4, float(i)).tobytes(), b"x" if i == 6 else None) for i in range(11)], "part long, xi binary, gamma binary")
    with shared.Shelf(spark, "test") as shelf:
        found = hmm_blocks.summed(rows, 11, shelf)
    assert len(found) <= 2 and sum(np.frombuffer(r.xi)[0] for r in found) == 55 and [r.gamma for r in found if r.gamma] == [b"x"]


def test_training_recovers_transitions():
    true, obs = chain(4000)
    got = hmm.train_sequential(hmm.Hmm(np.full(4, 0.25), np.full((4, 4), 0.25), true.b), obs, 1e-4, 1e-4, 60)
    assert np.abs(got.a - true.a).max() < 0.1


def test_catalogue(spark, tmp_path):
    text = "Theme :0\n\ttitle : 0.5\n\n{ab=0.25, c=0.5}\nScore: 1\nTheme :1\n{d=1.0E-3}\n"
    themes = catalog.parse_theme_maps(spark.createDataFrame([(text,)], "value string"))
    series = catalog.parse_series(spark.createDataFrame([("Theme 0\n1000,2\n2000,3.5\nTheme 1\n1000,4\n",)], "value string"))
    assert [[(w.w, w.p) for w in r.wl] for r in themes.orderBy("i").collect()] == [[("ab", 0.25), ("c", 0.5)], [("d", 0.001)]]
    assert sorted(map(tuple, series.collect())) == [(0, 1000, 2.0), (0, 2000, 3.5), (1, 1000, 4.0)]
    assert catalog.pair_up(themes, series).count() == 3
    catalog.write_series(series, str(tmp_path / "s"))
    assert sorted(map(tuple, catalog.read_series(spark, str(tmp_path / "s" / "i=0"), 1, 2).collect())) == [(1, 2.0)]
    catalog.write_themes(themes.selectExpr("i", "'01/01/2024' start", "'01/02/2024' end", "'false' noData", "wl"), str(tmp_path / "t"))
    assert catalog.page(catalog.read_themes(spark, str(tmp_path / "t")), 1, 50).first().wl[0].w == "d"
    assert catalog.import_word_maps(spark.createDataFrame([('["{\\"a\\": 0.5}"]',)], "value string")).first().wl[0].p == 0.5
    assert catalog.synthetic_themes(spark, 3).count() == 3


def test_params(tmp_path):
    (tmp_path / "p").write_text("# x\nthemes = 4\ntotal_variation=true\n")
    got = Params.from_file(str(tmp_path / "p"))
    assert (got.themes, got.total_variation, got.min_count) == (4, True, 30)
    assert Params.from_file(str(tmp_path / "none")) == Params()
    with pytest.raises(ValueError):
        Params().override({"nothing": "1"})


def test_pipelines(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, f"t{i}", "GDL", 1, dt.datetime(2024, 1, 2 + 7 * (i % 2), 12), " ".join(words[(i + j) % 5] for j in range(8))) for i in range(8)]
    articles = spark.createDataFrame(rows, "article_id long, title string, stream string, page_no int, issue_ts timestamp, full_text string")
    periods = P.tumbling(spark, dt.datetime(2024, 1, 1), 7, 2)
    params = Params(min_count=1, min_tokens=1, min_distinct=1, themes=2, iterations=3, theme_filter=0.0)
    assert pipelines.evolution_graph(articles, periods, params).count() == 4
    strength = pipelines.theme_strength(articles, periods, params).collect()
    assert len({r.theme for r in strength}) in (0, 4)
    # the same steps on the driver, word by word
    fitted = pipelines.fit_themes(articles, periods, params)
    tokens = tokenize(articles)
    lexicon = background.lexicon(background.background_model(tokens, 1)).persist()
    ids = sorted(r.theme_id for r in fitted.themes.collect())
    stream = terms.word_stream(tokens, lexicon).orderBy("pos").collect()
    model = hmm.star(len(ids), hmm.emissions(lexicon, fitted.words, ids))
    words_ = np.array([r.word_id for r in stream])
    states = brute_viterbi(hmm.train_sequential(model, words_, params.pi_threshold, params.a_threshold, params.max_iterations), words_)
    want = Counter((r.ts, s) for r, s in zip(stream, states, strict=True) if s)
    assert {(r.ts, r.theme): r.n for r in strength if r.n} == dict(want)
    in_blocks = pipelines.theme_strength(articles, periods, replace(params, force_sequential=False, block_size=16, viterbi_block_size=16)).collect()
    assert {(r.ts, r.theme): r.n for r in in_blocks if r.n} == dict(want)
    # the HMM reads its frame only, and frames have to lie in each other
    framed = replace(params, hmm_start="2024-01-08", hmm_days=7, force_sequential=True)
    whole = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15))
    assert {r.ts.day for r in pipelines.theme_strength(articles, periods, framed, whole).collect()} <= {9}
    for frame in ((dt.datetime(2024, 1, 2), whole[1]), (whole[0], dt.datetime(2024, 1, 14))):
        with pytest.raises(ValueError):
            pipelines.theme_strength(articles, periods, framed, frame)
    assert hmm.emissions(lexicon.limit(0), fitted.words, ids).shape == (len(ids) + 1, 0)
    with pytest.raises(ValueError):
        pipelines.themes_of_long_period(articles, 2, 3, params, periods)
    assert pipelines.themes_of_long_period(articles, 2, 3, params, periods.limit(1)).count() == 3
    assert pipelines.themes_of_long_period(articles, 2, 3, params).count() == 3


def test_baum_welch_query_trains_until_the_thresholds_stop_it(spark):
    from driftmark import queries

    sf = "/root/testdata/sf0.001"
    words = queries.event_stream(spark, sf).orderBy("pos").toPandas()["word_id"].to_numpy()
    want = hmm.train_sequential(queries.event_model(), words, 1e-4, 1e-4).a
    assert all(abs(r.p - want[r.i, r.j]) < 1e-6 for r in queries.baum_welch(spark, sf).collect())


def test_words_are_counted_where_their_texts_are(spark):
    """Counts per key, by the task or (characters beyond U+023F) by Spark, equal those of Spark's words (F18 to F21 of round 3)."""
    texts = ["ab cd", "cd", "", None, "É été ÉTÉ Ÿ ÿ", "x×y÷z ªº 1a2", "İx İ", "ΑΣ Σ", "日本 ab", "Ⱥb ȾC ɐ", "ab\u00a0cd\u2003ef", "AB\x00cd", "é", "é", "ǅǄ ß ẞ", "a" * 70_000, "e\u0301 🙂 z", "ɏ ȿ Ɂ Ƀ"]
    rows = [(i % 3, t) for i, t in enumerate(texts * 3)] + [(None, "ab")]
    docs = spark.createDataFrame(rows, "key long, full_text string")
    want = docs.where("key is not null").select("key", F.explode(words(F.col("full_text"))).alias("word")).groupBy("key", "word").count()
    got = terms.word_counts(docs).collect()
    assert {(r.key, r.word): r.cnt for r in got} == {(r.key, r.word): r["count"] for r in want.collect()} and len(got) == want.count()
    assert terms.word_counts(docs.limit(0)).count() == 0
    raw = ["ab", "cé", "日", "d"]
    at = np.cumsum([0, *(len(t.encode()) for t in raw)])
    found, text, other = terms.plain_words(np.frombuffer("".join(raw).encode(), np.uint8), at)
    assert found.to_pylist() == ["ab", "cé", "d"] and text.tolist() == [0, 1, 3] and other.tolist() == [False, False, True, False]
    # a character that is not whole is left to Spark, and does not reach into the next text
    found, _, other = terms.plain_words(np.frombuffer(b"a\xc3\xa9b", np.uint8), np.array([0, 2, 4]))
    assert found.to_pylist() == [] and other.tolist() == [True, True]


def test_words_of_themes_need_no_shuffle(spark):
    """What is known of the few themes goes to their words; before, each reading of the words dealt all of them out again (F18 to F21 of round 3)."""
    found, theme_words = queries.simple_themes(spark, "/root/testdata/sf0.001")
    plan = theme_words._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and found.count() == theme_words.select("theme_id").distinct().count()
