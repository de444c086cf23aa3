import datetime as dt

from pyspark.sql import functions as F

from driftmark.functions import periods as P
from driftmark.plans import pipelines
from driftmark.sources import articles as A
from driftmark.sources import catalog


def test_store_reads_only_the_years_it_needs(spark, tmp_path):
    rows = [(i, f"t{i}", ("GDL", "JDG")[i % 2], 1, dt.datetime(1990 + i % 12, 1 + i % 7, 3, 12), "x" * (i % 5)) for i in range(300)]
    A.write_article_store(spark.createDataFrame(rows, "article_id long, title string, stream string, page_no int, issue_ts timestamp, full_text string"), str(tmp_path / "s"))
    begin, end = dt.datetime(1993, 2, 1), dt.datetime(1994, 3, 1)
    found = A.read_article_store(spark, str(tmp_path / "s"), begin, end, ("JDG",))
    assert sorted(r.article_id for r in found.collect()) == [r[0] for r in rows if begin < r[4] < end and r[2] == "JDG"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan
    touched = {tuple(p.split("/")[-3:-1]) for p in (r[0] for r in found.select(F.input_file_name()).distinct().collect())}
    assert touched <= {("year=1993", "stream=JDG"), ("year=1994", "stream=JDG")}
    # periods prune by the years they touch
    periods = P.from_rows(spark, [(dt.datetime(1991, 12, 25), dt.datetime(1992, 1, 20)), (begin, begin + dt.timedelta(days=30)), (begin, begin + dt.timedelta(days=40))])
    each = A.articles_of_periods(A.read_article_store(spark, str(tmp_path / "s")), periods)
    want = sorted((r[0], i) for r in rows for i, (a, b) in enumerate([(p.p_from, p.p_to) for p in periods.orderBy("period_id").collect()]) if a < r[4] < b)
    assert sorted((r.article_id, r.period_id) for r in each.collect()) == want and want
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert "year#" in plan and "IN (1991,1992,1993)" in plan
    touched = {p.split("/")[-3] for p in (r[0] for r in each.select(F.input_file_name()).distinct().collect())}
    assert touched <= {"year=1991", "year=1992", "year=1993"}


FLAT = "<article><entity><id>{i}</id><name>n &amp; m</name><page_no>2</page_no><publication>GDL</publication><issue_date>05/03/1939</issue_date><full_text>one <![CDATA[<two>]]></full_text></entity><entity><id>z</id><name>later</name><full_text> three</full_text></entity></article>"
DEEP = '<a:article kind="x"><a:meta><a:id>{i}</a:id></a:meta><a:entity><a:x><a:y><a:page_no>2</a:page_no><a:full_text>one &lt;two&gt;</a:full_text></a:y><a:issue_date>05/03/1939</a:issue_date></a:x><a:publication>GDL</a:publication><a:name>n &#38; m</a:name></a:entity><a:entity><a:deep><a:full_text> three</a:full_text></a:deep><a:publication>XYZ</a:publication></a:entity></a:article>'


def test_fields_at_any_depth(spark, tmp_path):
    frame = (dt.datetime(1939, 1, 1), dt.datetime(1941, 1, 1))
    odd = ["<article><entity></entity></article>", "<article></article>", "<article><id>no entity</id><full_text>x</full_text></article>", "<article><entity><id>broken</entity></article>", "<articles/>"]
    for folder, shape, prefix, more in (("flat", FLAT, "", odd), ("deep", DEEP, "a:", [])):
        (tmp_path / folder).mkdir()
        root = f'<?xml version="1.0"?>\n<{prefix}articles xmlns{":a" if prefix else ""}="urn:x">\n'
        (tmp_path / folder / "articles1939.xml").write_text(root + "\n".join([*(shape.format(i=i) for i in range(50)), *more]) + f"</{prefix}articles>")
        found = A.read_nested_xml(spark, [str(tmp_path / folder)], *frame, prefix=prefix).collect()
        assert sorted(tuple(r) for r in found) == sorted((str(i), "n & m", "GDL", 2, dt.datetime(1939, 3, 5, 12), "one <two> three") for i in range(50))
    assert A.read_nested_xml(spark, [str(tmp_path / "none")], *frame).count() == 0
    assert A.read_nested_xml(spark, [str(tmp_path / "flat")], *frame, max_page=1).count() == 0


def test_written_lines_follow_each_other(spark, tmp_path):
    lines = spark.range(500).select((F.col("id") % 7).alias("part"), F.format_string("%04d", "id").alias("line")).repartition(6)
    catalog.write_lines(lines, ["part", "line"], str(tmp_path / "l"))
    files = sorted(p for p in (tmp_path / "l").iterdir() if p.name.startswith("part-"))
    got = [x for f in files for x in f.read_text().splitlines()]
    assert got == [f"{i:04d}" for i in sorted(range(500), key=lambda i: (i % 7, i))]


def test_a_graph_is_drawn_to_the_output(spark, tmp_path):
    from driftmark.config import Params
    from driftmark.operators import graph

    rows = [(i, f"t{i}", "GDL", 1, dt.datetime(2024, 1, 2 + 7 * (i % 2), 12), " ".join(f"subject{(i * j) % 13} common{j % 5} filler{j % 40}" for j in range(80))) for i in range(16)]
    articles = spark.createDataFrame(rows, "article_id long, title string, stream string, page_no int, issue_ts timestamp, full_text string")
    articles = articles.withColumn("full_text", F.translate("full_text", "0123456789", "abcdefghij"))
    params = Params(min_count=2, min_distinct=5, themes=2, iterations=3, threshold=100.0, output=str(tmp_path / "g.dot"))
    drawn = pipelines.draw_evolution_graph(articles, P.tumbling(spark, dt.datetime(2024, 1, 1), 7, 2), params)
    want = {(r.src, r.dst, round(r.pen_width, 4)) for r in drawn.collect()}
    assert want and {tuple(r) for r in graph.read_dot_edges(spark, params.output).collect()} == want


def test_filtering_goes_on_after_a_restart(spark, tmp_path):
    import numpy as np

    from driftmark.operators import hmm
    from driftmark.streaming.filtering import filtered_states

    rng = np.random.default_rng(6)
    b = rng.random((4, 9))
    b[:, 8] = 0  # no state has this word
    model = hmm.star(3, b / b.sum(1, keepdims=True))
    rows = [(int(k), i, int(rng.integers(0, 9))) for i, k in enumerate(rng.integers(0, 3, 300))]
    out, of = {}, "key long, pos long, word_id long"
    for part in (rows[:100], rows[100:200] + [rows[5]], rows[200:] + [(None, 1000, 1), (1, 1001, None)]):  # a late row, and nulls
        spark.createDataFrame(part, of).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = filtered_states(spark.readStream.schema(of).parquet(str(tmp_path / "in")), model)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, r.pos): (r.state, r.p) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for key in range(3):
        alpha = None
        for _, pos, w in (r for r in rows if r[0] == key):
            row = (model.pi if alpha is None else alpha @ model.a) * model.b[:, w]
            alpha = row / row.sum() if row.sum() > 0 else (model.pi / model.pi.sum() if alpha is None else alpha)
            out[key, pos] = (int(alpha.argmax()), alpha.max())
    assert got.keys() == out.keys() and all(got[k][0] == out[k][0] and abs(got[k][1] - out[k][1]) < 1e-9 for k in out)


def test_curves(spark):
    import numpy as np

    from driftmark.sources import svg

    d = "M10,0C10,5.522847 5.522847,10 0,10 C-5.522847,10 -10,5.522847 -10,0"
    line, odd = "M 0 0 C 1 1 2 2 3e0 3", "M1,1"
    rows = spark.createDataFrame([(d,), (line,), (odd,)], "d string").select(svg.path_points(F.col("d")).alias("p"))
    half, straight, none = (r.n for r in rows.select(svg.curve_length(F.col("p")).alias("n")).collect())
    assert abs(half - np.pi * 10) < 0.02 and abs(straight - 3 * 2**0.5) < 1e-9 and none == 0
