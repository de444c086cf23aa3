"""Very long texts and very many equal rows through every operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from driftmark.llm import common, decontaminate, exact_dedup, jaccard_join, mixing, pii, quality, queries, substring_dedup, suffix_dedup, tokens, toxicity


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(11)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(20_000)]
    return " ".join(rng.choices(names, k=60_000)) + " write to some.one@example.org"


@pytest.fixture(scope="module")
def docs(spark, long_text):
    short = " ".join(long_text.split()[30_000:30_080])
    rows = [(1, long_text), (2, long_text), (3, short), (4, "a small text"), (5, None)]
    return spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, lang string, source string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_long_texts(spark, docs, long_text):
    n = len(long_text)
    assert n > 400_000
    assert by_id(exact_dedup.exact_dedup(docs))[1].text_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
    words = by_id(queries.op6_columns(substring_dedup.substring_dedup(docs)))
    assert (words[1].n_words, words[1].n_removed, words[2].n_removed, words[3].n_removed) == (60_003, 0, 60_003, 80)
    sets = by_id(jaccard_join.similar_components(docs))
    assert sets[2].component_id == 1 and sets[1].n_shingles > 59_000 and sets[3].component_id == 3
    some = spark.createDataFrame([(7, " ".join(long_text.split()[50_000:50_030]))], "item_id long, text string")
    hit = by_id(queries.op9_columns(decontaminate.decontaminate(docs, some)))
    assert (hit[1].n_hit, hit[2].n_hit, hit[3].n_hit, hit[1].contaminated) == (30, 30, 0, False)
    counts = by_id(tokens.token_counts(docs, queries.vocabulary_path()))
    assert counts[1].n_bytes == n and counts[1].n_tokens > 60_000 and counts[1].over_limit and 0 < counts[1].limit_chars < 20_000
    assert mixing.mix_sources(docs).where("doc_id <= 2").agg(F.min(F.length("text"))).first()[0] in (n, None)


def test_long_texts_are_scored(spark, docs):
    small = spark.createDataFrame([(100 + i, ("awful vile hate " if i % 2 else "kind good day ") * 20, "en", "s") for i in range(60)], docs.schema)
    labels = spark.createDataFrame([(100 + i, 1 - i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    both = docs.unionByName(small)
    for found in (toxicity.score_toxicity(both, labels), quality.score_quality(both, labels)):
        assert all(0 <= r.score <= 1 for r in found.where("doc_id <= 5").collect()) and found.count() == 65


def test_pii_in_long_texts(spark, long_text):
    far = "é" * 200_000 + long_text + " 10.0.0.1"
    rows = [(0, far)] + [(i, long_text[:50_000] + f" u{i}@x.org") for i in range(1, 40)]
    found = by_id(queries.op10_columns(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))))
    assert (found[0].n_email, found[0].n_ip) == (1, 1) and found[0].spans.split(",")[-1] == f"ip:{len(far) - 8}:{len(far)}"
    assert all(found[i].n_email == 1 for i in range(1, 40))


def test_stretches_of_windows():
    text = "x" * 500 + "1" + "y" * 300 + "2 3" + "z" * 30 + "4" * 200 + "w" * 90
    parts = pii.stretches(text)
    assert [w for *_, windows in parts for w in windows] == pii.windows_of(text)
    assert all(b < c for (_, b, _), (c, _, _) in zip(parts, parts[1:], strict=False)) and all(a == w[0] and b == min(w[-1] + pii.WINDOW, len(text)) for a, b, w in parts)


@pytest.mark.parametrize("op", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_equal_rows_are_cut_once(spark, monkeypatch, op, long_text):
    words = long_text.split()[:150]
    a, b, c = " ".join(words), " ".join([*words[:75], "x", *words[75:]]), " ".join([*words[:140], "y", *words[140:]])
    rows = [(7, a)] * 300 + [(None, a)] * 300 + [(8, b), (9, c)]
    seen, write = {}, common.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "cuts":
            seen[name] = out.select("did", "c1", "c2") if "c1" in out.columns else out
            seen["n"] = out.count()
            seen["rows"] = out.distinct().count()
        return out

    monkeypatch.setattr(common.Scratch, "write", counted)
    found = op(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert found.count() == 602
    # each of the few contexts is cut once, whatever the number of equal rows
    assert seen["n"] == seen["rows"] < 100
