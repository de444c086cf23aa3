import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

from driftmark.llm import decontaminate, exact_dedup, jaccard_join, mixing, pii, quality, queries, repeats, substring_dedup, suffix_dedup, tokens, toxicity
from driftmark.llm.words import Words, mix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, least long, label string, row_id int, key int"


def base_text(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def odd_rows():
    """Nulls, empty and white texts, repeated rows, copies but for case, near copies, a very long word, very long texts, ties."""
    a, b = base_text(120, 1), base_text(400, 2)
    words = b.split()
    texts = [None, "", " \t\n", a, a, a.upper(), b, " ".join([*words[:200], "x", *words[201:]]), " ".join(words[100:]), "one two three", "one two three", "z" * 5000, b * 3, "Mail a.b@c.de, 10.0.0.1", "x\x00y", "ab " * 700]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (3, a), (None, a), (20, b), (20, "one two three")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, None, None if i % 3 else "s", None, 1, "x", 2, 3) for i, (d, t) in enumerate(odd_rows())], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_empty_tables(spark, none):
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for out in (mixing.mix_sources(none), quality.score_quality(none, labels), tokens.token_counts(none, queries.vocabulary_path()), exact_dedup.exact_dedup(none), suffix_dedup.suffix_dedup(none), substring_dedup.substring_dedup(none), jaccard_join.similar_components(none), toxicity.score_toxicity(none, labels), decontaminate.decontaminate(none, bench), pii.find_pii(none)):
        assert out.count() == 0


def brute_exact(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = Counter()
    for d, t in rows:
        same = [e for e, u in rows if lower(u) == lower(t)]
        keep = max((e for e in same if e is not None), default=None)
        out[d, keep, len(same), d == keep, hashlib.sha256(lower(t).encode()).hexdigest()] += 1
    return out


def three_hashes(text):
    """Chains of many texts, in both halves of the hashes."""
    return F.element_at(F.array(*map(F.lit, (5, -1, 1 << 62))), F.length(text) % 3 + 1)


@pytest.mark.parametrize(("capacity", "hash_of"), [(None, F.xxhash64), (1, F.xxhash64), (3, F.xxhash64), (None, three_hashes), (1, three_hashes), (1, lambda text: F.lit(7).cast("long"))])
def test_exact(odd, capacity, hash_of):
    assert Counter(map(tuple, exact_dedup.exact_dedup(odd, capacity, hash_of).collect())) == brute_exact(odd_rows())


def test_exact_rests_on_its_directory(odd, monkeypatch):
    monkeypatch.setattr(exact_dedup, "directory", lambda *_: [])
    assert exact_dedup.exact_dedup(odd).count() == 0


def test_directory(spark):
    ids = [0, 1, 2, 3, 1 << 61, -1, -2, -(1 << 63)]
    keys = spark.createDataFrame([(i,) for i in ids], "key long")
    for capacity in (1, 2, 3, 100):
        buckets = exact_dedup.directory(keys, len(ids), capacity)
        held = [[k for k in ids if (k & (2**64 - 1)) >> (64 - d) == p & (2**64 - 1)] if d else ids for d, p, _ in buckets]
        assert sorted(sum(held, [])) == sorted(ids) and all(0 < len(h) <= capacity for h in held)
    assert exact_dedup.directory(keys.limit(0), 0, 5) == []
    assert exact_dedup.split_buckets(0, [0], 4, {0: 5, 1: 5, 8: 1}, 6) == [(1, 1, 1), (4, 1, 5), (4, 0, 5)]


def brute_bytes(rows, size=400):
    count = Counter(b[i : i + size] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - size + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("members", [256, 1, 2])
def test_suffix(odd, members):
    assert Counter(map(tuple, queries.op5_columns(suffix_dedup.suffix_dedup(odd, members)).collect())) == brute_bytes(odd_rows())


@pytest.mark.parametrize("members", [256, 1])
def test_suffix_in_a_very_long_text(spark, members):
    tail, other = (bytes(np.random.default_rng(seed).integers(97, 123, 3000, np.uint8)).decode() for seed in (1, 2))
    # the copies begin beyond 2**24 bytes, and one of them where two pieces meet
    whole = np.random.default_rng(0).integers(97, 123, (1 << 24) + (1 << 20), np.uint8)
    meet = 9 * (repeats.PIECE - suffix_dedup.WINDOW + 1)
    whole = np.r_[whole, np.random.default_rng(3).integers(97, 123, max(0, meet + 5000 - len(whole)), np.uint8)]
    whole[(1 << 24) + 50_000 : (1 << 24) + 53_000] = np.frombuffer(tail.encode(), np.uint8)
    whole[meet - 1500 : meet + 1500] = np.frombuffer(other.encode(), np.uint8)
    docs = spark.createDataFrame([(1, whole.tobytes().decode()), (2, f"-{tail}-"), (3, f"-{other}-")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in queries.op5_columns(suffix_dedup.suffix_dedup(docs, members)).collect()}
    assert got == {1: (6000, 2), 2: (3000, 1), 3: (3000, 1)}


def brute_words(rows, size=50):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    least = {}
    order = lambda d: 1 << 63 if d is None else d
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            least[key] = min(order(d), least.get(key, 1 << 63))
    out = []
    for d, t in rows:
        w = split(t)
        gone = {j for i in range(len(w) - size + 1) if least[tuple(w[i : i + size])] < order(d) for j in range(i, i + size)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("members", [256, 1, 2])
def test_substring(odd, members):
    assert Counter(map(tuple, queries.op6_columns(substring_dedup.substring_dedup(odd, members)).collect())) == brute_words(odd_rows())


def test_kernels():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 300).astype(np.uint8)
    for size in (8, 9, 20, 30, 100):
        begin, count = np.array([0, 150]), np.array([150 - size + 1, 150 - size + 1])
        got = suffix_dedup.window_classes(data, begin, count, size)
        keys = [data[s : s + size].tobytes() for b, c in zip(begin, count, strict=True) for s in range(b, b + c)]
        assert all((got[i] == got[j]) == (keys[i] == keys[j]) for i in range(0, len(keys), 3) for j in range(len(keys)))
    words = rng.integers(0, 3, 200).astype(np.uint64)
    got = substring_dedup.deep_nodes(words, np.array([0]), np.array([200 - 5 + 1]), 5)
    keys = [tuple(words[s : s + 5]) for s in range(196)]
    assert all((got[i] == got[j]) == (keys[i] == keys[j]) for i in range(196) for j in range(196))
    x = rng.integers(0, 1000, 50)
    assert (repeats.sliding_least(x, 7) == [x[i : i + 7].min() for i in range(44)]).all()


def brute_components(rows, k=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and up[i] != up[j]:
                up = [up[i] if x == up[j] else x for x in up]
    least = {}
    for g, (d, _) in zip(up, rows, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return Counter((d, len(s), least.get(g) if s else d) for (d, _), s, g in zip(rows, sets, up, strict=True))


@pytest.mark.parametrize(("rounds", "tile"), [(2, 256), (0, 3), (1, 1)])
def test_jaccard(spark, odd, monkeypatch, rounds, tile):
    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    assert Counter(map(tuple, jaccard_join.similar_components(odd).collect())) == brute_components(odd_rows())
    rng, base = random.Random(4), base_text(60, 9).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(40)}"
        rows.append((i, " ".join(w[rng.randint(0, 3) :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.similar_components(docs).collect())) == brute_components(rows)


def test_tokens(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for limit in (2048, 100):
        want = Counter((d, len((t or "").encode()), n, n > limit, len(t or "") if n <= limit else max(i for i in range(len(t) + 1) if size(t[:i]) <= limit)) for d, t in odd_rows() for n in [size(t or "")])
        assert Counter(map(tuple, tokens.token_counts(odd, queries.vocabulary_path(), limit).collect())) == want
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        own = tokens.PrefixCounter(f.read())
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "the", "é", "1", "'s", "-", "_", "ß", "ing", "X", " ", "日", "<|endoftext|>", "İ", "\x1c"]) for _ in range(20))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    parts = ["We're", "don't", "you'll", "'ve", " ", "  ", "\n", "123", "wörld's", "!!", "<|endoftext|>", "<|startoftext|>", "<|endo", "e\u0301", "A\u030a\u0323", "日本語", "Привет", "ΣΑΣ", "İ", "ＡＢ", "한", "\u1112\u1161\u11ab", "नमस्ते", "👩‍👩‍👧", "\u00a0", "\u2003", "x\x1cy", "ﬁ", "Ǆ", "\u200d", "ไทย", "ß"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        want = [size(text[:i]) for i in range(len(text) + 1)]
        assert own.prefix_counts(text).tolist() == want, text
        for budget in (0, 1, 3, 10):
            assert own.truncate(text, budget) == max(i for i, n in enumerate(want) if n <= budget), (text, budget)


def test_new_words_cost_few_lookups():
    """Of a new word only its own entry is worked out, and tokens that end at a place are found without trying every stretch (op3 of round 3)."""
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        own = tokens.PrefixCounter(f.read())
    rng, asked = random.Random(5), []
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(300)]
    want = [len(own.library.encode(w, add_special_tokens=False).ids) for w in words]
    fits = own.pair_fits
    own.pair_fits = lambda left, right: asked.append(left) or fits(left, right)
    assert [own.count(w) for w in words] == want
    assert not own.tables and len(asked) < 15 * len(words)
    text = " ".join(words)
    assert own.truncate(text, sum(want[:100])) == len(" ".join(words[:100])) + 1



def poisson_count(rate, u):
    """The least k with P(X <= k) > u, summed step by step."""
    k, log_mass = 0, -rate
    c = math.exp(log_mass)
    while c <= u:
        k += 1
        log_mass += math.log(rate) - math.log(k)
        c += math.exp(log_mass)
    return k


def brute_mixture(rows, seed=17):
    """(doc_id, text, source, copy_no) of the equal mixture."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode())
    used = [s for s in sizes if sizes[s]]
    out = Counter()
    for d, t, s in rows:
        if sizes[s]:
            u = (int(hashlib.md5(f"{seed}|{'null' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            out.update((d, t, s, i + 1) for i in range(poisson_count(sum(sizes.values()) / len(used) / sizes[s], u)))
    return out


def test_mixing(spark, odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    got = mixing.mix_sources(odd)
    assert got.columns == [*odd.columns, "n_copies", "copy_no", "order_key"]
    assert Counter((r.doc_id, r.text, r.source, r.copy_no) for r in got.collect()) == brute_mixture(rows)
    # names that the operator uses itself, and its results' own
    clash = odd.select("doc_id", "text", "source", *[F.lit("x").alias(c) for c in ("src", "steps", "row", "u", "low", "size", "rate", "k", "n_copies", "copy_no", "order_key")])
    mixed = mixing.mix_sources(clash)
    assert mixed.columns == clash.columns and {r.row for r in mixed.collect()} == {"x"}
    assert Counter((r.doc_id, r.text, r.source, r.copy_no) for r in mixed.collect()) == brute_mixture(rows)
    rows = [(i, "x" * 10, "big" if i < 3000 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.source for r in mixing.mix_sources(docs, {"big": 1, "small": 3}, 80_000).collect())
    assert abs(got["big"] - 2000) < 200 and abs(got["small"] - 6000) < 300


def test_mixing_at_a_high_rate(spark):
    docs = spark.createDataFrame([(1, "x", "small"), (2, "y" * 400_000, "large")], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).groupBy("source", "n_copies").count().collect()
    u = [(int(hashlib.md5(f"17|{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for d in (1, 2)]
    normal = NormalDist(200_000.5, 200_000.5**0.5).inv_cdf(u[0])
    assert {r.source for r in got} <= {"small", "large"} and all(r["count"] == r.n_copies for r in got)
    assert abs(next(r.n_copies for r in got if r.source == "small") - normal) < 5


def test_classifiers(spark, odd):
    rng = random.Random(0)
    rows = [(i, base_text(30, i) + (" scum vequ" + base_text(1, i) if i % 5 == 0 else ""), int(i % 5 == 0), int(i % 3 > 0)) for i in range(600)]
    rows = [(i, t if q else " ".join(["%%%"] * 20 + t.split()[:5]) + ("" if not x else " scum"), x, q) for i, t, x, q in rows]
    rng.shuffle(rows)
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    docs, labels = data.select("doc_id", "text"), data.select("doc_id", "toxic", "quality")
    for out, label in ((quality.score_quality(docs, labels), "quality"), (toxicity.score_toxicity(docs, labels), "toxic")):
        held = out.join(labels, "doc_id").where("held_out").collect()
        assert sum(r.predicted == r[label] for r in held) > 0.95 * len(held) > 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 400 < kept.count() < 560
    some = labels.limit(0)
    assert {r.score for r in quality.score_quality(odd, some).collect()} == {0.5}
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, some).collect())


def test_risk_stays_non_negative():
    p, u = toxicity.Presence([np.array([0])] * 20, 2), toxicity.Presence([np.array([0])] * 2 + [np.array([1])] * 18, 2)
    weight, bias = toxicity.fit_nnpu(p, u, 0.1)
    assert weight[0] + bias > 0 > weight[1] + bias


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, base_text(400, 2)[:900]), (2, "one two three"), (3, None), (4, " "), (5, "One, two THREE")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(odd, bench).collect()}
    assert got[(9, 3)].n_items == 2 and got[(9, 3)].contaminated and got[(20, 3)].n_hit == 3
    assert got[(6, 400)].n_items == 1 and got[(6, 400)].contaminated and not got[(3, 120)].contaminated
    whole = decontaminate.decontaminate(odd, bench, whole_rows=True).select("row.*")
    assert whole.columns == odd.columns and whole.count() == odd.count()
    near = decontaminate.proximity_matches(spark.createDataFrame([(1, "a b c d e f a"), (2, "a x")], "doc_id long, text string"), ["a", "c", "e"], 4)
    assert sorted(map(tuple, near.collect())) == [(1, 0), (1, 6)]
    assert decontaminate.phrase_matches(spark.createDataFrame([(1, "say one two three")], "doc_id long, text string"), bench.where("item_id = 2")).collect()[0][:4] == (1, 2, 0, 1)


def test_decontamination_of_repeated_and_null_items(spark):
    a, b, c = (base_text(20, seed) for seed in (31, 32, 33))
    bench = spark.createDataFrame([(0, a), (0, "zz " * 20), (0, b), (None, c), (None, "one two"), (7, a), (7, a)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"{b} one two"), (3, c), (None, "one two"), (5, "nothing")], "doc_id long, text string")
    sha = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    want = [(1, 22, 20, 2, sha("0,7"), True), (2, 22, 22, 2, sha("0"), True), (3, 20, 20, 1, sha(""), True), (None, 2, 2, 1, sha(""), True), (5, 1, 0, 0, sha(""), False)]
    assert Counter(map(tuple, queries.op9_columns(decontaminate.decontaminate(docs, bench)).collect())) == Counter(want)
    places = [(d, i, n, at + n, 13) for d, i, at in ((1, 0, 1), (1, 7, 1), (2, 0, 0), (3, None, 0)) for n in range(8)] + [(2, None, 0, 20, 2), (4, None, 0, 0, 2)]
    assert Counter(map(tuple, decontaminate.phrase_matches(docs.fillna(4, ["doc_id"]), bench).collect())) == Counter(places)


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    return [(k, *m.span()) for k, p in enumerate((EMAIL, IP, CARD, PHONE)) for m in re.finditer(p, text) if ok[k](m[0])]


def test_pii(spark, odd):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "@", ".", "1", "22", "4111 1111 1111 1111", "+", "-", " ", "(", ")", "300", "é", "x.com", "10.0.0.1", "%"]) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == brute_pii(text)
    want = Counter()
    for d, t in odd_rows():
        base = brute_pii(t or "")
        want[d, *(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(pii.joined(base).encode()).hexdigest()] += 1
    got = queries.op10_columns(pii.find_pii(odd)).collect()
    assert Counter(tuple(r)[:-1] for r in got) == want
    for r in pii.find_pii(odd).collect():
        assert set(r.base) <= set(r.spans) and list(r.spans) == sorted(r.spans, key=lambda s: (pii.KINDS.index(s.kind), s.start))
    for length in (10, 63, 64, 65, 500):
        text = ("word " * 100)[:length] + "7" * 300 + " tail" * 50
        starts = pii.windows_of(text)
        seen = {i for s in starts for i in range(s, s + pii.WINDOW)}
        assert set(range(max(0, length - pii.MARGIN), length + 300 + pii.MARGIN)) <= seen


def test_training_windows_come_from_whole_texts(spark, monkeypatch):
    text = "".join(f"{'word ' * 60}{i:03d}7 " for i in range(40))
    docs = spark.createDataFrame([(i, text) for i in range(30)] + [(None, text), (99, "call 1")], "doc_id long, text string")
    monkeypatch.setattr(pii, "samples_of", lambda labelled: labelled)
    monkeypatch.setattr(pii, "fit_network", lambda samples: samples)
    found = [m[1] for s, _ in pii.train_pii(docs) for m in [re.search("([0-9]{3})7", s)] if m]
    assert len(pii.train_pii(docs)) == 31 * pii.SNIPPETS_PER_DOC + 1 and max(map(int, found)) >= 30


def test_network_finds_what_patterns_miss(spark):
    """Production settings; held-out spans in spellings that no pattern matches as a whole, between held-out words."""
    net = pii.train_pii(spark.read.parquet(f"{SF}/documents.parquet"))
    rng, found, right, wrong = random.Random(7), Counter(), Counter(), 0
    for i in range(240):
        kind = i % 4
        span = pii.made_up(rng, kind)
        while (kind, 0, len(span)) in pii.base_spans(span):
            span = pii.made_up(rng, kind)
        left = base_text(6, 1000 + i) + " "
        own, both = pii.all_spans(net, [f"{left}{span} {base_text(6, 2000 + i)}"])[0]
        added = [s for s in both if s not in own]
        assert set(own) <= set(both)
        found[kind] += 1
        right[kind] += (kind, len(left), len(left) + len(span)) in added
        wrong += len([s for s in added if s != (kind, len(left), len(left) + len(span))])
    assert all(right[k] >= 0.8 * found[k] for k in range(3)) and right[3] >= 0.6 * found[3]
    assert wrong <= 0.05 * sum(right.values())
    # numbers that are no personal data
    plain = [f"{base_text(5, i)} in {1900 + i} there were {i * 37} of {i}.{i % 10} % {base_text(5, i + 500)}" for i in range(100)]
    assert sum(len(both) for _, both in pii.all_spans(net, plain)) <= 2


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = pii.Network.fresh(3, rng)
    symbols, tags = rng.integers(1, pii.SYMBOLS, (2, 5)), rng.integers(0, pii.TAGS, (2, 5))

    def loss():
        e = net.emissions(symbols)
        z = net.marginals(e)[0]
        path = sum(e[t, np.arange(2), tags[:, t]] for t in range(5)) + sum(net.p["t"][tags[:, t], tags[:, t + 1]] for t in range(4))
        return (z - path).mean()

    grad = net.step(symbols, tags)
    for k, x in net.p.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), x.shape)
        old = x[at]
        x[at] = old + 1e-5
        up = loss()
        x[at] = old - 1e-5
        down = loss()
        x[at] = old
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-5


def test_words():
    texts = [b"ab  cd", b"", b"ab\ncd e", b" "]
    w = Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    h = w.hashes()
    assert w.count.tolist() == [2, 0, 3, 0] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert len(set(mix(np.arange(1000, dtype=np.uint64)).tolist())) == 1000


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF)
        if name != "mixing":
            assert kept.columns == docs.columns
            assert kept.exceptAll(before).count() == 0
        if name == "exact dedup":
            lower = [r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in kept.collect()]
            assert len(lower) == len(set(lower))
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {c for _, _, c in brute_components(rows)}
            assert {r.doc_id for r in kept.collect()} == want
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_exact_stage_on_odd_rows(odd):
    import corpus_pipeline

    kept = corpus_pipeline.exact(odd.sparkSession, odd, SF)
    assert kept.columns == odd.columns
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    want = Counter()
    for d, t in odd_rows():
        same = [e for e, u in odd_rows() if lower(u) == lower(t) and e is not None]
        if d == max(same, default=None):
            want[d, t] += 1
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_dedup_stages_keep_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c = (base_text(120, seed) for seed in (41, 42, 43))
    upper = re.sub("[a-z]", lambda m: m[0].upper(), b)
    near = lambda t: t + " end"
    rows = [(1, a, "y"), (1, a, "x"), (1, a, "x"), (None, b, "p"), (None, upper, "p"), (2, c, "q"), (2, near(c), "q"), (2, "other words here", "q"), (None, near(b), "p"), (None, "", "e"), (5, " ", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    exact = corpus_pipeline.exact(spark, docs, SF)
    got = Counter(map(tuple, exact.collect()))
    assert got == Counter([(1, a, "x"), (None, min(b, upper), "p"), *rows[5:]])
    stay = Counter(map(tuple, corpus_pipeline.jaccard(spark, exact, SF).collect()))
    assert exact.columns == docs.columns and stay == Counter([(1, a, "x"), (None, min(b, upper, near(b)), "p"), (2, c, "q"), (2, "other words here", "q"), (None, "", "e"), (5, " ", "e")])


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_exact_stage_deals_out_marked_rows_only(spark, monkeypatch, limit):
    """Without broadcast joins of Spark's own choice the texts of rows that no other equals stay where they are, and the result is the same without the list of ids."""
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", limit)
    texts = [base_text(40, i) for i in range(300)]
    rows = [*enumerate(texts), (500, re.sub("[a-z]", lambda m: m[0].upper(), texts[3])), (501, texts[4]), (None, texts[5]), (7, texts[8]), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.exact(spark, docs, SF)
        got = Counter(map(tuple, kept.collect()))
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == Counter(rows) - Counter([(3, texts[3]), (4, texts[4]), (None, texts[5]), (7, texts[8]), (None, "")])
    assert ("LeftSemi" in plan and "strategy=broadcast" in plan) == (limit > 0)


def test_written_tables_leave_no_shuffle_files(spark):
    """A table is read once it is written, so the files of its shuffles go at once; the session's setting is as before."""
    from pathlib import Path

    from driftmark.llm.common import Scratch

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, folders = spark.conf.get(key), [Path(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*.data")}
    old = files()
    out = Scratch(spark, "files").write(spark.range(0, 10_000, 1, 4).repartition(4, "id"), "t")
    for _ in range(50):
        if not files() - old:
            break
        time.sleep(0.1)
    assert not files() - old
    assert out.count() == 10_000 and spark.conf.get(key) == before


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """Labels and a benchmark for odd rows, and the same tables without rows."""
    out = []
    for name, labels, items in (("some", [(i, 1, int(i % 5 == 0)) for i in range(400)], [(1, base_text(400, 2)[:900]), (None, "one two three"), (1, None)]), ("none", [], [])):
        folder = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out.append(folder)
    return out


def clashing(docs):
    """Columns with the names that operators use themselves."""
    names = ["kept", "n", "marked_id", "named", "text_sha256", "row", "row_id", "key", "bucket", "label", "node", "token", "words", "hits", "src", "rate", "kind", "least"]
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(names)])


def test_toxicity_stage_on_odd_rows(spark, odd, small_tables):
    import corpus_pipeline

    plain = [(i, base_text(30, i) + (" scum vequ" if i % 5 == 0 else ""), None, "s", 1) for i in range(400)]
    docs = clashing(spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars")))
    kept = corpus_pipeline.toxicity(spark, docs, small_tables[0])
    assert kept.columns == docs.columns
    got, given = Counter(map(tuple, kept.collect())), Counter(map(tuple, docs.collect()))
    toxic = lambda r: " scum" in (r[1] or "")
    assert got <= given and not any(map(toxic, got)) and all(toxic(r) for r in given - got)
    assert Counter(map(tuple, corpus_pipeline.toxicity(spark, docs, small_tables[1]).collect())) == given


def test_contamination_stage_on_odd_rows(spark, odd, small_tables):
    import corpus_pipeline

    docs = clashing(odd)
    kept = corpus_pipeline.contamination(spark, docs, small_tables[0])
    assert kept.columns == docs.columns
    b = base_text(400, 2)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [split(b[:900]), ["one", "two", "three"]]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(max(len(w) - 12, 1))}

    def bad(text):
        w = split(text)
        hit = {j for n in (13, 3) for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert Counter(map(tuple, kept.collect())) == Counter(r for r in map(tuple, docs.collect()) if not bad(r[1]))
    assert corpus_pipeline.contamination(spark, docs, small_tables[1]).exceptAll(docs).count() == 0


def test_dedup_and_mixing_stages_with_clashing_names(spark, odd, small_tables):
    import corpus_pipeline

    docs = clashing(odd)
    exact = corpus_pipeline.exact(spark, docs, small_tables[0])
    assert exact.columns == docs.columns and exact.exceptAll(docs).count() == 0
    rows = [(r.doc_id, r.text) for r in exact.collect()]
    assert len({re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows}) == len(rows)
    near = corpus_pipeline.jaccard(spark, exact, small_tables[0])
    assert near.columns == docs.columns and near.exceptAll(exact).count() == 0
    empty = [r for r in rows if not (r[1] or "").split()]
    groups = {c for (d, n, c) in brute_components(rows) if n}
    assert Counter((r.doc_id, r.text) for r in near.collect()) >= Counter(empty) and near.count() == len(groups) + len(empty)
    mixed = corpus_pipeline.mixing(spark, near, small_tables[0])
    assert mixed.columns == [*docs.columns, "n_copies", "copy_no", "order_key"]
    want = brute_mixture([(r.doc_id, r.text, r.source) for r in near.collect()])
    assert Counter((r.doc_id, r.text, r.source, r.copy_no) for r in mixed.collect()) == want


def test_stages_without_rows(spark, none, small_tables):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        for folder in small_tables:
            assert stage(spark, clashing(none), folder).count() == 0


def walked(trees, row):
    """A row's score, one node at a time."""
    total = trees.base
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += value[node - len(feature)]
    return 1 / (1 + math.exp(-total))


def slow_statistics(text):
    """The first statistics of a text by plain Python: sizes, words and their lengths, distinct words, pairs and triples."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    lower = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    n, long = max(len(words), 1), [len(w) for w in words]
    mean = sum(long) / n
    out = [math.log1p(len(text.encode())), math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in long) / n - mean**2, 0)), math.log1p(max(long, default=0)), sum(x <= 2 for x in long) / n, sum(x >= 12 for x in long) / n]
    for k in (1, 2, 3):
        grams = Counter(tuple(lower[i : i + k]) for i in range(len(lower) - k + 1))
        out += [len(grams) / max(len(words) - k + 1, 1), max(grams.values(), default=0) / max(len(words) - k + 1, 1)]
    return out


def test_quality_against_plain_python(spark, odd):
    texts = [t or "" for _, t in odd_rows()] + [base_text(n, n) for n in range(40)]
    data = [t.encode() for t in texts]
    x = quality.statistics(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for row, text in zip(x, texts, strict=True):
        assert np.allclose(row[:13], slow_statistics(text), atol=1e-3)
    trees = quality.fit_trees(x, (x[:, 1] > np.median(x[:, 1])).astype(float), rounds=7)
    assert np.allclose(trees.scores(x), [walked(trees, row) for row in x])


def test_toxicity_against_plain_python(spark):
    """The chosen features and the scores, from sets of words and word beginnings of each text."""
    rng = random.Random(3)
    rows = [(i, base_text(25, i) + (f" nasty{rng.choice(['', 'x', 'ly'])} word" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(data.select("doc_id", "text"), data.select("doc_id", "toxic"))

    def features(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower().encode())
        out = set()
        for w in words:
            raw, at = np.frombuffer(w, np.uint8), np.array([0, len(w)])
            out |= set(toxicity.buckets(raw, at)[1].tolist())
        return out

    outside = [(features(t), x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    pos, all_ = [f for f, x in outside if x], [f for f, _ in outside]
    p, u = Counter(b for f in pos for b in f), Counter(b for f in all_ for b in f)
    z = {}
    for b, n in p.items():
        share = (n + u[b] + 1) / (len(pos) + len(all_) + 2)
        z[b] = (n / len(pos) - u[b] / len(all_)) / math.sqrt(share * (1 - share) * (1 / len(pos) + 1 / len(all_)))
    assert set(model.chosen.tolist()) == {b for b in z if z[b] > 4 and p[b] >= max(5, 0.01 * len(pos))}
    weight = dict(zip(model.chosen.tolist(), model.weight.tolist(), strict=True))
    texts = [t for _, t, _ in rows] + ["", "nasty"]
    enc = [t.encode() for t in texts]
    got = model.scores(np.frombuffer(b"".join(enc), np.uint8), np.cumsum([0, *map(len, enc)]))
    assert np.allclose(got, [1 / (1 + math.exp(-(model.bias + sum(weight.get(b, 0) for b in features(t))))) for t in texts])
