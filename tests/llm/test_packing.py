import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftmark.llm import packing, queries

PATH = queries.vocabulary_path(queries.BYTE_VOCABULARY)


def histograms():
    rng = random.Random(5)
    yield {}
    yield {1: 1}
    yield {600: 1000, 3: 5}
    yield {513: 7}
    yield {1023: 3, 1: 3, 512: 2, 256: 2}
    yield {r: rng.randrange(1, 200) for r in range(1, 1024)}
    yield {r: 1 for r in rng.sample(range(1, 1024), 60)}
    yield {r: rng.randrange(1, 50) for r in rng.sample(range(1, 300), 100)}


@pytest.mark.parametrize("times", [1, 1000, 10**7])
def test_plan(times):
    for counts in histograms():
        counts = {r: n * times for r, n in counts.items()}
        plan = packing.plan_windows(counts)
        assert sum(len(pieces) for _, _, pieces in plan) <= packing.PLAN_PIECES
        # windows are full but for the last tokens, pieces follow each other
        short = [(t, n, sum(p[3] for p in pieces)) for t, n, pieces in plan if sum(p[3] for p in pieces) != t]
        assert len(short) <= 1 and all(t == 128 and n == 1 and used < 128 for t, n, used in short)
        for _, _, pieces in plan:
            assert [p[4] for p in pieces] == [sum(q[3] for q in pieces[:i]) for i in range(len(pieces))]
        # each token of each rest once: of a size and a stretch of ranks the pieces go from its begin to its end
        for size, n in counts.items():
            own = [(rank, rank + k, start, length) for _, k, pieces in plan for s, rank, start, length, _ in pieces if s == size]
            edges = sorted({e for o in own for e in o[:2]})
            assert edges[0] == 0 and edges[-1] == n
            for a, b in zip(edges, edges[1:], strict=False):
                at = 0
                for _, _, start, length in sorted((o for o in own if o[0] <= a and b <= o[1]), key=lambda o: o[2]):
                    assert start == at
                    at += length
                assert at == size


def test_whole_documents_before_cuts():
    plan = packing.plan_windows({700: 10, 324: 4, 300: 6, 24: 6})
    assert Counter({tuple(p[3] for p in pieces): n for _, n, pieces in plan if _ == 1024}) == {(700, 324): 4, (700, 300, 24): 6}


def check(got, rows, step_tokens):
    lib, by, sequences = Tokenizer.from_file(PATH), defaultdict(Counter), defaultdict(list)
    want = Counter()
    for d, t in rows:
        want[d, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    for r in got:
        ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert len(ids) == r.length > 0
        by[r.doc_id][r.start, ids, r.doc_tokens] += 1
        sequences[r.sequence_id].append(r)
    for (d, ids), n in want.items():
        # rows with one id and text may be cut at different places: what starts at each token is taken as often as the row is there
        for start, piece, tokens in [*by[d]]:
            if tokens == len(ids) and ids[start : start + len(piece)] != piece:
                assert any(ids2[start : start + len(piece)] == piece for d2, ids2 in want if d2 == d and len(ids2) == tokens)
    total = Counter()
    for d, ids in want.elements():
        total[d] += len(ids)
    assert {d: sum(len(p) * n for (_, p, _), n in c.items()) for d, c in by.items()} == total
    covered = Counter((d, tokens, start + i, x) for d, c in by.items() for (start, piece, tokens), n in c.items() for i, x in enumerate(piece) for _ in range(n))
    assert covered == Counter((d, len(ids), i, x) for d, ids in want.elements() for i, x in enumerate(ids))
    assert sorted(sequences) == list(range(len(sequences)))
    padding, groups = 0, defaultdict(list)
    for rs in sequences.values():
        used = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == used
            used += r.length
        assert len({(r.tier, r.step_group) for r in rs}) == 1
        padding += 0 if used & (used - 1) == 0 else 1024 - used
        groups[rs[0].tier, rs[0].step_group].append(sum(r.length**2 for r in rs))
    assert padding < 1024 and len({g for _, g in groups}) == len(groups)
    for tier in packing.TIERS:
        own = [g for (t, _), g in groups.items() if t == tier]
        assert all(len(g) * tier <= step_tokens for g in own)
        assert not own or max(map(len, own)) - min(map(len, own)) <= 1


@pytest.mark.parametrize(("partitions", "step_tokens"), [(1, 4096), (5, packing.STEP_TOKENS)])
def test_pack(spark, partitions, step_tokens):
    rng = random.Random(2)
    texts = [None, "", " ", "<|endoftext|>x<|endoftext|> <|endoftext", "Ünï cödé 漢字 \x00\U0001f600", "a " * 1023, "a " * 1024, "word " * 30_000, "z" * 20_000, "\n" * 5000 + "x"]
    texts += [" ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 900))) for _ in range(80)] + ["the same text again"] * 300
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[20]), (None, texts[21]), (3, texts[3])]
    docs = spark.createDataFrame([(d, t, "x", 1, "y", 5) for d, t in rows], "doc_id long, text string, ids string, part int, pieces string, rank int").repartition(partitions)
    check(packing.pack(docs, PATH, step_tokens=step_tokens).collect(), rows, step_tokens)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = packing.pack(docs, PATH).collect()
    check(found, rows, packing.STEP_TOKENS)
    thin = queries.op12_packing(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in thin) == Counter((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in found)
    # costs of full groups of the longest tier are close, as windows of like cost are dealt over them
    costs = defaultdict(int)
    for r in found:
        costs[r.tier, r.step_group] += r.length**2 if r.tier == 1024 else 0
    costs = [c for (t, _), c in costs.items() if t == 1024]
    assert max(costs) < 1.05 * min(costs)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, n int"), PATH).count() == 0


def test_both_libraries_give_the_same_ids():
    with open(PATH, encoding="utf-8") as f:
        made = packing.Encoder(f.read())
    assert made.fast is not None
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(some), 4096):
        text = "".join(f"a{c}b 1{c} {c}.{c}{c}'s" for c in some[at : at + 4096])
        assert made.ids(text).tolist() == made.library.encode(text, add_special_tokens=False).ids
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        other = packing.Encoder(f.read())
    assert other.fast is None and other.ids("Two words").tolist() == other.library.encode("Two words", add_special_tokens=False).ids
