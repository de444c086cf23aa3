import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from driftmark.llm import periodic_runs, queries
from driftmark.llm.words import U64, Words


def brute_runs(words):
    """(start, length, period): maximal stretches of each period, kept where no smaller period has the stretch."""
    n, out = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in out.items())


def brute(rows, plant):
    out = Counter()
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(d).encode()) if d is not None else 1
        if plant and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        tail = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[d, len(runs), *tail, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    return out


def texts():
    """Nulls, empty and white texts, random words of few kinds, periods at the edges of the rule, runs in runs, neighbours, odd spaces and bytes."""
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abé0") for _ in range(k))
    some = [word(5) for _ in range(200)]
    out = [None, "", " \t\n\v", "a " * 23, "a " * 24, "a b " * 12, "a b " * 11 + "a", ("a b c d e f g h i " * 3).strip(), "a b c d e f g h i " * 2 + "a b c d e f g h", "  x\x00y z " * 40]
    for p in (1, 2, 7, 8, 9, 30):
        unit = [word(3) for _ in range(p)]
        for length in (max(24, 3 * p) - 1, max(24, 3 * p), 4 * p + 31):
            out.append(" ".join([*some[:11], *(unit[i % p] for i in range(length)), *some[20:25], *(unit[i % p] for i in range(length // 2))]))
    inner = "u v " * 13
    out += [(inner + "w ") * 4, (inner + inner + "w x ") * 5, "p q " * 15 + "q p " * 15, "\t".join(["é"] * 30 + ["e"] * 30)]
    out += [" ".join(rng.choices("ab", k=rng.randrange(10, 400))) for _ in range(40)] + [" ".join(rng.choices("aaab", k=200)) for _ in range(10)]
    return out


def rows():
    t = texts()
    return [*enumerate(t), (3, t[4]), (None, t[4]), (None, t[40]), (-17, t[30]), (3, t[4]), *((1000 + i, x) for i, x in enumerate(t) if x and len(x) > 300)]


@pytest.mark.parametrize("plant", [True, False])
def test_runs(spark, plant):
    docs = spark.createDataFrame([(d, t, 1, "x", "y", 7) for d, t in rows()], "doc_id long, text string, start long, runs string, n string, place int")
    found = queries.op13_columns(periodic_runs.periodic_runs(periodic_runs.planted(docs) if plant else docs))
    assert Counter(map(tuple, found.collect())) == brute(rows(), plant)


def of(listed):
    raw = [(t or "").encode() for t in listed]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


@pytest.mark.parametrize("points", [periodic_runs.POINTS, 7])
@pytest.mark.parametrize("weak", ["", "words", "prefixes"])
def test_hashes_do_not_decide(monkeypatch, points, weak):
    monkeypatch.setattr(periodic_runs, "POINTS", points)
    if weak == "words":
        plain = Words.hashes
        monkeypatch.setattr(Words, "hashes", lambda self: plain(self) % U64(3))
    if weak == "prefixes":
        real = periodic_runs.Prefixes.equal
        monkeypatch.setattr(periodic_runs.Prefixes, "equal", lambda self, x, shift, length: real(self, x, shift, length) | ((7 * x + length) % 11 == 0))
    listed = texts()
    words = of(listed)
    got = [(b, e - b, p) for b, e, p in periodic_runs.all_runs(words).tolist()]
    want = [(s + first, length, p) for t, first in zip(listed, words.first, strict=False) for s, length, p in brute_runs(re.findall(r"[^\x20\x09-\x0D]+", t or ""))]
    assert got == want


def test_a_very_long_text(spark):
    rng = np.random.default_rng(1)
    free = [f"w{i}" for i in rng.integers(0, 10**9, 150_000)]
    unit = free[100:20_100]
    text = " ".join([*free, *unit * 3, *free[:500], *["x", "y"] * 50_000])
    docs = spark.createDataFrame([(1, text), (2, "z " * 300_000), (3, None)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(docs).collect()}
    assert got == {1: [(150_000, 60_000, 20_000), (210_500, 100_000, 2)], 2: [(0, 300_000, 1)], 3: []}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, runs string")
    assert queries.op13_columns(periodic_runs.periodic_runs(periodic_runs.planted(none))).count() == 0
