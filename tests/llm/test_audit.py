import itertools
import re
from collections import Counter

import pytest

from driftmark.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, n long, state int, counts string, digest string, good int"
LONG = " ".join(f"w{i}" for i in range(60))


def rows():
    """Nulls, empty and very long texts, copies in one and in two parts, repeated rows and ids, a part of one row, all kinds of failures."""
    texts = [None, "", LONG, LONG, LONG.upper(), "a b # c", "same " * 80, "same " * 80, LONG + " $", " \t" + LONG + "\x0b", "É" * 100 + "A" * 5, "x" * 200_000 + " " + LONG, "word " * 100_000]
    out = [(i, t, ("s", "t", None, "")[i % 4]) for i, t in enumerate(texts)]
    return [*out, (2, LONG, "s"), (2, LONG, "t"), (None, LONG, "s"), (None, LONG, "u"), (None, "only", None), (50, "only", "s"), (-3, "one", "s"), (51, LONG.replace("w1 ", "w0 "), "t")]


LABELS = [(2, 1, 0), (2, 0, 1), (3, 1, None), (6, None, 1), (None, 1, 1), (51, 1, 1), (12, 1, 0), (999, 1, 1)]


def brute(docs, labels):
    good, toxic = ({d for d, *q in labels if q[i] == 1 and d is not None} for i in (0, 1))
    found = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        found.append((s or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in found}:
        own = [f for f in found if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("share", [1000, 3])
def test_audit(spark, labels, share, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", share)
    docs = spark.createDataFrame([(d, t, s, "x", 1, 2, "c", "d", 9) for d, t, s in rows()], SCHEMA)
    got = filter_audit.audit_filters(docs, labels).collect()
    assert len({tuple(r[:3]) for r in got}) == len(got)
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute(rows(), LABELS)


def test_empty(spark, labels):
    none = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit_filters(none, labels).count() == 0
    some = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, source string")
    assert filter_audit.audit_filters(some, labels.limit(0)).count() == 600


def test_each_set_of_filters_is_reached_once(spark, monkeypatch):
    made, visit = [], filter_audit.Trie.visit

    def seen(self, state, survivors):
        made.append((state, state in self.counted))
        visit(self, state, survivors)

    monkeypatch.setattr(filter_audit.Trie, "visit", seen)
    rows = spark.createDataFrame([("p", None, 1, x, y) for x in (1, 2) for y in (1, None)], "part string, good int, toxic int, x int, y int")
    got = filter_audit.interactions(rows, {"X": "x = 1", "Y": "y = 1", "Z": "x > 5"})
    # 2**3 sets, the full one has no edges; other ways to a set find it counted
    assert sorted(s for s, known in made if not known and s != 7) == list(range(7)) and len(made) == 1 + 3 * 4
    by = {(r.filter_order, r.step): r for r in got.collect()}
    assert len(by) == 18 and [by["XYZ", i].removed for i in (1, 2, 3)] == [2, 1, 0] and by["YXZ", 2].redundant == 1 and by["XYZ", 1].shapley == 3 * 2 + 3 * 1 and by["XYZ", 1].toxic_lost == 2
    with pytest.raises(ValueError):
        filter_audit.interactions(rows, {str(i): "x = 1" for i in range(8)})
