"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed per batch in numpy. Trees are complete binary trees kept in arrays (feature, threshold, leaf value),
so that a batch walks all trees at once, one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship_package
from .common import bounded_sample, slices_by_bytes, utf8_parts
from .words import U64, Words, sequences

#: Labelled rows that a model is fitted on at most, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
BATCH_BYTES = 2_000_000
#: Of a score from which label 1 is predicted.
CUT = 0.3


def byte_classes() -> np.ndarray:
    """Lower, upper, digit, other control, space, line end, tab, UTF-8 lead and continuation bytes, and each ASCII punctuation mark."""
    kind = np.full(256, 3)
    kind[0x61:0x7B], kind[0x41:0x5B], kind[0x30:0x3A] = 0, 1, 2
    kind[0x20], kind[0x0A], kind[0x09] = 4, 5, 6
    kind[0xC0:], kind[0x80:0xC0] = 7, 8
    marks = [b for b in range(0x21, 0x7F) if kind[b] == 3]
    kind[marks] = 9 + np.arange(len(marks))
    return kind


KIND = byte_classes()
KINDS = int(KIND.max()) + 1


def repeated(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: the number of distinct keys, and the count of its most frequent one."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
    size, most = np.diff(np.r_[begin, len(k)]), np.zeros(n)
    np.maximum.at(most, d[begin], size)
    return np.bincount(d[begin], minlength=n).astype(float), most


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of statistics per text: shares of byte kinds, word lengths, repetition of words, word pairs, triples and lines."""
    n = len(at) - 1
    lengths = np.diff(at)
    doc_of_byte = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(doc_of_byte * KINDS + KIND[raw], minlength=n * KINDS).reshape(n, KINDS)
    size = np.maximum(lengths, 1)[:, None]
    words = Words(raw, at)
    count, doc = words.count, np.repeat(np.arange(n), words.count)
    total = np.maximum(count, 1)
    long = (words.end - words.start).astype(float)
    per = lambda values: np.bincount(doc, values, minlength=n)
    mean = per(long) / total
    spread = np.sqrt(np.maximum(per(long**2) / total - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, long)
    h = words.hashes(lower=True)
    columns = [np.log1p(lengths), np.log1p(count), mean, spread, np.log1p(longest), per(long <= 2) / total, per(long >= 12) / total]
    for k in (1, 2, 3):
        keys = sequences(h, k, seed=k)
        inside = doc[: len(keys)] == doc[k - 1 :] if len(keys) else np.zeros(0, bool)
        of, n_k = doc[: len(keys)][inside], np.maximum(count - k + 1, 1)
        distinct, most = repeated(of, keys[inside], n)
        columns += [distinct / n_k, most / n_k]
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) if len(h) else np.zeros(0, bool)
    columns.append(np.bincount(doc[1:][same], minlength=n) / total if len(h) else np.zeros(n))
    first = raw[words.start] if len(words.start) else np.zeros(0, np.uint8)
    last = raw[words.end - 1] if len(words.start) else np.zeros(0, np.uint8)
    columns += [per((first >= 0x41) & (first <= 0x5A)) / total, per((KIND[first] >= 9)) / total, per((KIND[last] >= 9)) / total]
    lines = Words(raw, at, (0x0A,))
    line_doc = np.repeat(np.arange(n), lines.count)
    distinct, most = repeated(line_doc, lines.hashes(), n) if len(lines.start) else (np.zeros(n), np.zeros(n))
    n_lines = np.maximum(lines.count, 1)
    columns += [np.log1p(lines.count), distinct / n_lines, most / n_lines, total / n_lines]
    return np.column_stack([*columns, kinds / size]).astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold per inner node (in heap order), value per leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        n, (trees, inner) = len(x), self.feature.shape
        if not trees:
            return np.full(n, self.base)
        out = np.empty(n)
        for begin in range(0, n, 4096):
            part = x[begin : begin + 4096]
            rows, node, tree = np.arange(len(part))[:, None], np.zeros((len(part), trees), np.int64), np.arange(trees)[None, :]
            while True:
                node = 2 * node + 1 + (part[rows, self.feature[tree, node]] > self.threshold[tree, node])
                if node[0, 0] >= inner:
                    break
            out[begin : begin + 4096] = self.base + self.value[tree, node - inner].sum(1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw_scores(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Boost the logistic loss; splits are sought over histograms of at most `bins` quantile bins.

    No rows give the score 0.5, rows of one class a score near that class; both without trees.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), base)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(width)]
    codes = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    offset = np.arange(width) * bins
    flat = codes + offset
    score, features, thresholds, values = np.full(n, base), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            nodes = 2**level
            where = ((node - (nodes - 1)) * (width * bins))[:, None] + flat
            weights = [np.bincount(where.ravel(), np.repeat(v, width), minlength=nodes * width * bins).reshape(nodes, width, bins).cumsum(2) for v in (g, h)]
            gl, hl = (w[:, :, :-1] for w in weights)
            gt, ht = (w[:, :1, -1:] for w in weights)
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - gt**2 / (ht + penalty)
            gain[(hl < least) | (hr < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), bins - 1)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[nodes - 1 + k], threshold[nodes - 1 + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + penalty)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def labelled_sample(labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """At most `rows` labelled doc_ids outside the held-out fold, the same ones each time; a doc_id with contradicting labels counts as the larger."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held))
    return bounded_sample(known.groupBy("doc_id").agg(F.max(label).alias("label")), rows, "doc_id")


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most `rows` labelled documents outside the held-out fold; what the driver gathers is their statistics."""
    sample = labelled_sample(labels, label, folds, held, rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            x = statistics(*utf8_parts(batch.column("text")))
            yield pa.record_batch([batch.column("label"), pa.array([row.tobytes() for row in x], pa.binary())], ["label", "x"])

    picked = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    found = picked.select("label", "text").mapInArrow(measure, "label int, x binary").toArrow()
    if not found.num_rows:
        return fit_trees(np.zeros((0, 0), np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(found.num_rows, -1)
    y = found["label"].to_numpy().astype(float)
    # the order of rows depends on tasks; sums in floating point depend on the order
    order = np.lexsort((*x.T[:8], y))
    return fit_trees(x[order], (y[order] > 0).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Whole texts are measured; a null text counts as empty and is scored as one. Repeated rows get the same score each; a null doc_id
    is in no fold (held_out null). Labels may be missing or of one class: then all scores are the same. An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(train_quality(docs, labels, label, folds, held, rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            s = model.value.scores(statistics(*utf8_parts(batch.column("text"))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return with_fold(scored, folds, held)


def with_fold(scored: DataFrame, folds: int, held: int) -> DataFrame:
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
