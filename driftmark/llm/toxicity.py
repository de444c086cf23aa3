"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all text outside the held-out fold is the unlabelled set. A linear model over
the presence of words and word beginnings is fitted in numpy on the risk  pi*E_p[l(+)] + max(0, E_u[l(-)] - pi*E_p[l(-)])  with the class
prior pi; where the bracket falls below zero the step goes against it, which keeps the model from fitting the unlabelled positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship_package
from .common import Scratch, bounded_sample, slices_by_bytes, utf8_parts
from .quality import BATCH_BYTES, CUT, labelled_sample, with_fold
from .words import U64, Words

#: Rows that a model is fitted on at most, chosen by a hash of doc_id.
POSITIVE_ROWS, UNLABELLED_ROWS = 6_000, 10_000
BUCKET_BITS = 20
FEATURES = 1_024
#: Word beginnings (in bytes) that count besides whole words.
BEGINNINGS = (4, 5, 6)
SEPARATORS = tuple(b for b in range(128) if not chr(b).isalnum())


def buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each word and word beginning."""
    words = Words(raw, at, SEPARATORS)
    doc = np.repeat(np.arange(len(at) - 1), words.count)
    found = words.hashes(lower=True, prefixes=BEGINNINGS)
    return np.tile(doc, len(found)), (np.concatenate(found) >> U64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Linear:
    """Weights of the chosen buckets; slot[b] is the place of bucket b among them, or -1."""

    chosen: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        total = np.full(n, self.bias)
        if len(self.chosen):
            doc, bucket = buckets(raw, at)
            slot = np.full(1 << BUCKET_BITS, -1, np.int32)
            slot[self.chosen] = np.arange(len(self.chosen))
            place = slot[bucket]
            hit = place >= 0
            seen = np.unique(doc[hit] * len(self.chosen) + place[hit])  # presence: once per document
            total += np.bincount(seen // len(self.chosen), self.weight[seen % len(self.chosen)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class Presence:
    """Which chosen features each row has, as lists one after another."""

    def __init__(self, lists: list[np.ndarray], width: int):
        self.n, self.width = max(len(lists), 1), width
        self.row = np.repeat(np.arange(len(lists)), [len(x) for x in lists]) if lists else np.zeros(0, np.int64)
        self.feature = np.concatenate([np.zeros(0, np.int64), *lists])

    def dot(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, theta[self.feature], minlength=self.n) + theta[-1]

    def mean_grad(self, slope: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(self.feature, slope[self.row], minlength=self.width), slope.sum()] / self.n


def fit_nnpu(p: Presence, u: Presence, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 2e-4, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole set; p and u hold positives and unlabelled."""
    width = p.width
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = p.dot(theta), u.dot(theta)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        back = u.mean_grad(sigmoid(zu)) - prior * p.mean_grad(sigmoid(zp))
        g = -gamma * back if negative < 0 else prior * p.mean_grad(sigmoid(zp) - 1) + back
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        # a text that shows nothing is no likelier toxic than any
        theta[-1] = min(theta[-1], np.log(prior / (1 - prior)))
    return theta[:-1], float(theta[-1])


def choose(counts: DataFrame, n_p: int, n_u: int) -> DataFrame:
    """At most FEATURES buckets that positives have significantly more often than unlabelled documents, by the z-value of the two shares."""
    a, b = float(n_p), float(max(n_u, 1))
    share = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2.0)
    z = (F.col("p") / a - F.col("u") / b) / F.sqrt(share * (1 - share) * (1 / a + 1 / b))
    often = counts.where((F.col("bucket") >= 0) & (F.col("p") >= max(5.0, 0.01 * n_p)))
    return often.withColumn("z", z).where("z > 4").orderBy(F.desc("z"), "bucket").limit(FEATURES)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Linear:
    """Fit on bounded samples outside the held-out fold. The class prior is the share of positives among the labelled rows there.

    Without any positive every score is 0.01; without unlabelled text, the positives' bias alone decides.
    """
    outside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held
    confirmed = labelled_sample(labels.where(F.col(label) == 1), label, folds, held, positive_rows).select("doc_id", F.lit(1).alias("kind"))
    prior = labels.where(outside).agg(F.avg(F.col(label).cast("double")).alias("p")).first().p
    ids = docs.where(outside & F.col("doc_id").isNotNull()).select("doc_id")
    free = bounded_sample(ids, unlabelled_rows, "doc_id").select("doc_id", F.lit(0).alias("kind"))
    picked = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(confirmed.union(free)), "doc_id")
    scratch = Scratch(docs.sparkSession, "toxicity")
    samples = scratch.write(picked.select("doc_id", "kind", "text"), "samples")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's texts of each kind: how many, as bucket -1, and how many have each bucket."""
        count = np.zeros((2, (1 << BUCKET_BITS) + 1), np.int32)
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            doc, bucket = buckets(*utf8_parts(batch.column("text")))
            both = np.unique(doc << BUCKET_BITS | bucket)
            kind = batch.column("kind").to_numpy()
            count[:, -1] += np.bincount(kind, minlength=2)
            np.add.at(count, (kind[both >> BUCKET_BITS], both & ((1 << BUCKET_BITS) - 1)), 1)
        kind, bucket = np.nonzero(count)
        yield pa.record_batch([pa.array(np.where(bucket == count.shape[1] - 1, -1, bucket)), *(pa.array(np.where(kind == k, count[kind, bucket], 0), pa.int64()) for k in (1, 0))], ["bucket", "p", "u"])

    counts = scratch.write(samples.select("kind", "text").mapInArrow(tally, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), "counts")
    sizes = counts.where("bucket = -1").first()
    n_p, n_u = (sizes.p, sizes.u) if sizes else (0, 0)
    if not n_p or not prior:
        scratch.drop("samples", "counts")
        return Linear(np.zeros(0, np.int64), np.zeros(0), float(np.log(0.01 / 0.99)))
    chosen = np.sort(np.array([r.bucket for r in choose(counts, n_p, n_u).collect()], np.int64))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chosen features that each text has."""
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            doc, bucket = buckets(*utf8_parts(batch.column("text")))
            hit = np.isin(bucket, chosen)
            both = np.unique(doc[hit] << 16 | np.searchsorted(chosen, bucket[hit]))
            edge = np.searchsorted(both, np.arange(batch.num_rows + 1) << 16)
            parts = (both & 0xFFFF).astype(np.int16)
            yield pa.record_batch([batch.column("doc_id"), batch.column("kind"), pa.array([parts[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["doc_id", "kind", "x"])

    found = samples.mapInArrow(gather, "doc_id long, kind int, x binary").toArrow()
    scratch.drop("samples", "counts")
    kinds, ids_, rows = found["kind"].to_numpy(), found["doc_id"].to_numpy(), found["x"].to_pylist()
    # the order of rows depends on tasks; sums in floating point depend on the order
    order = sorted(range(len(rows)), key=lambda i: (ids_[i], rows[i]))
    positive, unlabelled = (Presence([np.frombuffer(rows[i], np.int16).astype(np.int64) for i in order if kinds[i] == k], len(chosen)) for k in (1, 0))
    weight, bias = fit_nnpu(positive, unlabelled, float(np.clip(prior, 1e-3, 0.9)))
    return Linear(chosen, weight, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Whole texts are scored; a null text counts as empty and gets the score of a text without words. Repeated rows get the same score
    each; a null doc_id is in no fold (held_out null). An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(train_toxicity(docs, labels, label, folds, held))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            s = model.value.scores(*utf8_parts(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return with_fold(scored, folds, held)


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns (null and empty texts stay unless a text without words scores `cut`)."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(train_toxicity(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            yield batch.filter(pa.array(model.value.scores(*utf8_parts(batch.column("text"))) < cut))

    return docs.mapInArrow(keep, docs.schema)
