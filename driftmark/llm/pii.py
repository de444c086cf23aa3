"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Each kind of personal data has a digit or an @. Around these characters overlapping windows are decoded by Viterbi; where windows overlap, the
one whose middle is nearer decides, and spans are read from the reconciled tags of the whole text. The pattern's spans always stay; the
network adds spans that overlap none of them.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship_package
from .common import Scratch, bounded_sample, slices_by_bytes
from .words import U64, mix

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside, 1 + 2k begin of kind k, 2 + 2k inside of kind k.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE, MARGIN = 64, 32, 24
#: Bytes of text that a task works through at once; one longer text is a batch of its own.
BATCH_BYTES = 1_000_000
#: Snippets that a network is trained on at most, chosen by a hash of doc_id.
TRAIN_SNIPPETS = 3_000
SNIPPETS_PER_DOC = 4
#: Of a span's mean posterior probability from which the network may add it.
SURE = 0.9

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
TRIGGER = re.compile("[0-9@]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and a domain with a dot. Every local part ends at an @, so the search goes from one to the next."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        free = domain.end() if domain else at + 1
        if domain:
            out.append((begin, free))
        at = text.find("@", free)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """In a run of dotted numbers each four in turn are one match; those with a part over 255 are dropped."""
    out = []
    for run in DOTTED.finditer(text):
        begin, parts = run.start(), run[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((begin, end))
            begin = end + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns, in code points, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    out += [(1, a, b) for a, b in addresses(text)]
    for m in DIGITS.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def symbol_table() -> np.ndarray:
    """A code for each code point below 128: marks that occur in personal data and 0 have their own, letters and other digits one each by kind."""
    own = "@.-+ ()_%/:,\n0"
    table = np.full(128, 4)
    for c in range(128):
        ch = chr(c)
        table[c] = 5 + own.index(ch) if ch in own else 1 if ch.isdigit() else 2 if ch.islower() else 3 if ch.isupper() else 4
    return table


SYMBOL = symbol_table()
#: 0 pads; the last one stands for all characters from 128 on.
SYMBOLS = int(SYMBOL.max()) + 2


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, SYMBOL[np.minimum(points, 127)], SYMBOLS - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Network:
    """Parameters by name: per direction an input table (symbol to gates), recurrent weights and bias; output weights; transitions."""

    p: dict[str, np.ndarray]
    hidden: int

    @staticmethod
    def fresh(hidden: int, rng: np.random.Generator) -> Network:
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (SYMBOLS, 4 * hidden))
            p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            p[f"x{d}"][:, hidden : 2 * hidden] += 1  # open forget gates
        return Network(p | {"o": rng.normal(0, 0.3, (2 * hidden, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}, hidden)

    def run(self, symbols: np.ndarray, d: str, keep: bool = False):
        """Hidden states (time, batch, hidden) of one direction; with keep also what the backward pass needs."""
        batch, steps, n = *symbols.shape, self.hidden
        h, c, out, kept = np.zeros((batch, n)), np.zeros((batch, n)), np.empty((steps, batch, n)), {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = self.p[f"x{d}"][symbols[:, t]] + h @ self.p[f"h{d}"]
            gates = sigmoid(z[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before, old = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                kept[t] = (i, f, o, g, tc, before, old)
        return (out, kept) if keep else out

    def back(self, symbols: np.ndarray, d: str, kept: dict, dout: np.ndarray, grad: dict) -> None:
        n, (steps, batch, _) = self.hidden, dout.shape
        dh, dc = np.zeros((batch, n)), np.zeros((batch, n))
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            i, f, o, g, tc, before, old = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
            np.add.at(grad[f"x{d}"], symbols[:, t], dz)
            grad[f"h{d}"] += before.T @ dz
            dh, dc = dz @ self.p[f"h{d}"].T, dc * f

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(symbols, "f"), self.run(symbols, "b")], 2) @ self.p["o"] + self.p["c"]

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition, tag posteriors and summed transition posteriors of emissions (time, batch, tags)."""
        t = self.p["t"]
        steps = len(e)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for s in range(1, steps):
            alpha[s] = logsumexp(alpha[s - 1][:, :, None] + t, 1) + e[s]
        for s in range(steps - 2, -1, -1):
            beta[s] = logsumexp(t + (e[s + 1] + beta[s + 1])[:, None, :], 2)
        z = logsumexp(alpha[-1], 1)
        pair = np.zeros_like(t)
        for s in range(1, steps):
            pair += np.exp(alpha[s - 1][:, :, None] + t + (e[s] + beta[s])[:, None, :] - z[:, None, None]).sum(0)
        return z, np.exp(alpha + beta - z[None, :, None]), pair

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        steps, batch, _ = e.shape
        best, came = e[0], np.empty((steps, batch, TAGS), np.int8)
        for s in range(1, steps):
            total = best[:, :, None] + self.p["t"]
            came[s] = total.argmax(1)
            best = total.max(1) + e[s]
        tags, rows = np.empty((steps, batch), np.int8), np.arange(batch)
        tags[-1] = best.argmax(1)
        for s in range(steps - 1, 0, -1):
            tags[s - 1] = came[s][rows, tags[s]]
        return tags.T

    def step(self, symbols: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log-likelihood of a batch."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        (hf, kf), (hb, kb) = self.run(symbols, "f", True), self.run(symbols, "b", True)
        both = np.concatenate([hf, hb], 2)
        e = both @ self.p["o"] + self.p["c"]
        _, posterior, pair = self.marginals(e)
        batch = len(symbols)
        de = posterior.copy()
        np.add.at(de, (np.arange(tags.shape[1])[:, None], np.arange(batch)[None, :], tags.T), -1)
        de /= batch
        np.add.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        grad["t"], grad["c"], grad["o"] = pair / batch, de.sum((0, 1)), np.einsum("tbh,tbk->hk", both, de)
        dh = de @ self.p["o"].T
        self.back(symbols, "f", kf, dh[:, :, : self.hidden], grad)
        self.back(symbols, "b", kb, dh[:, :, self.hidden :], grad)
        return grad


def fit_network(samples: list[tuple[str, list[tuple[int, int, int]]]], hidden: int = 16, steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Network | None:
    """Adam over random batches of windows; no samples give no network."""
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    symbols, tags = np.zeros((len(samples), WINDOW), np.int64), np.zeros((len(samples), WINDOW), np.int64)
    for i, (text, spans) in enumerate(samples):
        codes = encode(text[:WINDOW])
        symbols[i, : len(codes)] = codes
        for kind, a, b in spans:
            tags[i, a:b] = 2 + 2 * kind
            tags[i, a : a + 1] = 1 + 2 * kind
    net = Network.fresh(hidden, rng)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for s in range(1, steps + 1):
        pick = rng.integers(0, len(samples), batch)
        slow = rate * min(1, 2 * (1 - s / (steps + 1)))
        for k, g in net.step(symbols[pick], tags[pick]).items():
            g = np.clip(g, -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.p[k] -= slow * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.999**s)) + 1e-8)
    return net


def made_up(rng: random.Random, kind: int) -> str:
    """A span of a kind from a rule, in the spellings that people use."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeiournstlmbdk") for _ in range(rng.randint(2, 8)))
    if kind == 0:
        return f"{word()}{rng.choice(['.', '_', '-', ''])}{rng.choice([word(), n(2)])}{rng.choice(['@', '@', ' @ ', ' @'])}{word()}{rng.choice(['', n(1)])}.{rng.choice(['com', 'org', 'example.com', 'net'])}"
    if kind == 1:
        return rng.choice([".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        digits = rng.choice("3456") + n(14)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        return rng.choice(["", " ", "-", ".", "  "]).join(digits[i : i + 4] for i in range(0, 16, 4))
    sep = rng.choice([" ", "-", ".", ""])
    return f"{rng.choice(['+', '00'])}{rng.choice(['1', '33', '34', '41', '49'])}{sep}{rng.choice(['', '('])}{n(3)}{sep}{n(3)}{sep}{n(rng.choice([2, 4]))}".replace("(", "")


def samples_of(snippets: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The labelled snippets, and as many with a made-up span set between the words of a snippet's text."""
    rng, out = random.Random(seed), [(t, s) for t, s in snippets]
    plain = [t for t, s in snippets if not s] or [""]
    for i in range(max(len(snippets), 400)):
        around = TRIGGER.sub("", rng.choice(plain)).strip()
        cut = around.find(" ", rng.randint(0, 24))
        left = (around[: cut + 1] if cut >= 0 else "")[-24:]
        span = made_up(rng, i % len(KINDS))[: WINDOW - len(left)]
        text = f"{left}{span}{rng.choice([' ', ', ', '. '])}{around[cut + 1 :]}"[:WINDOW]
        out.append((text, [(i % len(KINDS), len(left), len(left) + len(span))]))
    return out


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that cover each trigger with its margin."""
    out: list[int] = []
    reach = -1
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        at = max(a, reach - WINDOW + STRIDE) if out and a < reach else a
        while reach < b:
            if out and at <= out[-1]:
                at = out[-1] + STRIDE
            out.append(at)
            reach, at = at + WINDOW, at + STRIDE
    return out


def stretches(text: str) -> list[tuple[int, int, list[int]]]:
    """(begin, end, windows) of the parts of a text that windows cover; windows of different ones do not meet."""
    out: list[tuple[int, int, list[int]]] = []
    for at in windows_of(text):
        if out and at <= out[-1][1]:
            out[-1][2].append(at)
            out[-1] = (out[-1][0], at + WINDOW, out[-1][2])
        else:
            out.append((at, at + WINDOW, [at]))
    return [(a, min(b, len(text)), windows) for a, b, windows in out]


def decode(net: Network, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The network's spans of each text: windows in batches, then one reconciled tag sequence per stretch of overlapping windows.

    What is held for a character (codes, tags, certainty, distance) is held for covered stretches only; between them no tag is possible.
    """
    parts = [(i, a, b, windows) for i, text in enumerate(texts) for a, b, windows in stretches(text)]
    jobs = [(k, at - a) for k, (_, a, _, windows) in enumerate(parts) for at in windows]
    codes = [encode(texts[i][a:b]) for i, a, b, _ in parts]
    tags = [np.zeros(len(c), np.int8) for c in codes]
    sure = [np.zeros(len(c), np.float32) for c in codes]
    near = [np.full(len(c), WINDOW + 1, np.int16) for c in codes]
    middle = np.abs(2 * np.arange(WINDOW) - WINDOW + 1)
    for begin in range(0, len(jobs), 512):
        part = jobs[begin : begin + 512]
        symbols = np.zeros((len(part), WINDOW), np.int64)
        for k, (i, at) in enumerate(part):
            own = codes[i][at : at + WINDOW]
            symbols[k, : len(own)] = own
        e = net.emissions(symbols)
        path, posterior = net.viterbi(e), net.marginals(e)[1]
        for k, (i, at) in enumerate(part):
            n = min(WINDOW, len(codes[i]) - at)
            here = slice(at, at + n)
            better = middle[:n] < near[i][here]
            tags[i][here] = np.where(better, path[k, :n], tags[i][here])
            sure[i][here] = np.where(better, posterior[np.arange(n), k, path[k, :n]], sure[i][here])
            near[i][here] = np.where(better, middle[:n], near[i][here])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (i, first, _, _) in enumerate(parts):
        row = tags[k]
        kind = np.where(row > 0, (row - 1) // 2, -1)
        begins = np.flatnonzero((row > 0) & ((row % 2 == 1) | (np.r_[-1, kind[:-1]] != kind)))
        for a in begins:
            b = a + 1
            while b < len(row) and row[b] == 2 + 2 * kind[a]:
                b += 1
            if sure[k][a:b].mean() >= SURE:
                out[i].append((int(kind[a]), int(first + a), int(first + b)))
    return out


def plausible(kind: int, span: str) -> bool:
    digits = len(NOT_DIGIT.sub("", span))
    return len(span) >= 6 and span == span.strip() and (("@" in span and "." in span), 4 <= digits <= 12 and span.count(".") >= 3, 13 <= digits <= 19, 9 <= digits <= 15)[kind]


def all_spans(net: Network | None, texts: list[str]) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text; added spans overlap no pattern span and are of a possible shape."""
    base = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
    added = decode(net, texts) if net else [[] for _ in texts]
    out = []
    for text, own, more in zip(texts, base, added, strict=True):
        new = [s for s in more if plausible(s[0], text[s[1] : s[2]]) and not any(s[1] < b and a < s[2] for _, a, b in own)] if more else []
        out.append((own, sorted(own + new)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def training_windows(doc: int | None, text: str) -> list[int]:
    """The windows of a text that may train: the SNIPPETS_PER_DOC with the least hash of doc_id and start."""
    at = np.array(windows_of(text), np.int64)
    key = mix(at.view(U64) ^ mix(np.array([doc or 0], np.int64).view(U64)))
    return at[np.argsort(key, kind="stable")[:SNIPPETS_PER_DOC]].tolist()


def train_pii(docs: DataFrame, snippets: int = TRAIN_SNIPPETS) -> Network | None:
    """Train on at most `snippets` windows around triggers, labelled by the patterns, and on made-up spans among their words.

    A text gives at most SNIPPETS_PER_DOC of its windows, chosen by hash, so that a long text does not outweigh others.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            rows: dict[str, list] = {"doc_id": [], "at": [], "snippet": [], "spans": []}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text or not TRIGGER.search(text):
                    continue
                spans = base_spans(text)
                for at in training_windows(doc, text):
                    inside = [(k, a - at, b - at) for k, a, b in spans if a >= at and b <= at + WINDOW]
                    if len(inside) == sum(a < at + WINDOW and b > at for _, a, b in spans):
                        for k, v in (("doc_id", doc), ("at", at), ("snippet", text[at : at + WINDOW]), ("spans", joined(inside))):
                            rows[k].append(v)
            yield pa.record_batch([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["at"], pa.int32()), pa.array(rows["snippet"], pa.string()), pa.array(rows["spans"], pa.string())], list(rows))

    cuts = docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(cut, "doc_id long, at int, snippet string, spans string")
    picked = bounded_sample(Scratch(docs.sparkSession, "pii").write(cuts, "cuts"), snippets, "doc_id", "at", "snippet").collect()
    labelled = [(r.snippet, [(KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]) for r in picked]
    return fit_network(samples_of(labelled)) if labelled else None


def find_pii(docs: DataFrame, snippets: int = TRAIN_SNIPPETS) -> DataFrame:
    """One row per document: doc_id, base (the patterns' spans) and spans (the network's included), arrays of kind, start and end in code points.

    Whole texts are read; a null text counts as empty and has no spans. Repeated rows get the same result each, a null doc_id is passed on;
    spans of different kinds may overlap. An empty table gives no rows, and without any digit or @ there is no network. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    net = spark.sparkContext.broadcast(train_pii(docs, snippets))
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices_by_bytes(batches, "text", BATCH_BYTES):
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                found = all_spans(net.value, [t or "" for t in batch.column("text").to_pylist()])
                columns = [pa.array([named(f[i]) for f in found], SPANS) for i in (0, 1)]
                yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(find, f"doc_id long, base {spans}, spans {spans}")
