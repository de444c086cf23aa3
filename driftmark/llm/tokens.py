"""Exact token counts by prefix dynamic programming over byte-pair merges.

For every prefix of a word the last token of its encoding is stored. It is the one token that ends there and whose pair with the
last token of the shorter prefix encodes to just these two; the count is then one more than the shorter prefix's. The table of a word holds
the count at each of its prefixes, a text's counts are sums of its words' tables, and these answer questions on budgets and
truncation without encoding again.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..ship import ship_package
from .common import slices_by_bytes, utf8_parts

#: Tokens up to which a document is within the limit.
LIMIT = 2048
#: Entries kept per cache and worker; a full cache is emptied, which costs time and changes nothing.
CACHE = 400_000
BATCH_BYTES = 4_000_000
#: Below U+0250 (and without these exceptions) NFC changes nothing, lower() maps one character to one, and str.split() splits as \s does.
UNSAFE = re.compile("[İ\x1c-\x1fɐ-\U0010ffff]")


#: Characters that Unicode calls white space end a chunk.
CHUNK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CLUSTER = regex.compile(r"\X")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = itertools.count(256)
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Chunks(dict):
    """Tokens of the chunks seen so far; one that is new is counted when it is asked for."""

    def __init__(self, counted: Callable[[str], int]):
        super().__init__()
        self.counted = counted

    def __missing__(self, chunk: str) -> int:
        if len(self) >= 2 * CACHE:
            self.clear()
        found = self[chunk] = self.counted(chunk)
        return found


class PrefixCounter:
    """Counts for one vocabulary file of the lower-casing, white-space-dropping kind with word ends."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model = parsed["model"]
        self.end = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.vocab = set(model["vocab"])
        #: Tokens that end a word, by what they are without the mark.
        self.closing = {t.removesuffix(self.end): t for t in self.vocab if t.endswith(self.end)}
        self.longest = max(map(len, self.closing), default=0)
        self.enders = self.tokens_by_head()
        self.special = [t["content"] for t in parsed["added_tokens"]]
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.special_begins = sorted({t[0] for t in self.special})
        self.split = regex.compile(parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.library = Tokenizer.from_str(spec)
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.fits: dict[tuple[str, str], bool] = {}
        self.tables: dict[str, list[int]] = {}
        self.known = Chunks(self.word).__getitem__
        self.chunk = Chunks(self.chunk_count).__getitem__

    def tokens_by_head(self) -> dict[str, tuple[str, ...]]:
        """For each begin of a token the tokens that it ends with, the longest first.

        All tokens that end at a place of a word are ends of the longest begin of a token that ends there, so they are found without looking at every stretch.
        """
        inner = [t for t in self.vocab if not t.endswith(self.end)]
        heads = {t[:i] for t in inner for i in range(1, len(t) + 1)}
        found: dict[str, tuple[str, ...]] = {"": ()}
        for head in sorted(heads, key=len):
            less = head[1:]
            while less not in found:
                less = less[1:]
            found[head] = (head, *found[less]) if head in self.vocab else found[less]
        return found

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair encoding, for pairs of tokens only."""
        rank, none = self.rank, 1 << 30
        ranks = [rank.get(p, none) for p in itertools.pairwise(symbols)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)  # equal pairs are merged from the left, one after another
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((symbols[i], symbols[i + 1]), none)
        return symbols

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def pair_fits(self, left: str, right: str) -> bool:
        """Whether the two tokens side by side are their own encoding (left "" stands for the word's begin)."""
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            want = [left, right] if left else [right]
            # two tokens that merge do not stay side by side
            found = self.fits[key] = key not in self.rank and self.merged([s for t in want for s in self.symbols(t)]) == want
        return found

    def inner(self, word: str) -> tuple[list[str], list[int]]:
        """Last token and count of each prefix of a word as the begin of a longer word; some bytes are no token's begin, then there is none ("")."""
        n, enders, known = len(word), self.enders, self.fits
        last, count, begin = [""] * (n + 1), [0] * (n + 1), 0
        for i in range(1, n + 1):
            while (found := enders.get(word[begin:i])) is None:
                begin += 1
            for token in found:
                at = i - len(token)
                left = last[at]
                if left or not at:
                    fit = known.get((left, token))
                    if self.pair_fits(left, token) if fit is None else fit:
                        last[i], count[i] = token, count[at] + 1
                        break
        return last, count

    def closed(self, word: str, i: int, last: list[str], count: list[int]) -> int:
        """Tokens of word[:i] as a word of its own."""
        closing = self.closing
        for begin in range(max(0, i - self.longest), i):
            token = closing.get(word[begin:i])
            if token is not None and (not begin or last[begin]) and self.pair_fits(last[begin], token):
                return count[begin] + 1
        return 0

    def filled(self, word: str) -> list[int]:
        """Tokens of each prefix of a word (in the byte alphabet) as a word of its own; the first is the empty one."""
        last, count = self.inner(word)
        return [0, *(self.closed(word, i, last, count) for i in range(1, len(word) + 1))]

    def table(self, word: str) -> list[int]:
        found = self.tables.get(word)
        if found is None:
            found = self.filled(word)
            if len(word) <= 200:
                if len(self.tables) >= CACHE:
                    self.tables.clear()
                self.tables[word] = found
        return found

    def word(self, word: str) -> int:
        """Tokens of a whole word: of its table the last entry, and no other is worked out."""
        return self.closed(word, len(word), *self.inner(word[:-1]))

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special strings, in the byte alphabet."""
        if UNSAFE.search(text):
            return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        return [self.as_bytes(m) for m in self.split.findall(text.lower())]

    def as_bytes(self, piece: str) -> str:
        """A piece without white space in the byte alphabet, in which printable ASCII stands for itself."""
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)

    def chunk_count(self, chunk: str) -> int:
        # ASCII letters are one word
        return self.word(chunk.lower()) if chunk.isascii() and chunk.isalpha() else sum(map(self.known, self.pieces(chunk)))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        total = 0
        if any(b in text for b in self.special_begins) and self.special_pattern.search(text):
            total = len(self.special_pattern.findall(text))
            parts = self.special_pattern.split(text)
        else:
            parts = [text]
        for part in parts:
            total += self.plain(part) if UNSAFE.search(part) else sum(map(self.chunk, part.split()))
        return total

    def split_text(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(begin, end, special) of a text's special strings and of the chunks without white space between them."""
        at = 0
        for m in [*(self.special_pattern.finditer(text) if any(b in text for b in self.special_begins) else ()), None]:
            for c in CHUNK.finditer(text, at, m.start() if m else len(text)):
                yield *c.span(), False
            if m:
                yield *m.span(), True
                at = m.end()

    def inside(self, chunk: str) -> list[int]:
        """Tokens of chunk[:i] for i from 0 to len(chunk); special strings count as text."""
        if UNSAFE.search(chunk):
            normalise, clusters = self.library.normalizer.normalize_str, CLUSTER.findall(chunk)
            parts = [normalise(c) for c in clusters]
            if (whole := normalise(chunk)) != "".join(parts):
                return [0, *(self.plain(chunk[:i]) for i in range(1, len(chunk) + 1))]
            pieces = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(whole)]
        else:
            whole, clusters = chunk.lower(), list(chunk)
            parts, pieces = list(whole), [m.span() for m in self.split.finditer(whole)]
        # counts at each place of the normalised chunk
        counts, before, starts = [0] * (len(whole) + 1), 0, [0] * (len(whole) + 1)
        for begin, end in pieces:
            piece = whole[begin:end]
            table = self.table(self.as_bytes(piece))
            sizes = itertools.accumulate(len(c.encode()) for c in piece)
            for i, size in enumerate(sizes, 1):
                cut = piece[:i]
                # a contraction ('re, 've, 'll) that is cut is no longer one
                short = i < len(piece) <= 3 and piece[0] == "'" and piece[1] in "rvl"
                counts[begin + i] = before + (sum(self.known(self.as_bytes(p)) for p in self.split.findall(cut)) if short else table[size])
                starts[begin + i] = begin if i < len(piece) else end
            before = counts[end]
        out, at = [0], 0
        for cluster, part in zip(clusters, parts, strict=True):
            for i in range(1, len(cluster)):
                # within a cluster, what follows could change what stands before
                begin = starts[at]
                out.append(counts[begin] + self.plain(whole[begin:at] + cluster[:i]))
            at += len(part)
            out.append(counts[at])
        return out

    def plain(self, text: str) -> int:
        """Tokens of a text in which special strings count as text."""
        return sum(map(self.known, self.pieces(text)))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to len(text), for any text; a special string is one token from its last character on."""
        out, before, at = np.zeros(len(text) + 1, np.int64), 0, 0
        chunk = (0, 0)  # where the last chunk begins, and the count before it
        for begin, end, special in self.split_text(text):
            out[at : begin + 1] = before
            if special:
                # until its end a special string is text that goes on from the chunk before it
                first, less = chunk if at == begin else (begin, before)
                own = [before, *(less + self.plain(text[first:i]) for i in range(begin + 1, end)), before + 1]
            else:
                own, chunk = before + np.array(self.inside(text[begin:end])), (begin, before)
            out[begin : end + 1] = own
            before, at = int(out[end]), end
            if special:
                chunk = (end, before)
        out[at:] = before
        return out

    def truncate(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens.

        Counts at the ends of chunks never fall, so only the first chunk that ends beyond the budget is looked into.
        """
        before, last, spans = 0, None, self.split_text(text)
        for begin, end, special in spans:
            n = 1 if special else self.chunk(text[begin:end])
            if before + n > budget:
                # a chunk and the special string right after it are looked into together
                if special and last and last[1] == begin and not last[2]:
                    begin, before = last[0], before - self.chunk(text[last[0] : begin])
                elif not special and (then := next(spans, None)) and then[0] == end and then[2]:
                    end = then[1]
                return begin + max(j for j, c in enumerate(self.prefix_counts(text[begin:end])) if before + c <= budget)
            before, last = before + n, (begin, end, special)
        return len(text)


_counters: dict[int, PrefixCounter] = {}


def counter(spec: str) -> PrefixCounter:
    """The worker's counter for a vocabulary, kept between tasks."""
    key = hash(spec)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(spec)
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens), limit_chars (code points of the text's longest
    prefix of at most `limit` tokens).

    A null text counts as empty and has 0 tokens; rows are counted one by one, so repeated rows, ties and a null doc_id are no matter; an
    empty table gives no rows; other columns are not read. The vocabulary file (about 1 MB) is read on the driver and sent to each executor once.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(sent.value)
        for batch in slices_by_bytes(batches, "text", BATCH_BYTES):
            sizes = np.diff(utf8_parts(batch.column("text"))[1])
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = np.array([own.count(t) for t in texts], np.int64)
            fits = [own.truncate(t, limit) if k > limit else len(t) for t, k in zip(texts, n, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes), pa.array(n), pa.array(n > limit), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")
