"""Hidden Markov model over the word stream: state 0 is the background, states 1..K the themes; emissions are fixed.

Here are the model, its kernels and training in one place; `hmm_blocks` trains and decodes streams of any length with them. Kernels cut a block in pieces
that are worked through side by side. Products are scaled to sum 1, and each transition's posterior is scaled before it is added up, so that no
constants have to cancel. Star-shaped transitions cost N a word and row instead of N^2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW = -1e300
#: Words of a piece of a block; all pieces of a block are worked through at once.
SUB = 256
#: How often pieces are done again before matrices are taken.
SWEEPS = 8
#: Words at the begin and end of a block that are looked at for whether it forgets, before the whole block is.
WIDTHS = (256, 2048)


@dataclass
class Hmm:
    """Start pi (N), transitions a (N x N), emissions b (N x M)."""

    pi: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @property
    def n(self) -> int:
        return len(self.pi)


def star(k: int, b: np.ndarray) -> Hmm:
    """The start: background in the middle, themes reached from it and left for it only."""
    n = k + 1
    a = np.zeros((n, n))
    a[0, 1:], a[1:, 0] = 1 / (2 * n), 0.5
    np.fill_diagonal(a, 0.5)
    return Hmm(np.full(n, 1 / n), a, b)


def emissions(lexicon: DataFrame, theme_words: DataFrame, themes: list[int]) -> np.ndarray:
    """Row 0: background; row 1 + i: theme i. Words that are not in the lexicon are left out. N x M numbers: the model's size, for the driver."""
    words = lexicon.select("word_id", "p").toPandas()
    if words.empty:
        return np.zeros((len(themes) + 1, 0))
    b = np.zeros((len(themes) + 1, int(words["word_id"].max()) + 1))
    b[0, words["word_id"]] = words["p"]
    place = {t: i + 1 for i, t in enumerate(themes)}
    known = theme_words.where(F.col("theme_id").isin(themes)).join(lexicon.select("word", "word_id"), "word").select("theme_id", "word_id", "p").toPandas()
    b[known["theme_id"].map(place), known["word_id"]] = known["p"]
    return b


def generate(model: Hmm, length: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(states, observations) by ancestral sampling."""
    rng = np.random.default_rng(seed)
    u, v = rng.random(length), rng.random(length)
    start, moves, emits = model.pi.cumsum(), model.a.cumsum(1), model.b.cumsum(1)
    states = np.empty(length, np.int64)
    for t in range(length):
        row = start if t == 0 else moves[states[t - 1]]
        states[t] = min(np.searchsorted(row, u[t] * row[-1], side="right"), model.n - 1)
    return states, np.minimum((emits[states] / emits[states, -1:] < v[:, None]).sum(1), model.b.shape[1] - 1)


def sequential_step(model: Hmm, obs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One Baum-Welch step on the whole sequence: new pi and unnormalised transition sums (all T - 1 transitions)."""
    e = model.b[:, obs].T
    alpha, beta, c = np.empty_like(e), np.ones_like(e), np.empty(len(obs))
    row = model.pi * e[0]
    for t in range(len(obs)):
        if t:
            row = (alpha[t - 1] @ model.a) * e[t]
        c[t] = row.sum() or 1.0
        alpha[t] = row / c[t]
    for t in range(len(obs) - 2, -1, -1):
        beta[t] = model.a @ (e[t + 1] * beta[t + 1]) / c[t + 1]
    xi = np.einsum("ti,tj->ij", alpha[:-1], e[1:] * beta[1:] / c[1:, None]) * model.a
    gamma = alpha[0] * beta[0]
    return gamma / (gamma.sum() or 1.0), xi


def normalised(xi: np.ndarray, old: np.ndarray) -> np.ndarray:
    total = xi.sum(1, keepdims=True)
    return np.where(total > 0, xi / np.where(total > 0, total, 1), old)


def train_sequential(model: Hmm, obs: np.ndarray, pi_threshold: float = 0.01, a_threshold: float = 0.01, max_iterations: int = 50) -> Hmm:
    for _ in range(max_iterations):
        pi, xi = sequential_step(model, obs)
        a = normalised(xi, model.a)
        done = np.abs(pi - model.pi).sum() < pi_threshold and np.abs(a - model.a).sum() < a_threshold
        model = Hmm(pi, a, model.b)
        if done:
            break
    return model


class Moves:
    """Products with transitions. A star (row 0, column 0 and the diagonal only) is taken from these three parts."""

    def __init__(self, a: np.ndarray):
        self.a, self.log = a, logs(a)
        off = a.copy()
        off[0], off[:, 0] = 0, 0
        np.fill_diagonal(off, 0)
        self.star = not off.any()
        self.diagonal, self.row, self.column = (np.where(np.arange(len(a)) > 0, x, 0) for x in (a.diagonal(), a[0], a[:, 0]))

    def forward(self, x: np.ndarray) -> np.ndarray:
        """x @ a over the last axis."""
        if not self.star:
            return x @ self.a
        out = x * self.diagonal
        out += x[..., :1] * self.row
        out[..., 0] = x @ self.a[:, 0]
        return out

    def backward(self, x: np.ndarray) -> np.ndarray:
        """x @ a.T over the last axis."""
        if not self.star:
            return x @ self.a.T
        out = x * self.diagonal
        out += x[..., :1] * self.column
        out[..., 0] = x @ self.a[0]
        return out

    def sums(self, before: np.ndarray, ahead: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The sum over rows r of weight[r] * before[r, i] * a[i, j] * ahead[r, j]."""
        heavy = before * weight[:, None]
        if not self.star:
            return self.a * (heavy.T @ ahead)
        out = np.diag(self.a.diagonal() * (heavy * ahead).sum(0))
        out[0] = self.a[0] * (heavy[:, 0] @ ahead)
        out[1:, 0] = self.a[1:, 0] * (ahead[:, 0] @ heavy[:, 1:])
        return out

    def forward_columns(self, x: np.ndarray) -> np.ndarray:
        """forward of the columns of x."""
        if not self.star:
            return self.a.T @ x
        out = x * self.diagonal[:, None]
        out += self.row[:, None] * x[0]
        out[0] = self.a[:, 0] @ x
        return out

    def backward_columns(self, x: np.ndarray) -> np.ndarray:
        """backward of the columns of x."""
        if not self.star:
            return self.a @ x
        out = x * self.diagonal[:, None]
        out += self.column[:, None] * x[0]
        out[0] = self.a[0] @ x
        return out

    def sums_of_columns(self, before: np.ndarray, ahead: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """sums over columns."""
        heavy = before * weight
        if not self.star:
            return self.a * (heavy @ ahead.T)
        out = np.diag(self.a.diagonal() * np.einsum("jk,jk->j", heavy, ahead))
        out[0] = self.a[0] * (ahead @ heavy[0])
        out[1:, 0] = self.a[1:, 0] * (heavy[1:] @ ahead[0])
        return out

    def best(self, x: np.ndarray) -> np.ndarray:
        """The greatest x[..., i] + log a[i, j] by j."""
        if not self.star:
            return (x[..., :, None] + self.log).max(-2)
        out = np.maximum(x[..., :1] + self.log[0], x + self.log.diagonal())
        out[..., 0] = (x + self.log[:, 0]).max(-1)
        return np.maximum(out, x.max(-1, keepdims=True) + LOW)

    def best_with_origin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """best, and the lowest i that gives it."""
        if self.star:
            middle, own = x[..., :1] + self.log[0], x + self.log.diagonal()
            out, origin = np.maximum(middle, own), np.where(middle >= own, 0, np.arange(len(self.a)))
            back = x + self.log[:, 0]
            origin[..., 0] = back.argmax(-1)
            out[..., 0] = back.max(-1)
            if (out > LOW / 2).all():
                return out, origin
        total = x[..., :, None] + self.log
        return total.max(-2), total.argmax(-2)


class Pieces:
    """A block cut into pieces of SUB words that are worked through side by side, one array step for all pieces at once. The last piece is padded:
    live tells real words. first: the block is the stream's first, so its first word has no transition before it."""

    def __init__(self, e: np.ndarray, first: bool, fill: float):
        length, n = e.shape
        self.count, self.n, self.length = -(-length // SUB), n, length
        self.steps = min(SUB, length)
        self.e = np.full((self.count * SUB, n), fill)
        self.e[:length] = e
        self.e = self.e.reshape(self.count, SUB, n)
        self.live = (np.arange(self.count * SUB) < length).reshape(self.count, SUB)
        self.first = first

    def start(self, t: int) -> bool:
        return self.first and t == 0

    def products(self, moves: Moves) -> np.ndarray:
        """The scaled matrix of each piece."""
        m = np.tile(np.eye(self.n), (self.count, 1, 1))
        for t in range(self.steps):
            step = moves.forward(m) * self.e[:, t, None, :]
            if self.start(t):
                step[0] = np.eye(self.n) * self.e[0, 0]
            m = np.where(self.live[:, t, None, None], scaled(step, (1, 2)), m)
        return m

    def best(self, pi: np.ndarray, moves: Moves) -> np.ndarray:
        """The best score of each piece between the state before it and its last one; without a state before it, in row 0."""
        m = moves.log[None] + self.e[:, 0, None, :]
        if self.first:
            m[0] = 2 * LOW
            m[0, 0] = pi + self.e[0, 0]
        for t in range(1, self.steps):
            step = moves.best(m) + self.e[:, t, None, :]
            m = np.where(self.live[:, t, None, None], np.maximum(step, 2 * LOW), m)
        return np.maximum(m, 2 * LOW)


def scaled(x: np.ndarray, axes: int | tuple[int, ...] = -1) -> np.ndarray:
    """x with sums of 1 over the axes, where they are not 0."""
    total = x.sum(axes, keepdims=True)
    return x / np.where(total == 0, 1.0, total)


class Lanes:
    """Blocks cut into pieces of SUB words; all pieces of all blocks are worked through side by side, with vectors: N numbers a word instead of N^2.

    A piece begins with a guess, and is done again where the piece before it ends otherwise. Models forget, so that is soon over; what has settled is what one pass through each
    whole block gives. Where a model does not forget within SWEEPS, the matrices of the pieces tell. emits: a column for each word, and one for padding; first: the place of the
    stream's first block, whose first word has no transition before it (-1: not here).
    """

    def __init__(self, emits: np.ndarray, blocks: list[np.ndarray], first: int = -1):
        sizes = np.array([len(x) for x in blocks])
        counts = -(-sizes // SUB)
        self.heads, self.tails, self.n = np.cumsum(counts) - counts, np.cumsum(counts) - 1, len(emits)
        self.first = int(self.heads[first]) if first >= 0 else -1
        padding = emits.shape[1] - 1
        ids = np.full((counts.sum(), SUB), padding)
        for head, count, words in zip(self.heads, counts, blocks, strict=True):
            ids[head : head + count].reshape(-1)[: len(words)] = words
        ids = np.ascontiguousarray(ids[:, : min(SUB, sizes.max())].T)
        self.steps, self.count = ids.shape
        # a column for each piece: array steps run along the pieces
        self.live, self.e, self.sizes = ids != padding, np.empty((self.steps, self.n, self.count)), sizes
        for state, row in enumerate(emits):
            self.e[:, state] = row[ids]
        self.full = self.live.all(1)

    def starts(self, at: np.ndarray | None) -> np.ndarray:
        """Where among the pieces `at` (none: all) the stream begins."""
        return np.flatnonzero((np.arange(self.count) if at is None else at) == self.first)

    def part(self, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        return (self.e, self.live) if at is None else (self.e[:, :, at], self.live[:, at])

    def kept(self, t: int, live: np.ndarray, new: np.ndarray, old: np.ndarray) -> np.ndarray:
        return new if self.full[t] else np.where(live[t].reshape(-1, *[1] * (new.ndim - 1)), new, old)

    def forward(self, moves: Moves, rows: np.ndarray, at: np.ndarray | None = None, keep: np.ndarray | None = None) -> np.ndarray:
        """Scaled forward values after the pieces; keep: those before each word, a column for each piece."""
        e, live = self.part(at)
        x, first = np.ascontiguousarray(rows.T), self.starts(at)
        for t in range(self.steps):
            if keep is not None:
                keep[t] = x
            step = moves.forward_columns(x)
            if t == 0:
                step[:, first] = x[:, first]
            step *= e[t]
            if t % 4 == 3:
                step = scaled(step, 0)
            x = step if self.full[t] else np.where(live[t], step, x)
        return scaled(x, 0).T

    def backward(self, moves: Moves, rows: np.ndarray, at: np.ndarray | None = None, see=None) -> np.ndarray:
        """Scaled backward values before the pieces; see is called with each place, the values after it times its emissions, and those before it, not scaled yet."""
        e, live = self.part(at)
        x = np.ascontiguousarray(rows.T)
        for t in range(self.steps - 1, -1, -1):
            ahead = e[t] * x
            step = moves.backward_columns(ahead)
            if see is not None:
                see(t, ahead, step)
            if t % 4 == 0:
                step = scaled(step, 0)
            x = step if self.full[t] else np.where(live[t], step, x)
        return scaled(x, 0).T

    def products(self, moves: Moves) -> list[np.ndarray]:
        """The scaled matrices of each block's pieces."""
        m = np.tile(np.eye(self.n), (self.count, 1, 1))
        for t in range(self.steps):
            step = moves.forward(m) * self.e[t].T[:, None]
            if t == 0 and self.first >= 0:
                step[self.first] = np.diag(self.e[0, :, self.first])
            m = self.kept(t, self.live, scaled(step, (1, 2)) if t % 8 == 7 else step, m)
        m = scaled(m, (1, 2))
        return [m[a : b + 1] for a, b in zip(self.heads, self.tails, strict=True)]

    def best_scores(self, pi: np.ndarray, moves: Moves, x: np.ndarray, at: np.ndarray | None = None, back: np.ndarray | None = None) -> np.ndarray:
        """The best scores of each state after the pieces, the greatest 0; back: by word and state the state before it."""
        e, live = self.part(at)
        first, own = self.starts(at), np.arange(self.n)
        for t in range(self.steps):
            if back is None:
                step = moves.best(x) + e[t].T
            else:
                step, origin = moves.best_with_origin(x)
                step, back[t] = step + e[t].T, self.kept(t, live, origin, np.broadcast_to(own, origin.shape))
            if t == 0:
                step[first] = pi + e[0].T[first]
            x = self.kept(t, live, np.maximum(step - step.max(-1, keepdims=True), 2 * LOW), x)
        return x

    def best_products(self, pi: np.ndarray, moves: Moves) -> list[np.ndarray]:
        """Pieces.best of each block, the greatest score 0."""
        m = moves.log[None] + self.e[0].T[:, None]
        if self.first >= 0:
            m[self.first] = 2 * LOW
            m[self.first, 0] = pi + self.e[0, :, self.first]
        for t in range(1, self.steps):
            step = moves.best(m) + self.e[t].T[:, None]
            m = self.kept(t, self.live, np.maximum(step - step.max((1, 2), keepdims=True), 2 * LOW), m)
        m = np.maximum(m, 2 * LOW)
        return [m[a : b + 1] for a, b in zip(self.heads, self.tails, strict=True)]

    def settled(self, run, given: np.ndarray, guess: float, alike, onward: int = 1) -> np.ndarray | None:
        """With what each piece begins, if each block's first piece begins with the block's of `given`; onward -1: from the last piece back. None: not settled."""
        fixed = self.heads if onward > 0 else self.tails
        begin = np.full((self.count, self.n), guess)
        begin[fixed] = given
        end = run(begin)
        for _ in range(SWEEPS):
            want = np.roll(end, onward, 0)
            want[fixed] = given
            at = np.flatnonzero(~alike(want, begin))
            if not len(at):
                return begin
            begin[at] = want[at]
            if 2 * len(at) > self.count:
                end = run(begin)
            else:
                end[at] = run(begin[at], at)
        return None


def like(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (np.abs(x - y) <= 1e-12 * y + 1e-250).all(-1)


def like_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((np.abs(x - y) <= 1e-9) | ((x < LOW / 2) & (y < LOW / 2))).all(-1)


def emitted(b: np.ndarray, padding: float = 1.0) -> np.ndarray:
    """b, and a column for padding."""
    return np.hstack([b, np.full((len(b), 1), padding)])


def expected_of_blocks(emits: np.ndarray, moves: Moves, blocks: list[np.ndarray], first: int, rows: list[np.ndarray], betas: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Transition sums of all blocks together, and of each the posterior of its first state. rows: scaled forward values before the blocks; betas: backward ones after them."""
    lanes = Lanes(emits, blocks, first)
    n, row, beta = lanes.n, np.array(rows), np.array(betas)
    before = lanes.settled(lambda x, at=None: lanes.forward(moves, x, at), row, 1 / n, like)
    after = lanes.settled(lambda x, at=None: lanes.backward(moves, x, at), beta, 1 / n, like, -1)
    if before is None or after is None:
        before, after = np.empty((lanes.count, n)), np.empty((lanes.count, n))
        for ms, a, b, x, y in zip(lanes.products(moves), lanes.heads, lanes.tails, row, beta, strict=True):
            before[a], after[b] = x, y
            for i in range(b - a):
                before[a + i + 1] = scaled(before[a + i] @ ms[i])
                after[b - i - 1] = scaled(ms[b - a - i] @ after[b - i])
    f, xi, heads = np.empty((lanes.steps, n, lanes.count)), np.zeros((n, n)), lanes.heads
    lanes.forward(moves, before, None, f)
    gamma, live = np.empty((len(blocks), n)), lanes.live.copy()
    if lanes.first >= 0:
        live[0, lanes.first] = False

    def see(t: int, ahead: np.ndarray, back: np.ndarray) -> None:
        nonlocal xi
        total = np.einsum("jk,jk->k", f[t], back)
        xi += moves.sums_of_columns(f[t], ahead, np.where(live[t] & (total > 0), 1 / np.where(total > 0, total, 1), 0))
        if t == 0:
            came = moves.forward_columns(f[0])[:, heads]
            gamma[:] = scaled((np.where(heads == lanes.first, f[0][:, heads], came) * ahead[:, heads]).T)

    lanes.backward(moves, after, None, see)
    return xi, gamma


def expected(model: Hmm, obs: np.ndarray, first: bool, row: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """expected_of_blocks of one block."""
    xi, gamma = expected_of_blocks(emitted(model.b), Moves(model.a), [obs], 0 if first else -1, [row], [beta])
    return xi, gamma[0]


def train_local(model: Hmm, obs: np.ndarray, pi_threshold: float = 0.01, a_threshold: float = 0.01, max_iterations: int = 50) -> Hmm:
    """train_sequential with the words worked through in pieces side by side."""
    emits = emitted(model.b)
    for _ in range(max_iterations):
        xi, (pi,) = expected_of_blocks(emits, Moves(model.a), [obs], 0, [model.pi], [np.ones(model.n)])
        a = normalised(xi, model.a)
        done = np.abs(pi - model.pi).sum() < pi_threshold and np.abs(a - model.a).sum() < a_threshold
        model = Hmm(pi, a, model.b)
        if done:
            break
    return model


def chained(score: np.ndarray, ms: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores after all matrices (in the sense of best; the greatest is 0), and for each the best state before it by the state after it."""
    came = []
    for m in ms:
        total = np.maximum(score[:, None] + m, 4 * LOW)
        came.append(total.argmax(0))
        score = total.max(0)
        score = score - score.max()
    return score, came


def traced(last: int, came: list[np.ndarray]) -> list[int]:
    """The states after each matrix, from the last one."""
    states = [last]
    for c in came[:0:-1]:
        states.append(int(c[states[-1]]))
    return states[::-1]


def logs(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.log(np.where(x > 0, x, 1)), LOW)


def best_product(ms: np.ndarray) -> np.ndarray:
    """The scores of a row of matrices between the state before the first and that after the last; the greatest is 0."""
    m = ms[0]
    for piece in ms[1:]:
        m = np.maximum((m[:, :, None] + piece[None]).max(1), 2 * LOW)
        m = np.maximum(m - m.max(), 2 * LOW)
    return m


def nowhere(n: int) -> np.ndarray:
    """Scores before the stream: matrices of its begin have their scores in row 0."""
    return np.r_[0.0, np.full(n - 1, 2 * LOW)]


def paths_of_blocks(emits: np.ndarray, pi: np.ndarray, moves: Moves, blocks: list[np.ndarray], first: int, begins: list[int], ends: list[int]) -> list[np.ndarray]:
    """The best states of each block between the states before and after it; emits and pi as logarithms. Ties go to the lowest state."""
    lanes = Lanes(emits, blocks, first)
    given = np.where(np.arange(lanes.n) == np.array(begins)[:, None], 0.0, 2 * LOW)
    if first >= 0:
        given[first] = nowhere(lanes.n)
    begin = lanes.settled(lambda x, at=None: lanes.best_scores(pi, moves, x, at), given, 0.0, like_scores)
    if begin is None:
        begin = np.empty((lanes.count, lanes.n))
        for ms, a, x in zip(lanes.best_products(pi, moves), lanes.heads, given, strict=True):
            begin[a] = x
            for i, m in enumerate(ms[:-1]):
                begin[a + i + 1] = chained(begin[a + i], m[None])[0]
    back = np.empty((lanes.steps, lanes.count, lanes.n), np.int64)
    lanes.best_scores(pi, moves, begin, None, back)
    # the state before a piece by the one it ends with, then the states at the pieces' ends, then those between
    came = np.tile(np.arange(lanes.n), (lanes.count, 1))
    for t in range(lanes.steps - 1, -1, -1):
        came = np.take_along_axis(back[t], came, 1)
    last, pieces = np.empty(lanes.count, np.int64), np.arange(lanes.count)
    for a, b, end in zip(lanes.heads, lanes.tails, ends, strict=True):
        last[b] = end
        for i in range(b, a, -1):
            last[i - 1] = came[i, last[i]]
    states = np.empty((lanes.count, lanes.steps), np.int32)
    for t in range(lanes.steps - 1, -1, -1):
        states[:, t] = last
        last = back[t][pieces, last]
    return [states[a : b + 1].ravel()[:n] for a, b, n in zip(lanes.heads, lanes.tails, lanes.sizes, strict=True)]


def thin(m: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """u and v if m is their outer product up to a factor: what comes after the words of m does not depend on what was before them."""
    total = m.sum(1)
    rows = m[total > 0] / total[total > 0, None]
    return (scaled(total), rows[0]) if len(rows) and (np.abs(rows - rows[0]) <= 1e-11 * rows[0] + 1e-250).all() else None


def thin_scores(m: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """thin for best scores: u[i] + v[j]."""
    most = m.max(1)
    rows = m[most > LOW / 2] - most[most > LOW / 2, None]
    alike = len(rows) and ((np.abs(rows - rows[0]) <= 1e-8) | ((rows < LOW / 2) & (rows[0] < LOW / 2))).all()
    return (np.maximum(most - most.max(), 2 * LOW), np.maximum(rows[0], 2 * LOW)) if alike else None


def outlines(blocks: list[np.ndarray], first: int, whole, split, forgets: list[bool]) -> list[tuple]:
    """Of each block (None, u, v) if its matrix is thin, else (matrix, None, None).

    A block is thin if its first and its last words are: u is told by the former, v by the latter, and the words between need no matrices. forgets: blocks for which
    no state is a dead end. whole: the matrices of blocks; split: thin or thin_scores.
    """
    out, left = [None] * len(blocks), list(range(len(blocks)))
    for width in (*WIDTHS, None):
        short = [i for i in left if width is None or len(blocks[i]) <= width]
        longer = [i for i in left if width is not None and len(blocks[i]) > width and forgets[i]]
        place = lambda members: members.index(first) if first in members else -1
        for i, m in zip(short, whole([blocks[i] for i in short], place(short)) if short else [], strict=True):
            found = split(m) if forgets[i] else None
            out[i] = (m, None, None) if found is None else (None, *found)
        if longer:
            heads, tails = whole([blocks[i][:width] for i in longer], place(longer)), whole([blocks[i][-width:] for i in longer], -1)
            for i, a, b in zip(longer, map(split, heads), map(split, tails), strict=True):
                out[i] = None if a is None or b is None else (None, a[0], b[1])
        left = [i for i in left if out[i] is None]
    return out
