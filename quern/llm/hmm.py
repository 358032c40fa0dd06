"""A hidden Markov model over token numbers: scaled forward recursion and Baum-Welch counts, vectorised over chunks.

A sequence is cut into chunks of ``STEP`` tokens. The product of the chunk's transition-emission matrices carries the
forward vector from its start to its end, so all chunks of all sequences advance together and the exact likelihood of a
sequence follows by chaining its few chunk products. Every product and vector is rescaled; the logarithms of the scales
are kept.

Longer sequences than ``SEGMENT`` go segment by segment, forward first, which keeps one vector for each segment, then
backward; memory does not follow the length of a sequence.
"""

from __future__ import annotations

import numpy as np

STEP = 64
#: Tokens of a sequence that are held at once, at most.
SEGMENT = 1 << 18
#: Steps between rescalings of a chunk product; 16 emissions of 1e-15 stay within the range of a double.
RESCALE = 16


class Hmm:
    """``start`` (K), ``move`` (K x K) and ``emit`` (K x V), rows that sum to one."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move = np.asarray(start, float), np.asarray(move, float)
        self.of_token = np.ascontiguousarray(np.asarray(emit, np.float32).T)  # V x K
        self.k = len(self.start)


class _Chunks:
    """Chunks of some non-empty sequences, by falling length, with the products of their matrices.

    Not ``opening``: the sequences go on from earlier tokens.
    """

    def __init__(self, model: Hmm, sequences: list[np.ndarray], opening: bool = True):
        self.model, k = model, model.k
        n = np.array([len(s) for s in sequences])
        per = -(-n // STEP)
        self.order = np.argsort(-per, kind="stable")  # sequences by falling number of chunks
        self.per = per[self.order]
        first = np.cumsum(per) - per
        number = np.arange(per.sum()) - np.repeat(first, per)  # of a chunk within its sequence
        size = np.minimum(STEP, np.repeat(n, per) - number * STEP)
        begin = np.repeat(np.cumsum(n) - n, per) + number * STEP
        by_size = np.argsort(-size, kind="stable")
        self.lane = np.empty(len(size), np.int64)
        self.lane[by_size] = np.arange(len(size))
        self.first = first[self.order]
        self.size, begin = size[by_size], begin[by_size]
        self.opening = (number[by_size] == 0) & opening
        flat = np.concatenate(sequences)
        self.active = [int(np.searchsorted(-self.size, -t, "left")) for t in range(STEP)]  # lanes longer than t
        self.tokens = [flat[begin[:m] + t] for t, m in enumerate(self.active)]
        self.product = np.empty((len(size), k, k))
        self.scale = np.zeros(len(size))
        p = np.where(self.opening[:, None, None], model.start[None, None, :], model.move[None])
        for t, (m, own) in enumerate(zip(self.active, self.tokens)):
            if not m:
                break
            if t:
                p[:m] = (p[:m].reshape(-1, k) @ model.move).reshape(m, k, k)
            p[:m] *= model.of_token[own][:, None, :]
            if t % RESCALE == RESCALE - 1:
                self._rescale(p)
        self._rescale(p)
        self.product = p

    def _rescale(self, p: np.ndarray) -> None:
        top = p.max((1, 2))
        p /= top[:, None, None]
        self.scale += np.log(top)

    def lanes(self, c: int) -> tuple[int, np.ndarray]:
        """(sequences with a chunk number c, the lanes of those chunks); the sequences are the first of ``order``."""
        m = int(np.searchsorted(-self.per, -c, "left"))
        return m, self.lane[self.first[:m] + c]

    def forward(self, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(natural log-likelihood of each sequence, forward vector before each lane, forward vector at the end).

        ``first``: the forward vector that the sequences go on from.
        """
        k = self.model.k
        vector = np.zeros((len(self.per), k))
        if first is None:
            vector[:, 0] = 1  # the opening product has equal rows
        else:
            vector[:] = first
        total = np.zeros(len(self.per))
        before = np.empty((len(self.size), k))
        for c in range(int(self.per[0])):
            m, lane = self.lanes(c)
            before[lane] = vector[:m]
            v = (vector[:m, None, :] @ self.product[lane])[:, 0]
            z = v.sum(1)
            vector[:m] = v / z[:, None]
            total[:m] += np.log(z) + self.scale[lane]
        out = np.empty(len(total))
        out[self.order] = total
        return out, before, vector

    def backward(self, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(backward vector after each lane, backward vector before the sequences); ``last``: the one after their end."""
        k = self.model.k
        vector = np.ones((len(self.per), k))
        if last is not None:
            vector[:] = last
        after = np.empty((len(self.size), k))
        for c in range(int(self.per[0]) - 1, -1, -1):
            m, lane = self.lanes(c)
            after[lane] = vector[:m]
            v = (self.product[lane] @ vector[:m, :, None])[:, :, 0]
            vector[:m] = v / v.sum(1, keepdims=True)
        return after, vector


def log_likelihood(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the exact probability of each (non-empty) sequence."""
    out = np.empty(len(sequences))
    short = [i for i, s in enumerate(sequences) if len(s) <= SEGMENT]
    if short:
        out[short] = _Chunks(model, [sequences[i] for i in short]).forward()[0]
    for i, s in enumerate(sequences):
        if len(s) > SEGMENT:
            out[i] = _entries(model, s)[1]
    return out


def _segments(s: np.ndarray) -> list[np.ndarray]:
    return np.split(s, range(SEGMENT, len(s), SEGMENT))


def _entries(model: Hmm, s: np.ndarray) -> tuple[list[np.ndarray | None], float]:
    """(the forward vector that each segment of a long sequence goes on from, natural log-likelihood)."""
    first, firsts, log = None, [], 0.0
    for k, own in enumerate(_segments(s)):
        firsts.append(first)
        total, _, first = _Chunks(model, [own], k == 0).forward(first)
        log += float(total[0])
    return firsts, log


class Counts:
    """Expected counts of Baum-Welch: of first states, moves and emissions (V x K)."""

    def __init__(self, k: int, v: int):
        self.start, self.move, self.emit, self.log = np.zeros(k), np.zeros((k, k)), np.zeros((v, k)), 0.0

    def add(self, model: Hmm, sequences: list[np.ndarray]) -> None:
        if short := [s for s in sequences if len(s) <= SEGMENT]:
            self._add(_Chunks(model, short))
        for s in sequences:
            if len(s) > SEGMENT:
                last = None
                for k, (own, first) in reversed(list(enumerate(zip(_segments(s), _entries(model, s)[0])))):
                    last = self._add(_Chunks(model, [own], k == 0), first, last)

    def _add(self, c: _Chunks, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The backward vector before the sequences."""
        model = c.model
        total, before, _ = c.forward(first)
        self.log += float(total.sum())
        beta, begin = c.backward(last)
        alphas, a = [], before.copy()
        for t, (m, own) in enumerate(zip(c.active, c.tokens)):
            if not m:
                break
            step = a[:m] @ model.move
            if t == 0:
                step[c.opening] = model.start
            a = step * model.of_token[own]
            a /= a.sum(1, keepdims=True)
            alphas.append(a)
        seen, tokens = [], []
        for t in range(len(alphas) - 1, -1, -1):
            m, own = c.active[t], c.tokens[t]
            gamma = alphas[t] * beta[:m]
            gamma /= gamma.sum(1, keepdims=True)
            seen.append(gamma)
            tokens.append(own)
            v = model.of_token[own] * beta[:m]
            prior, rows = (alphas[t - 1][:m], slice(None)) if t else (before, ~c.opening)
            prior, own_v = prior[rows], v[rows]
            z = ((prior @ model.move) * own_v).sum(1, keepdims=True)
            self.move += model.move * ((prior / z).T @ own_v)
            if t == 0:
                self.start += gamma[c.opening].sum(0)
            b = v @ model.move.T
            beta[:m] = b / b.sum(1, keepdims=True)
        gamma, tokens = np.concatenate(seen), np.concatenate(tokens)
        for k in range(model.k):
            self.emit[:, k] += np.bincount(tokens, gamma[:, k], len(self.emit))
        return begin
