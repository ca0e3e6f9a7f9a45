"""A bidirectional gated recurrent network with attention pooling, in numpy: windows of words to one logit.

A word's vector is a hashed embedding of the word plus the mean of hashed embeddings of its character
n-grams and beginnings; of a long run without blanks each of its overlapping pieces is a word. Both directions run as one batched recurrence: arrays have the direction as first axis.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .words import hashes, mix

WORD_ROWS, CHAR_ROWS, DIM, HIDDEN, WINDOW, STRIDE = 1 << 17, 1 << 17, 10, 8, 32, 16
NGRAMS = (3, 4)
#: Bytes of the beginnings of a word, its left edge among them, that count as n-grams too: the stems that 4-grams can't tell apart.
BEGINNINGS = (5, 6, 7, 8)
#: Bytes of the longest word that stays whole; of the pieces that a longer one is split into; and from one to the next.
LONGEST, PIECE, PIECE_STEP = 40, 24, 12
_PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}*#$%&|<>-_"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Spans less up to `rounds` bytes of punctuation at either side; never empty."""
    starts, ends = starts.copy(), ends.copy()
    for _ in range(rounds):
        ends -= _PUNCTUATION[data[ends - 1]] & (ends - starts > 1)
        starts += _PUNCTUATION[data[starts]] & (ends - starts > 1)
    return starts, ends


def split_long(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (and the index of each document's first one) with those of over LONGEST bytes as overlapping pieces."""
    long = ends - starts > LONGEST
    count = np.where(long, 1 - (PIECE - (ends - starts)) // PIECE_STEP, 1)
    begins = np.concatenate([[0], np.cumsum(count)])
    word = np.repeat(np.arange(len(starts)), count)
    start = starts[word] + (np.arange(len(word)) - begins[word]) * PIECE_STEP
    return start, np.where(long[word], np.minimum(start + PIECE, ends[word]), ends[word]), begins[first]


@dataclass
class Words:
    """Distinct words: the row of each in the word table, and its rows in the table of character n-grams."""

    rows: np.ndarray
    grams: np.ndarray
    begins: np.ndarray


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Words, np.ndarray]:
    """The distinct words of spans of (lower-cased) bytes, and the place of each span's word among them."""
    kinds, at, back = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[at], ends[at]
    size = e - s + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    edge = (inside == 0) | (inside == np.repeat(size, size) - 1)
    source = np.where(edge, 0, np.repeat(s, size) + inside - 1)
    letters = np.where(edge, 1, data[source] if len(data) else 0).astype(np.uint64)
    rows, owners = [], []
    owner = np.repeat(np.arange(len(kinds)), size)
    for n in NGRAMS + BEGINNINGS:
        room = np.flatnonzero(inside + n <= np.repeat(size, size)) if n in NGRAMS else begin[:-1][n <= size]
        h = np.full(len(room), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + letters[room + k]
        rows.append((mix(h) % np.uint64(CHAR_ROWS)).astype(np.int32))
        owners.append(owner[room])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return Words((kinds % np.uint64(WORD_ROWS)).astype(np.int64), rows[order], np.searchsorted(owners[order], np.arange(len(kinds) + 1))), back


def window_table(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents' words (first: the index of each one's first word): start and end of all windows, and their document."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][doc] + k * STRIDE
    return np.stack([start, np.minimum(start + WINDOW, first[1:][doc])], 1), doc


@dataclass
class Network:
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "word": draw(WORD_ROWS, DIM, scale=0.05), "char": draw(CHAR_ROWS, DIM, scale=0.1),
            "x": draw(2, DIM, 3 * HIDDEN, scale=0.4), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "gates": draw(2, HIDDEN, 2 * HIDDEN, scale=0.3), "cand": draw(2, HIDDEN, HIDDEN, scale=0.3),
            "att": draw(2 * HIDDEN, HIDDEN, scale=0.3), "v": draw(HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32),
        }

    def vectors(self, words: Words, chunk: int = 20_000) -> np.ndarray:
        out = self.p["word"][words.rows]
        for i in range(0, len(out), chunk):
            to = min(i + chunk, len(out))
            b = words.begins[i : to + 1]
            out[i:to] += np.add.reduceat(self.p["char"][words.grams[b[0] : b[-1]]], b[:-1] - b[0], axis=0) / np.diff(b)[:, None]
        return out

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Inputs of both directions' gates for each word, and one more row for padding."""
        made = vectors @ self.p["x"] + self.p["bias"]
        return np.concatenate([made, np.zeros((2, 1, made.shape[2]), np.float32)], 1)

    def forward(self, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: index (windows x WINDOW) of words, mask of the same shape."""
        n, steps = index.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        cache = []
        for t in range(steps):
            at = (t, steps - 1 - t)
            x = np.stack([inputs[0][index[:, at[0]]], inputs[1][index[:, at[1]]]])
            m = np.stack([mask[:, at[0]], mask[:, at[1]]])[:, :, None]
            g = _sigmoid(x[:, :, : 2 * HIDDEN] + h @ self.p["gates"])
            r, z = g[:, :, :HIDDEN], g[:, :, HIDDEN:]
            c = np.tanh(x[:, :, 2 * HIDDEN :] + (r * h) @ self.p["cand"])
            new = h + m * z * (c - h)
            if keep:
                cache.append((h, r, z, c, m))
            h = new
            states[at[0], :, :HIDDEN], states[at[1], :, HIDDEN:] = h[0], h[1]
        hidden = np.tanh(states @ self.p["att"])
        weight = hidden @ self.p["v"] + (mask.T - 1) * 1e4
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["b"][0]
        return (logit, (states, hidden, weight, pooled, cache)) if keep else logit

    def gradients(self, words: Words, index: np.ndarray, mask: np.ndarray, target: np.ndarray, importance: np.ndarray):
        vectors = self.vectors(words)
        inputs = self.project(vectors)
        logit, (states, hidden, weight, pooled, cache) = self.forward(inputs, index, mask, keep=True)
        d = ((_sigmoid(logit) - target) * importance / importance.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * self.p["out"]
        d_weight = (states * d_pooled).sum(2)
        d_weight = weight * (d_weight - (weight * d_weight).sum(0))
        g["v"] = np.einsum("tnh,tn->h", hidden, d_weight)
        d_hidden = d_weight[:, :, None] * self.p["v"] * (1 - hidden**2)
        g["att"] = np.einsum("tns,tnh->sh", states, d_hidden)
        d_states = weight[:, :, None] * d_pooled + d_hidden @ self.p["att"].T
        dh = np.zeros((2, len(d), HIDDEN), np.float32)
        d_steps = np.zeros((2, index.shape[1], len(d), 3 * HIDDEN), np.float32)
        g["gates"], g["cand"] = np.zeros_like(self.p["gates"]), np.zeros_like(self.p["cand"])
        steps = index.shape[1]
        for t in reversed(range(steps)):
            at = (t, steps - 1 - t)
            h, r, z, c, m = cache[t]
            dh = dh + np.stack([d_states[at[0], :, :HIDDEN], d_states[at[1], :, HIDDEN:]])
            dz = dh * m * (c - h) * z * (1 - z)
            dc = dh * m * z * (1 - c**2)
            d_rh = dc @ self.p["cand"].transpose(0, 2, 1)
            dr = d_rh * h * r * (1 - r)
            d_gates = np.concatenate([dr, dz], 2)
            g["cand"] += (r * h).transpose(0, 2, 1) @ dc
            g["gates"] += h.transpose(0, 2, 1) @ d_gates
            full = np.concatenate([d_gates, dc], 2)
            for k in (0, 1):
                d_steps[k, at[k]] = full[k]
            dh = dh * (1 - m * z) + d_rh * r + d_gates @ self.p["gates"].transpose(0, 2, 1)
        word = index.T.ravel()
        order = np.argsort(word, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(word[order]) > 0])
        d_inputs = np.zeros_like(inputs)
        d_inputs[:, word[order][head]] = np.add.reduceat(d_steps.reshape(2, -1, 3 * HIDDEN)[:, order], head, axis=1)
        d_inputs = d_inputs[:, :-1]
        g["bias"] = d_inputs.sum(1, keepdims=True)
        g["x"] = vectors.T @ d_inputs
        d_vectors = (d_inputs @ self.p["x"].transpose(0, 2, 1)).sum(0)
        return logit, g, d_vectors


class Trainer:
    """Adam for the dense weights; Adagrad for the rows of the embedding tables that a batch uses."""

    def __init__(self, net: Network, rate: float = 0.01, row_rate: float = 0.03):
        self.net, self.rate, self.row_rate, self.t = net, rate, row_rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("word", "char")}
        self.s = {k: np.zeros_like(v) for k, v in self.m.items()}
        self.rows = {k: np.full(len(net.p[k]), 1e-6, np.float32) for k in ("word", "char")}

    def step(self, words: Words, index: np.ndarray, mask: np.ndarray, target: np.ndarray, importance: np.ndarray, rng, unknown: float = 0.6) -> None:
        """One step; a share `unknown` of the batch's words is shown without its row of the word table (as row 0)."""
        used, local = np.unique(index[mask > 0], return_inverse=True)
        small = np.full(index.shape, len(used))
        small[mask > 0] = local
        size = np.diff(words.begins)[used]
        begins = np.concatenate([[0], np.cumsum(size)])
        grams = words.grams[np.arange(begins[-1]) - np.repeat(begins[:-1] - words.begins[used], size)]
        own = Words(np.where(rng.random(len(used)) < unknown, 0, words.rows[used]), grams, begins)
        _, g, d_vectors = self.net.gradients(own, small, mask, target, importance)
        self.t += 1
        for k, m in self.m.items():
            m += 0.1 * (g[k] - m)
            self.s[k] += 0.001 * (g[k] ** 2 - self.s[k])
            self.net.p[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)
        self._rows("word", own.rows, d_vectors)
        self._rows("char", own.grams, np.repeat(d_vectors / size[:, None], size, axis=0))

    def _rows(self, table: str, rows: np.ndarray, grads: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        total, rows = np.add.reduceat(grads[order], head, axis=0), rows[head]
        self.rows[table][rows] += (total**2).mean(1)
        self.net.p[table][rows] -= self.row_rate * total / np.sqrt(self.rows[table][rows])[:, None]
