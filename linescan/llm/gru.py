"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are windows of words. A word enters as an embedding of its own, if the
network learned one, and the mean embedding of its character n-grams; two gated
recurrent layers run over the window from either end, attention weighs their
states, and one unit reads the weighted mean.
"""

from __future__ import annotations

import numpy as np

WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 16
CHAR_BUCKETS = 1 << 15
CHAR_ORDERS = (3, 4, 5)


def char_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the UTF-8 n-grams of all words, marked at both ends, and where each word's begin (one more at the end)."""
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    begins = np.cumsum(sizes) - sizes
    left = np.repeat(begins + sizes, sizes) - np.arange(len(codes))  # bytes from here to the word's end
    found, owners = [], []
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    for n in CHAR_ORDERS:
        rolled = np.zeros(max(0, len(codes) - n + 1), np.uint32)
        for i in range(n):
            rolled = (rolled + codes[i : i + len(rolled)] + np.uint32(1)) * np.uint32(0x9E3779B1)
        inside = left[: len(rolled)] >= n
        key = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - CHAR_BUCKETS.bit_length() + 1)
        found.append(key[inside].astype(np.int32))
        owners.append(owner[: len(rolled)][inside])
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(owners, minlength=len(words)), out=offsets[1:])
    return found[order], offsets


def segment_means(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of each segment of rows; 0 for an empty one."""
    sizes = np.diff(offsets)
    padded = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
    sums = np.add.reduceat(padded, np.minimum(offsets[:-1], len(rows)), axis=0)
    sums[sizes == 0] = 0
    return sums / np.maximum(sizes, 1)[:, None].astype(rows.dtype)


def summed_at(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Row k of the n rows returned is the sum of the rows that belong at k."""
    order = np.argsort(at, kind="stable")
    used, first = np.unique(at[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(used):
        out[used] = np.add.reduceat(rows[order], first, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_parameters(n_words: int, seed: int = 0) -> dict[str, np.ndarray]:
    """``n_words`` counts row 0, which stands for all words without an embedding and for padding, and stays 0."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    x, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"word": draw(n_words, WORD_DIM, scale=0.1), "char": draw(CHAR_BUCKETS, CHAR_DIM, scale=0.1)}
    p["word"][0] = 0
    for side in "fb":
        p |= {f"W{side}": draw(x, 3 * h, scale=x**-0.5), f"U{side}": draw(h, 3 * h, scale=h**-0.5), f"b{side}": np.zeros(3 * h, np.float32)}
    return p | {"A": draw(2 * h, h, scale=0.3), "a": draw(h, scale=0.3), "o": draw(2 * h, scale=0.3), "c": np.zeros(1, np.float32)}


def _run(proj: np.ndarray, mask: np.ndarray, U: np.ndarray, backward: bool, store: bool) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction; proj is (T, B, 3H), mask (T, B, 1)."""
    steps, batch, h3 = proj.shape
    h = h3 // 3
    state = np.zeros((batch, h), np.float32)
    states, kept = np.empty((steps, batch, h), np.float32), []
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        inner = state @ U
        gates = sigmoid(proj[t, :, : 2 * h] + inner[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(proj[t, :, 2 * h :] + r * inner[:, 2 * h :])
        m = mask[t] * (1 - z)
        if store:
            kept.append((t, state, z, r, new, inner[:, 2 * h :]))
        state = state + m * (new - state)
        states[t] = state
    return states, kept


def word_inputs(p: dict[str, np.ndarray], word_ids: np.ndarray, chars: np.ndarray, offsets: np.ndarray, block: int = 8192) -> np.ndarray:
    """Inputs of words, a block at a time, since an embedding for each of all their n-grams would be many times as large."""
    out = np.empty((len(word_ids), WORD_DIM + CHAR_DIM), p["char"].dtype)
    out[:, :WORD_DIM] = p["word"][word_ids]
    for at in range(0, len(word_ids), block):
        own = offsets[at : at + block + 1]
        out[at : at + block, WORD_DIM:] = segment_means(p["char"][chars[own[0] : own[-1]]], own - own[0])
    return out


def forward(p: dict[str, np.ndarray], inputs: np.ndarray, windows: np.ndarray, store: bool = False):
    """Logits of windows (B, T): places in ``inputs``, -1 for padding behind the words."""
    ids = np.ascontiguousarray(windows.T)
    mask = (ids >= 0).astype(np.float32)[:, :, None]
    sides = [_run((inputs @ p[f"W{s}"] + p[f"b{s}"])[ids], mask, p[f"U{s}"], s == "b", store) for s in "fb"]
    states = np.concatenate([sides[0][0], sides[1][0]], axis=2)
    hidden = np.tanh(states @ p["A"])
    energy = np.where(mask[:, :, 0] > 0, hidden @ p["a"], np.float32(-1e9))
    weight = np.exp(energy - energy.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    logits = pooled @ p["o"] + p["c"]
    return (logits, (ids, mask, sides, states, hidden, weight, pooled)) if store else logits


def gradients(p: dict[str, np.ndarray], inputs: np.ndarray, windows: np.ndarray, targets: np.ndarray, weights: np.ndarray):
    """Gradients of the weighted log loss by parameter (those above the inputs), and by input; and the logits."""
    logits, (ids, mask, sides, states, hidden, weight, pooled) = forward(p, inputs, windows, True)
    d_logit = ((sigmoid(logits) - targets) * weights / max(weights.sum(), 1e-9)).astype(np.float32)
    g = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["o"]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
    d_energy = weight * (d_weight - (weight * d_weight).sum(0))
    d_inner = d_energy[:, :, None] * p["a"] * (1 - hidden**2)
    g["a"] = np.einsum("tb,tbh->h", d_energy, hidden)
    g["A"] = np.einsum("tbh,tbk->hk", states, d_inner)
    d_states = weight[:, :, None] * d_pooled + d_inner @ p["A"].T
    h = HIDDEN
    d_inputs = np.zeros_like(inputs)
    for k, s in enumerate("fb"):
        U, own = p[f"U{s}"], d_states[:, :, k * h : (k + 1) * h]
        d_proj = np.zeros((*ids.shape, 3 * h), np.float32)
        g_U, carry = np.zeros_like(U), np.zeros((ids.shape[1], h), np.float32)
        for t, before, z, r, new, inner_n in reversed(sides[k][1]):
            d = own[t] + carry
            m = mask[t]
            d_new = d * m * (1 - z) * (1 - new**2)
            d_z = -d * m * (new - before) * z * (1 - z)
            d_r = d_new * inner_n * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_proj[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            g_U += before.T @ d_in
            carry = d * (1 - m * (1 - z)) + d_in @ U.T
        flat, at = d_proj.reshape(-1, 3 * h), ids.reshape(-1)
        by_input = summed_at(at[at >= 0], flat[at >= 0], len(inputs))
        g |= {f"U{s}": g_U, f"b{s}": by_input.sum(0), f"W{s}": inputs.T @ by_input}
        d_inputs += by_input @ p[f"W{s}"].T
    return g, d_inputs, logits


class Adam:
    """Adam with decoupled decay of the embeddings, so that n-grams without evidence fade."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float = 0.01, decay: float = 0.2):
        self.p, self.rate, self.decay, self.t = parameters, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            if k in ("word", "char"):
                self.p[k] *= np.float32(1 - self.rate * self.decay)
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)
