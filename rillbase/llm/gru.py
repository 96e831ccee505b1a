"""A small gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, Adam.

States, gates and logits are kept features by documents, so that every operation runs along long rows.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Steps whose inputs are gathered at once in scoring, and tokens whose outputs are evaluated at once.
CHUNK, OUTPUTS = 32, 16384


def sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.exp(-x)
    out += 1
    return np.reciprocal(out, out=out)


class GRU:
    """Predicts the next token of a vocabulary of classes * width ids; id // width is the token's class.

    The input's part of the gates is a table row per token; ids are those of the previous token, ``start`` at first.
    """

    names = ("table", "bias", "u", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, classes: int, width: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.width, self.hidden = classes, width, hidden
        self.start = classes * width
        f = np.float32
        self.table = (rng.standard_normal((self.start + 1, 3 * hidden)) * 0.1).astype(f)
        self.bias = np.zeros(3 * hidden, f)
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f)
        self.class_w = (rng.standard_normal((hidden, classes)) * 0.1).astype(f)
        self.class_b = np.zeros(classes, f)
        self.word_w = (rng.standard_normal((classes, hidden, width)) * 0.1).astype(f)
        self.word_b = np.zeros((classes, width), f)

    def inputs(self, tokens: np.ndarray) -> np.ndarray:
        """The input's part of the gates, (steps, 3 * hidden, documents), of tokens (steps, documents)."""
        return np.ascontiguousarray((self.table[tokens] + self.bias).transpose(0, 2, 1))

    def step(self, h: np.ndarray, x: np.ndarray):
        """The next state and z, r, c and the state's part of c; h and x are features by documents."""
        n = self.hidden
        hu = self.u.T @ h
        zr = sigmoid(x[: 2 * n] + hu[: 2 * n])
        z, r = zr[:n], zr[n:]
        c = r * hu[2 * n :]
        c += x[2 * n :]
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        return new, z, r, c, hu[2 * n :]

    def _by_class(self, token: np.ndarray):
        """The order of tokens by class, and (class, slice of that order) for each class there."""
        kind = token // self.width
        order = np.argsort(kind.astype(np.uint16), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(self.classes + 1))
        return order, [(c, slice(edges[c], edges[c + 1])) for c in np.flatnonzero(np.diff(edges)).tolist()]

    def output(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log p of each token given the state (a row of h) before it."""
        order, parts = self._by_class(token)
        x, y = h[order], token[order]
        at = np.arange(len(y))
        logits = self.class_w.T @ x.T + self.class_b[:, None]
        logp = logits[y // self.width, at] - _logsumexp(logits)
        for c, i in parts:
            logits = self.word_w[c].T @ x[i].T + self.word_b[c][:, None]
            logp[i] += logits[y[i] % self.width, at[: i.stop - i.start]] - _logsumexp(logits)
        out = np.empty_like(logp)
        out[order] = logp
        return out

    def flat(self) -> np.ndarray:
        """All weights in one vector."""
        return np.concatenate([getattr(self, k).ravel() for k in self.names])

    def load(self, weights: np.ndarray) -> None:
        at = 0
        for k in self.names:
            w = getattr(self, k)
            w[...] = weights[at : at + w.size].reshape(w.shape)
            at += w.size

    def gradients(self, block: np.ndarray, h: np.ndarray):
        """Gradients of the negative log-likelihood over one window, and the state after it.

        ``block``: tokens, (steps + 1, lanes); h: state before it. A step that reads ``start`` begins a document with an
        empty state; a target ``start`` counts for nothing.
        """
        n, (width, k) = self.hidden, (len(block) - 1, block.shape[1])
        x, keep = self.inputs(block[:-1]), (block[:-1] != self.start).astype(h.dtype)
        before, after, z, r, c, hu = np.empty((6, width, n, k), h.dtype)
        for s in range(width):
            before[s] = h * keep[s]
            h, z[s], r[s], c[s], hu[s] = self.step(before[s], x[s])
            after[s] = h
        g, dh = self._output_grad(after.transpose(0, 2, 1).reshape(-1, n), block[1:].reshape(-1))
        dh = np.ascontiguousarray(dh.reshape(width, k, n).transpose(0, 2, 1))
        to_c, to_z, to_r = z * (1 - c * c), (c - before) * z * (1 - z), hu * r * (1 - r)
        dx, du = np.empty((width, 3 * n, k), h.dtype), np.empty((width, 3 * n, k), h.dtype)
        back = np.zeros((n, k), h.dtype)
        for s in range(width - 1, -1, -1):
            d = dh[s]
            d += back
            dc = dx[s, 2 * n :]
            np.multiply(d, to_c[s], out=dc)
            np.multiply(d, to_z[s], out=dx[s, :n])
            np.multiply(dc, to_r[s], out=dx[s, n : 2 * n])
            du[s, : 2 * n] = dx[s, : 2 * n]
            np.multiply(dc, r[s], out=du[s, 2 * n :])
            back = self.u @ du[s]
            back += d
            d *= z[s]
            back -= d
            back *= keep[s]
        g["u"] = before.transpose(1, 0, 2).reshape(n, -1) @ du.transpose(1, 0, 2).reshape(3 * n, -1).T
        g["bias"] = dx.sum((0, 2))
        read = block[:-1].reshape(-1)
        order = np.argsort(read.astype(np.uint16) if self.start < 1 << 16 else read, kind="stable")
        ids, begin = np.unique(read[order], return_index=True)
        g["table"] = np.zeros_like(self.table)
        g["table"][ids] = np.add.reduceat(dx.transpose(0, 2, 1).reshape(-1, 3 * n)[order], begin, 0)
        return g, h

    def train(self, tokens: list[np.ndarray], window: int = 24, batch: int = 48, epochs: int = 2, rate: float = 0.01, span: tuple[float, float] = (0.0, 1.0)) -> None:
        """Truncated backpropagation over windows; each of ``batch`` lanes reads documents one after another, state carried within a document.

        Every document is read to its end: lanes are even but for documents longer than a lane, which go on alone.
        ``span`` is the part of the rate's schedule that this call covers.
        """
        lanes = _lanes([np.concatenate([[self.start], t]) for t in tokens], batch)
        if not lanes:
            return
        length = np.array([len(x) for x in lanes])
        text = np.concatenate([*lanes, np.full(window + 1, self.start)])
        first = np.cumsum(length) - length
        steps = int(length[0])
        moments = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in self.names}
        t = 0
        total = epochs * -(-(steps - 1) // window)
        for _ in range(epochs):
            h = np.zeros((self.hidden, len(lanes)), self.u.dtype)
            for a in range(0, steps - 1, window):
                k = int((length > a + 1).sum())
                at = a + np.arange(min(window, steps - 1 - a) + 1)[:, None]
                block = np.where(at < length[:k], text[np.minimum(first[:k] + at, len(text) - 1)], self.start)
                g, h = self.gradients(block, h[:, :k])
                t += 1
                step = rate * min(1.0, 0.1 + 2 * (1 - span[0] - (span[1] - span[0]) * t / total))
                for name in self.names:
                    d = np.clip(g[name] / len(lanes), -1, 1)
                    m, v = moments[name]
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    getattr(self, name)[...] -= (step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(self.u.dtype)

    def _output_grad(self, h: np.ndarray, target: np.ndarray):
        """Gradients of the negative log-likelihood; lane ends (``start``) count for nothing."""
        rows = np.flatnonzero(target != self.start)
        order, parts = self._by_class(target[rows])
        rows = rows[order]
        dh = np.zeros_like(h)
        g = {k: np.zeros_like(getattr(self, k)) for k in ("class_w", "class_b", "word_w", "word_b")}
        x, y = h[rows], target[rows]
        at = np.arange(len(y))
        p = _softmax(self.class_w.T @ x.T + self.class_b[:, None])
        p[y // self.width, at] -= 1
        g["class_w"], g["class_b"] = (p @ x).T, p.sum(1)
        dx = p.T @ self.class_w.T
        for c, i in parts:
            p = _softmax(self.word_w[c].T @ x[i].T + self.word_b[c][:, None])
            p[y[i] % self.width, at[: i.stop - i.start]] -= 1
            g["word_w"][c], g["word_b"][c] = (p @ x[i]).T, p.sum(1)
            dx[i] += p.T @ self.word_w[c].T
        dh[rows] = dx
        return g, dh

    def score(self, tokens: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural-log likelihood of each document; the state goes on from its first token to its last.

        Documents run side by side, longest first, and leave when a chunk of steps is done.
        """
        order = np.argsort(-counts, kind="stable")
        first, n = starts[order], counts[order]
        out = np.zeros(len(counts))
        longest = int(n[0]) if len(n) else 0
        h, a = np.zeros((self.hidden, int((n > 0).sum())), self.u.dtype), 0
        while a < longest:
            k = int(np.searchsorted(-n, -a, "left"))  # documents of more than a tokens
            width = max(1, min(CHUNK, longest - a, (1 << 18) // k))
            at = a + np.arange(width)[:, None]
            there = at < n[:k]
            target = tokens[np.where(there, first[:k] + at, 0)]
            read = np.empty_like(target)
            read[0] = self.start if a == 0 else tokens[first[:k] + a - 1]
            read[1:] = target[:-1]
            h, x, states = h[:, :k], self.inputs(read), np.empty((width, k, self.hidden), h.dtype)
            for s in range(width):
                h = self.step(h, x[s])[0]
                states[s] = h.T
            rows, target, logp = states[there], target[there], []
            for i in range(0, len(target), OUTPUTS):
                logp.append(self.output(rows[i : i + OUTPUTS], target[i : i + OUTPUTS]))
            out[:k] += np.bincount(np.nonzero(there)[1], np.concatenate(logp), k)
            a += width
        result = np.empty(len(counts))
        result[order] = out
        return result


def _lanes(tokens: list[np.ndarray], batch: int) -> list[np.ndarray]:
    """All documents dealt to at most ``batch`` lanes of about equal length, the longest lane first; within a lane they keep their order."""
    loads = [(0, i) for i in range(min(batch, len(tokens)))]
    mine: list[list[int]] = [[] for _ in loads]
    for d in sorted(range(len(tokens)), key=lambda d: -len(tokens[d])):
        load, i = loads[0]
        mine[i].append(d)
        heapq.heapreplace(loads, (load + len(tokens[d]), i))
    return sorted((np.concatenate([tokens[d] for d in sorted(x)]) for x in mine), key=len, reverse=True)


def _logsumexp(x: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis; x is used up."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x
