"""Character-level bidirectional LSTM with CRF transitions in numpy: training, Viterbi decoding, marginals.

Windows are rows of symbol ids (padding -1 at the end).  Everything is batched over windows; a step of
the recurrence is one matrix product for the whole batch.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x, wx, wh, b):
    """Hidden states of a forward LSTM over x (T, B, D) and what its gradient needs."""
    t_max, n, _ = x.shape
    size = wh.shape[0]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    hs, cs, gates = np.zeros((t_max + 1, n, size), np.float32), np.zeros((t_max + 1, n, size), np.float32), np.zeros((t_max, n, 4 * size), np.float32)
    zx = x @ wx + b
    for t in range(t_max):
        z = zx[t] + h @ wh
        g = gates[t]
        g[:, :3 * size] = _sigmoid(z[:, :3 * size])
        g[:, 3 * size:] = np.tanh(z[:, 3 * size:])
        c = g[:, size:2 * size] * c + g[:, :size] * g[:, 3 * size:]
        h = g[:, 2 * size:3 * size] * np.tanh(c)
        hs[t + 1], cs[t + 1] = h, c
    return hs, cs, gates


def _lstm_grad(x, wx, wh, hs, cs, gates, dh_out):
    t_max, n, _ = x.shape
    size = wh.shape[0]
    dz = np.zeros_like(gates)
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    for t in reversed(range(t_max)):
        i, f, o, u = (gates[t][:, k * size:(k + 1) * size] for k in range(4))
        dh = dh + dh_out[t]
        tc = np.tanh(cs[t + 1])
        dc = dc + dh * o * (1 - tc ** 2)
        d = dz[t]
        d[:, :size] = dc * u * i * (1 - i)
        d[:, size:2 * size] = dc * cs[t] * f * (1 - f)
        d[:, 2 * size:3 * size] = dh * tc * o * (1 - o)
        d[:, 3 * size:] = dc * i * (1 - u ** 2)
        dc = dc * f
        dh = d @ wh.T
    flat = dz.reshape(-1, dz.shape[2])
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, hs[:-1].reshape(-1, size).T @ flat, flat.sum(axis=0)


def _log_sum(a, axis):
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, symbols: int, tags: int, embed: int = 8, hidden: int = 16, seed: int = 1):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": w(symbols + 1, embed), "out": w(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32)}
        for side in "lr":
            self.p |= {side + "x": w(embed, 4 * hidden), side + "h": w(hidden, 4 * hidden), side + "b": np.zeros(4 * hidden, np.float32)}
            self.p[side + "b"][hidden:2 * hidden] = 1.0

    def _emissions(self, x: np.ndarray):
        """(T, B, tags) scores; the right-to-left side reads the reversed rows (padding first, masked to zero)."""
        p, mask = self.p, (x >= 0).T[:, :, None].astype(np.float32)
        e = p["e"][x.T] * mask
        left = _lstm(e, p["lx"], p["lh"], p["lb"])
        right = _lstm(e[::-1], p["rx"], p["rh"], p["rb"])
        both = np.concatenate((left[0][1:], right[0][1:][::-1]), axis=2)
        return both @ p["out"] + p["bias"], (e, mask, left, right, both)

    def _marginals(self, em: np.ndarray, mask: np.ndarray):
        """Per-position tag probabilities, summed transition expectations and log-normalisers."""
        t_max, n, k = em.shape
        trans = self.p["trans"]
        alpha, beta = np.zeros((t_max, n, k)), np.zeros((t_max, n, k))
        alpha[0] = em[0]
        for t in range(1, t_max):
            step = _log_sum(alpha[t - 1][:, :, None] + trans[None], 1) + em[t]
            alpha[t] = np.where(mask[t], step, alpha[t - 1])
        for t in reversed(range(t_max - 1)):
            step = _log_sum(trans[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1], step, 0)
        z = _log_sum(alpha[-1], 1)
        node = np.exp(alpha + beta - z[None, :, None]) * mask
        edges = np.zeros((k, k))
        for t in range(1, t_max):
            e = alpha[t - 1][:, :, None] + trans[None] + (em[t] + beta[t])[:, None, :] - z[:, None, None]
            edges += (np.exp(e) * mask[t][:, :, None]).sum(axis=0)
        return node, edges, z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """(negative log-likelihood per window, gradients) of tag rows ``y``."""
        p, n = self.p, len(x)
        em, (e, mask, left, right, both) = self._emissions(x)
        node, edges, z = self._marginals(em, mask > 0)
        t_max, k = em.shape[0], em.shape[2]
        gold = np.eye(k)[np.maximum(y.T, 0)] * mask
        pair = (mask[1:, :, 0] * mask[:-1, :, 0]) > 0
        gold_edges = np.zeros((k, k))
        np.add.at(gold_edges, (y.T[:-1][pair], y.T[1:][pair]), 1)
        loss = float((z.sum() - (em * gold).sum() - (p["trans"] * gold_edges).sum()) / n)
        d_em = ((node - gold) / n).astype(np.float32)
        g = {"trans": ((edges - gold_edges) / n).astype(np.float32), "bias": d_em.sum(axis=(0, 1)),
             "out": both.reshape(-1, both.shape[2]).T @ d_em.reshape(-1, k)}
        d_both = d_em @ p["out"].T
        size = p["lh"].shape[0]
        d_l, g["lx"], g["lh"], g["lb"] = _lstm_grad(e, p["lx"], p["lh"], *left, d_both[:, :, :size])
        d_r, g["rx"], g["rh"], g["rb"] = _lstm_grad(e[::-1], p["rx"], p["rh"], *right, d_both[::-1, :, size:])
        d_e = (d_l + d_r[::-1]) * mask
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], x.T.reshape(-1), d_e.reshape(-1, d_e.shape[2]))
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 2) -> float:
        """Adam over random batches; returns the mean loss of the last tenth."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, g = self.gradients(x[pick], y[pick])
            losses.append(loss)
            lr = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, a in g.items():
                a = np.clip(a, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return float(np.mean(losses[-max(1, steps // 10):]))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(Viterbi tags, marginal probability of each of them), rows as ``x``."""
        em, (_, mask, *_) = self._emissions(x)
        node, _, _ = self._marginals(em, mask > 0)
        t_max, n, k = em.shape
        trans, score = self.p["trans"], em[0].astype(np.float64)
        back = np.zeros((t_max, n, k), np.int8)
        for t in range(1, t_max):
            s = score[:, :, None] + trans[None]
            back[t] = np.where(mask[t] > 0, s.argmax(axis=1), np.arange(k)[None])
            score = np.where(mask[t] > 0, s.max(axis=1) + em[t], score)
        tags = np.zeros((t_max, n), np.int64)
        tags[-1] = score.argmax(axis=1)
        for t in reversed(range(1, t_max)):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        prob = np.take_along_axis(node, tags[:, :, None], axis=2)[:, :, 0]
        return tags.T, prob.T
