"""A bidirectional GRU with attention pooling, in numpy: scoring, gradients, training."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def new_params(rng: np.random.Generator, n_in: int, hidden: int, attention: int) -> Params:
    def draw(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p: Params = {}
    for d in "fb":  # forward and backward
        p[f"W{d}"], p[f"b{d}"] = draw(n_in, 3 * hidden), np.zeros(3 * hidden, np.float32)
        p[f"U{d}"] = draw(hidden, 3 * hidden)
    p["A"], p["a"], p["v"] = draw(2 * hidden, attention), np.zeros(attention, np.float32), draw(attention)
    p["w"], p["c"] = draw(2 * hidden), np.zeros(1, np.float32)
    return p


def projected(p: Params, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each input adds to the gates of either direction; once for each distinct input."""
    return x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]


def _run(u: np.ndarray, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
    n, steps = ids.shape
    k = u.shape[0]
    h = np.zeros((n, k), np.float32)
    out = np.empty((steps, n, k), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        g, hu = gates[ids[:, t]], h @ u
        zr = sigmoid(g[:, : 2 * k] + hu[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        c = np.tanh(g[:, 2 * k :] + r * hu[:, 2 * k :])
        m = mask[:, t : t + 1]
        if keep is not None:
            keep.append((t, h, z, r, c, hu[:, 2 * k :]))
        h = h + m * (1.0 - z) * (c - h)
        out[t] = h
    return out


def forward(p: Params, gates: tuple, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window. ids: windows x steps, places in ``gates``; mask: 1 or 0."""
    f = _run(p["Uf"], gates[0], ids, mask, False, None if keep is None else keep.setdefault("f", []))
    b = _run(p["Ub"], gates[1], ids, mask, True, None if keep is None else keep.setdefault("b", []))
    h = np.concatenate((f, b), axis=2)
    q = np.tanh(h @ p["A"] + p["a"])
    e = q @ p["v"] + (mask.T - 1) * 1e4
    e = np.exp(e - e.max(axis=0))
    alpha = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", alpha, h)
    if keep is not None:
        keep |= {"h": h, "q": q, "alpha": alpha, "pooled": pooled}
    return pooled @ p["w"] + p["c"][0]


def backward(p: Params, keep: dict, ids: np.ndarray, mask: np.ndarray, x: np.ndarray, d_logit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters and of the distinct inputs ``x``."""
    h, q, alpha = keep["h"], keep["q"], keep["alpha"]
    k = p["Uf"].shape[0]
    g: Params = {"w": keep["pooled"].T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["w"]
    d_h = alpha[:, :, None] * d_pooled
    d_alpha = np.einsum("tnk,nk->tn", h, d_pooled)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    g["v"] = np.einsum("tn,tna->a", d_e, q)
    d_q = d_e[:, :, None] * p["v"] * (1 - q * q)
    g["A"], g["a"] = np.einsum("tnk,tna->ka", h, d_q, optimize=True), d_q.sum(axis=(0, 1))
    d_h = d_h + d_q @ p["A"].T
    d_x = np.zeros_like(x)
    for d, part in (("f", d_h[:, :, :k]), ("b", d_h[:, :, k:])):
        u = p[f"U{d}"]
        d_u, d_gates = np.zeros_like(u), np.zeros((len(x), 3 * k), np.float32)
        carry = np.zeros_like(part[0])
        for t, before, z, r, c, hn in reversed(keep[d]):
            m = mask[:, t : t + 1]
            total = carry + part[t]
            d_c = total * m * (1 - z) * (1 - c * c)
            d_z = -total * m * (c - before) * z * (1 - z)
            d_r = d_c * hn * r * (1 - r)
            d_gate = np.concatenate((d_z, d_r, d_c), axis=1)
            d_hu = np.concatenate((d_z, d_r, d_c * r), axis=1)
            d_u += before.T @ d_hu
            np.add.at(d_gates, ids[:, t], d_gate)
            carry = total * (1 - m * (1 - z)) + d_hu @ u.T
        g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = d_u, x.T @ d_gates, d_gates.sum(axis=0)
        d_x += d_gates @ p[f"W{d}"].T
    return g, d_x


class Adam:
    def __init__(self, rate: float = 0.01, decay: float = 1e-4):
        self.rate, self.decay, self.t, self.m, self.s = rate, decay, 0, {}, {}

    def step(self, p: Params, g: Params) -> None:
        self.t += 1
        for k, d in g.items():
            d = np.clip(d, -5, 5)
            m = self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * d
            s = self.s[k] = 0.999 * self.s.get(k, 0.0) + 0.001 * d * d
            p[k] -= self.rate * (m / (1 - 0.9**self.t) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8) + self.decay * p[k])
