"""Speaker encoders: stacked LSTM and self-attention, forward and backward, in NumPy over batches.

An encoder is its parameters by name; a batch is (utterances, frames, features).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

Params = dict[str, np.ndarray]
#: Frames that go through an encoder at once where nothing is kept for training.
BLOCK = 512


class Encoder(Protocol):
    @property
    def size(self) -> int: ...
    def init(self, n_features: int, seed: int = 0) -> Params: ...
    def forward(self, p: Params, x: np.ndarray) -> tuple[np.ndarray, list]: ...
    def embed(self, p: Params, x: np.ndarray) -> np.ndarray: ...
    def backward(self, p: Params, saved: list, dy: np.ndarray) -> Params: ...


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return (1 + np.tanh(x / 2)) / 2  # the logistic function, without overflow


def _lecun(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    return rng.standard_normal((rows, columns)) / np.sqrt(rows)


def _orthogonal(rng: np.random.Generator, n: int) -> np.ndarray:
    q, r = np.linalg.qr(rng.standard_normal((n, n)))
    return q * np.sign(np.diag(r))


@dataclass(frozen=True)
class Lstm:
    """Layers of gates i, f, g, o; the embedding is the mean over time of the last layer, or its last frame."""

    hidden: int = 64
    layers: int = 3
    mean: bool = True

    @property
    def size(self) -> int:
        return self.hidden

    def init(self, n_features: int, seed: int = 0) -> Params:
        rng, p, width = np.random.default_rng(seed), {}, n_features
        for k in range(self.layers):
            p[f"{k}.x"] = np.concatenate([_lecun(rng, width, self.hidden) for _ in range(4)], 1)
            p[f"{k}.h"] = np.concatenate([_orthogonal(rng, self.hidden) for _ in range(4)], 1)
            p[f"{k}.b"] = np.zeros(4 * self.hidden)
            width = self.hidden
        return p

    def forward(self, p: Params, x: np.ndarray) -> tuple[np.ndarray, list]:
        saved = []
        for k in range(self.layers):
            n, t, _ = x.shape
            h, c = np.zeros((2, n, self.hidden))
            driven = x @ p[f"{k}.x"] + p[f"{k}.b"]
            out, steps = np.empty((n, t, self.hidden)), []
            for s in range(t):
                i, f, g, o = np.split(driven[:, s] + h @ p[f"{k}.h"], 4, 1)
                i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
                before = (h, c)
                c = f * c + i * g
                h = o * np.tanh(c)
                steps.append((i, f, g, o, c, *before))
                out[:, s] = h
            saved.append((x, steps))
            x = out
        return (x.mean(1) if self.mean else x[:, -1]), saved

    def carried(self, p: Params, x: np.ndarray, state: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(last layer's outputs, hidden and cell state of each layer) of frames that follow those which ``state`` is of."""
        after = []
        for k in range(self.layers):
            n, t, _ = x.shape
            h, c = state[k] if state else np.zeros((2, n, self.hidden))
            driven, out = x @ p[f"{k}.x"] + p[f"{k}.b"], np.empty((n, t, self.hidden))
            for s in range(t):
                i, f, g, o = np.split(driven[:, s] + h @ p[f"{k}.h"], 4, 1)
                c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
                out[:, s] = h = _sigmoid(o) * np.tanh(c)
            after.append((h, c))
            x = out
        return x, after

    def embed(self, p: Params, x: np.ndarray) -> np.ndarray:
        """What ``forward`` gives, without what only training needs: frames go through in blocks that carry the state on."""
        total, state = np.zeros((len(x), self.hidden)), None
        for at in range(0, x.shape[1], BLOCK):
            out, state = self.carried(p, x[:, at : at + BLOCK], state)
            total += out.sum(1)
        return total / x.shape[1] if self.mean else out[:, -1]

    def backward(self, p: Params, saved: list, dy: np.ndarray) -> Params:
        grads: Params = {}
        t = saved[0][0].shape[1]
        dx = np.zeros((len(dy), t, self.hidden))
        if self.mean:
            dx += dy[:, None] / t
        else:
            dx[:, -1] = dy
        for k in reversed(range(self.layers)):
            x, steps = saved[k]
            dh, dc = np.zeros((2, len(dy), self.hidden))
            dz = np.empty((len(dy), t, 4 * self.hidden))
            for s in reversed(range(t)):
                i, f, g, o, c, h0, c0 = steps[s]
                dh = dh + dx[:, s]
                tc = np.tanh(c)
                dc = dc + dh * o * (1 - tc**2)
                dz[:, s] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g**2), dh * tc * o * (1 - o)], 1)
                dh, dc = dz[:, s] @ p[f"{k}.h"].T, dc * f
            grads[f"{k}.x"] = np.einsum("ntf,ntg->fg", x, dz)
            grads[f"{k}.h"] = sum(steps[s][5].T @ dz[:, s] for s in range(t))
            grads[f"{k}.b"] = dz.sum((0, 1))
            dx = dz @ p[f"{k}.x"].T
        return grads


@dataclass(frozen=True)
class Attention:
    """Sigmoid of a dense layer, self-attention layers one after another, frames weighed by a scalar,
    softmax over features, mean over time. Embeddings are non-negative and sum to one."""

    dim: int = 32
    layers: int = 2
    heads: int = 8

    def __post_init__(self) -> None:
        if self.layers < 1 or self.dim % self.heads:
            raise ValueError("one layer at least, and dim divisible by heads, are needed")

    @property
    def size(self) -> int:
        return self.dim

    def init(self, n_features: int, seed: int = 0) -> Params:
        rng = np.random.default_rng(seed)
        p = {"in.w": _lecun(rng, n_features, self.dim), "in.b": np.zeros(self.dim), "pool.w": _lecun(rng, self.dim, 1), "pool.b": np.zeros(1)}
        for k in range(self.layers):
            for name in "qkvo":
                p[f"{k}.{name}.w"], p[f"{k}.{name}.b"] = _lecun(rng, self.dim, self.dim), np.zeros(self.dim)
        return p

    def _split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(*x.shape[:2], self.heads, -1).transpose(0, 2, 1, 3)

    def forward(self, p: Params, x: np.ndarray) -> tuple[np.ndarray, list]:
        first = _sigmoid(x @ p["in.w"] + p["in.b"])
        saved, y = [(x, first)], first
        for k in range(self.layers):
            q, key, v = (self._split(y @ p[f"{k}.{n}.w"] + p[f"{k}.{n}.b"]) for n in "qkv")
            a = q @ key.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1])
            a = np.exp(a - a.max(-1, keepdims=True))
            a /= a.sum(-1, keepdims=True)
            mixed = (a @ v).transpose(0, 2, 1, 3).reshape(y.shape)
            saved.append((y, q, key, v, a, mixed))
            y = mixed @ p[f"{k}.o.w"] + p[f"{k}.o.b"]
        weight = y @ p["pool.w"] + p["pool.b"]
        z = weight * y
        s = np.exp(z - z.max(-1, keepdims=True))
        s /= s.sum(-1, keepdims=True)
        saved.append((y, weight, s))
        return s.mean(1), saved

    def _attended(self, q: np.ndarray, key: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Softmax-weighted values, query block by key block: maxima, sums and weighted values of the key blocks seen are put right as larger maxima come."""
        out, t = np.empty(q.shape), q.shape[2]
        for a in range(0, t, BLOCK):
            mine = q[:, :, a : a + BLOCK] / np.sqrt(q.shape[-1])
            most = np.full((*mine.shape[:3], 1), -np.inf)
            total, values = np.zeros(most.shape), np.zeros(mine.shape)
            for b in range(0, t, BLOCK):
                x = mine @ key[:, :, b : b + BLOCK].transpose(0, 1, 3, 2)
                more = np.maximum(most, x.max(-1, keepdims=True))
                x, kept = np.exp(x - more), np.exp(most - more)
                total = total * kept + x.sum(-1, keepdims=True)
                values, most = values * kept + x @ v[:, :, b : b + BLOCK], more
            out[:, :, a : a + BLOCK] = values / total
        return out

    def embed(self, p: Params, x: np.ndarray) -> np.ndarray:
        """What ``forward`` gives, in memory that grows with the frames and not with their square."""
        y = _sigmoid(x @ p["in.w"] + p["in.b"])
        for k in range(self.layers):
            mixed = self._attended(*(self._split(y @ p[f"{k}.{n}.w"] + p[f"{k}.{n}.b"]) for n in "qkv"))
            y = mixed.transpose(0, 2, 1, 3).reshape(y.shape) @ p[f"{k}.o.w"] + p[f"{k}.o.b"]
        z = (y @ p["pool.w"] + p["pool.b"]) * y
        s = np.exp(z - z.max(-1, keepdims=True))
        return (s / s.sum(-1, keepdims=True)).mean(1)

    def backward(self, p: Params, saved: list, dy: np.ndarray) -> Params:
        g: Params = {}
        y, weight, s = saved[-1]
        ds = np.broadcast_to(dy[:, None] / y.shape[1], s.shape)
        dz = s * (ds - (ds * s).sum(-1, keepdims=True))
        dw = (dz * y).sum(-1, keepdims=True)
        g["pool.w"], g["pool.b"] = np.einsum("ntd,nto->do", y, dw), dw.sum((0, 1))
        d = dz * weight + dw @ p["pool.w"].T
        for k in reversed(range(self.layers)):
            y, q, key, v, a, mixed = saved[k + 1]
            g[f"{k}.o.w"], g[f"{k}.o.b"] = np.einsum("ntd,nte->de", mixed, d), d.sum((0, 1))
            dm = self._split(d @ p[f"{k}.o.w"].T)
            da = dm @ v.transpose(0, 1, 3, 2)
            dv = a.transpose(0, 1, 3, 2) @ dm
            dl = a * (da - (da * a).sum(-1, keepdims=True)) / np.sqrt(q.shape[-1])
            parts = {"q": dl @ key, "k": dl.transpose(0, 1, 3, 2) @ q, "v": dv}
            d = np.zeros_like(y)
            for name, part in parts.items():
                flat = part.transpose(0, 2, 1, 3).reshape(y.shape)
                g[f"{k}.{name}.w"], g[f"{k}.{name}.b"] = np.einsum("ntd,nte->de", y, flat), flat.sum((0, 1))
                d += flat @ p[f"{k}.{name}.w"].T
        x, first = saved[0]
        d = d * first * (1 - first)
        g["in.w"], g["in.b"] = np.einsum("ntf,ntd->fd", x, d), d.sum((0, 1))
        return g


def cosine_triplet_loss(e: np.ndarray, alpha: float, epsilon: float = 1e-6) -> tuple[float, np.ndarray]:
    """(mean loss, gradient) of embeddings whose rows are a, p, n, a, p, n, ..."""
    a, p, n = e[0::3], e[1::3], e[2::3]

    def cos(x: np.ndarray, y: np.ndarray):
        nx, ny = np.linalg.norm(x, axis=1, keepdims=True), np.linalg.norm(y, axis=1, keepdims=True)
        d = nx * ny + epsilon
        c = (x * y).sum(1, keepdims=True) / d
        return c[:, 0], y / d - c * ny / d * x / np.maximum(nx, 1e-12), x / d - c * nx / d * y / np.maximum(ny, 1e-12)

    same, da1, dp = cos(a, p)
    other, da2, dn = cos(a, n)
    loss = np.maximum(other - same + alpha, 0)
    live = (loss > 0)[:, None] / len(a)
    grad = np.empty_like(e)
    grad[0::3], grad[1::3], grad[2::3] = live * (da2 - da1), -live * dp, live * dn
    return float(loss.mean()), grad
