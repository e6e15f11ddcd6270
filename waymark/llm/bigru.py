"""Bidirectional gated recurrent network over bytes, in numpy, with backpropagation through time."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return (np.tanh(x * F32(0.5)) + F32(1)) * F32(0.5)


class GRU:
    """One direction. Input projections of the 256 byte embeddings are looked up, not multiplied anew."""

    def __init__(self, params: dict[str, np.ndarray], prefix: str) -> None:
        self.p, self.k = params, prefix
        self.h = params[f"{prefix}U"].shape[0]

    @staticmethod
    def init(rng: np.random.Generator, prefix: str, embed: int, hidden: int) -> dict[str, np.ndarray]:
        return {
            f"{prefix}W": (rng.normal(size=(embed, 3 * hidden)) / np.sqrt(embed)).astype(F32),
            f"{prefix}U": np.concatenate([np.linalg.qr(rng.normal(size=(hidden, hidden)))[0] for _ in range(3)], 1).astype(F32),
            f"{prefix}b": np.zeros(3 * hidden, F32),
            f"{prefix}c": np.zeros(hidden, F32),
        }

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: bytes (T, B). Hidden states (T, B, H); the gates too if they are kept for the way back."""
        p, k, h = self.p, self.k, self.h
        table = p["E"] @ p[f"{k}W"] + p[f"{k}b"]
        u, c = p[f"{k}U"], p[f"{k}c"]
        t_n, b_n = x.shape
        out = np.empty((t_n, b_n, h), F32)
        s = np.zeros((b_n, h), F32)
        tape = []
        for t in range(t_n):
            a = table[x[t]]
            g = s @ u
            zr = sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            gc = g[:, 2 * h :] + c
            n = np.tanh(a[:, 2 * h :] + r * gc)
            new = n + z * (s - n)
            if keep:
                tape.append((s, z, r, n, gc))
            s = new
            out[t] = s
        return out, tape

    def states(self, x: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """Hidden states without the tape; with row lengths, from each row's end to its start."""
        p, k, h = self.p, self.k, self.h
        table = p["E"] @ p[f"{k}W"] + p[f"{k}b"]
        table[:, : 2 * h] *= F32(0.5)
        u = p[f"{k}U"].copy()
        u[:, : 2 * h] *= F32(0.5)
        c = p[f"{k}c"]
        t_n, b_n = x.shape
        out = np.empty((t_n, b_n, h), F32)
        s, last = np.zeros((b_n, h), F32), t_n if n is None else int(n.min())
        for t in range(t_n) if n is None else range(t_n - 1, -1, -1):
            a = table[x[t]]
            g = s @ u
            zr = g[:, : 2 * h]
            zr += a[:, : 2 * h]
            np.tanh(zr, out=zr)
            zr *= F32(0.5)
            zr += F32(0.5)
            m = g[:, 2 * h :]
            m += c
            m *= zr[:, h:]
            m += a[:, 2 * h :]
            np.tanh(m, out=m)
            new = out[t]
            np.subtract(s, m, out=new)
            new *= zr[:, :h]
            new += m
            if n is not None and t >= last:
                new *= (t < n)[:, None]
            s = new
        return out

    def backward(self, x: np.ndarray, tape: list, d_out: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        p, k, h = self.p, self.k, self.h
        u = p[f"{k}U"]
        d_table = np.zeros((256, 3 * h), F32)
        d_u, d_c = np.zeros_like(u), np.zeros(h, F32)
        ds = np.zeros_like(d_out[0])
        for t in range(len(tape) - 1, -1, -1):
            s, z, r, n, gc = tape[t]
            ds = ds + d_out[t]
            dn = ds * (1 - z) * (1 - n * n)
            dz = ds * (s - n) * z * (1 - z)
            dr = dn * gc * r * (1 - r)
            d_gc = dn * r
            da = np.concatenate([dz, dr, dn], 1)
            dg = np.concatenate([dz, dr, d_gc], 1)
            np.add.at(d_table, x[t], da)
            d_u += s.T @ dg
            d_c += d_gc.sum(0)
            ds = ds * z + dg @ u.T
        grads[f"{k}W"] = p["E"].T @ d_table
        grads[f"{k}b"] = d_table.sum(0)
        grads[f"{k}U"], grads[f"{k}c"] = d_u, d_c
        grads["E"] = grads.get("E", 0) + d_table @ p[f"{k}W"].T


class BiGRU:
    """Bytes (T, B) to class log-probabilities of every position."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = {k: np.asarray(v, F32) for k, v in params.items()}
        self.fw, self.bw = GRU(self.p, "f"), GRU(self.p, "b")

    @classmethod
    def fresh(cls, classes: int, embed: int = 16, hidden: int = 48, seed: int = 1) -> BiGRU:
        rng = np.random.default_rng(seed)
        p = {"E": rng.normal(size=(256, embed)).astype(F32) * F32(0.5)}
        p |= GRU.init(rng, "f", embed, hidden) | GRU.init(rng, "b", embed, hidden)
        p |= {"V": (rng.normal(size=(2 * hidden, classes)) / np.sqrt(2 * hidden)).astype(F32), "v": np.zeros(classes, F32)}
        return cls(p)

    @staticmethod
    def flip(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Reverse each column's first n[b] entries; the padding stays behind."""
        t = np.arange(x.shape[0])[:, None]
        at = np.where(t < n[None, :], n[None, :] - 1 - t, t)
        return np.take_along_axis(x, at if x.ndim == 2 else at[:, :, None], 0)

    def log_probs(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = self.fw.h
        y = self.fw.states(x) @ self.p["V"][:h]
        y += self.bw.states(x, n) @ self.p["V"][h:]
        y += self.p["v"]
        y -= y.max(2, keepdims=True)
        y -= np.log(np.exp(y).sum(2, keepdims=True))
        return y

    def step(self, x: np.ndarray, n: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients; target -1 marks positions that count for nothing."""
        f, tape_f = self.fw.forward(x, True)
        xr = self.flip(x, n)
        b, tape_b = self.bw.forward(xr, True)
        h = np.concatenate([f, self.flip(b, n)], 2)
        y = h @ self.p["V"] + self.p["v"]
        y -= y.max(2, keepdims=True)
        lp = y - np.log(np.exp(y).sum(2, keepdims=True))
        on = target >= 0
        count = max(1, on.sum())
        pick = np.take_along_axis(lp, np.maximum(target, 0)[:, :, None], 2)[:, :, 0]
        loss = -(pick * on).sum() / count
        dy = np.exp(lp)
        np.put_along_axis(dy, np.maximum(target, 0)[:, :, None], np.take_along_axis(dy, np.maximum(target, 0)[:, :, None], 2) - 1, 2)
        dy *= (on / F32(count))[:, :, None]
        flat = h.reshape(-1, h.shape[2])
        grads = {"V": flat.T @ dy.reshape(-1, dy.shape[2]), "v": dy.sum((0, 1))}
        dh = dy @ self.p["V"].T
        hid = self.fw.h
        self.fw.backward(x, tape_f, dh[:, :, :hid], grads)
        self.bw.backward(xr, tape_b, self.flip(np.ascontiguousarray(dh[:, :, hid:]), n), grads)
        return float(loss), grads


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * F32(scale)
            self.m[k] = F32(0.9) * self.m[k] + F32(0.1) * g
            self.v[k] = F32(0.999) * self.v[k] + F32(0.001) * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.p[k] -= (F32(rate or self.rate) * m / (np.sqrt(v) + F32(1e-8))).astype(F32)
