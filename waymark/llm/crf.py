"""Linear-chain conditional random field over three labels, in numpy: training and batched Viterbi."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

O, B, I = 0, 1, 2  # noqa: E741
NEVER = -1e4


class Crf:
    """weights: feature -> three scores; trans: score of label pairs. I follows B or I only."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray) -> None:
        self.index, self.w, self.trans = index, weights, trans
        self.trans[O, I] = NEVER

    @classmethod
    def load(cls, path: Path) -> Crf:
        d = json.loads(path.read_text())
        names = list(d["weights"])
        return cls({n: i for i, n in enumerate(names)}, np.array([d["weights"][n] for n in names]), np.array(d["trans"]))

    def save(self, path: Path, least: float = 0.02) -> None:
        keep = {n: [round(float(x), 3) for x in self.w[i]] for n, i in sorted(self.index.items()) if np.abs(self.w[i]).max() >= least}
        path.write_text(json.dumps({"weights": keep, "trans": [[round(float(x), 3) for x in r] for r in self.trans]}, separators=(",", ":")))

    def score(self, features: list[str]) -> np.ndarray:
        at = [self.index[f] for f in features if f in self.index]
        return self.w[at].sum(0) if at else np.zeros(3)

    def viterbi(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each line; lines of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(emissions)
        order = sorted((i for i in range(len(emissions)) if len(emissions[i])), key=lambda i: len(emissions[i]))
        for s in range(0, len(order), 512):
            part = order[s : s + 512]
            n = np.array([len(emissions[i]) for i in part])
            e = np.zeros((n.max(), len(part), 3))
            for b, i in enumerate(part):
                e[: n[b], b] = emissions[i]
            best = e[0] + np.array([0.0, 0.0, NEVER])
            back = np.zeros((len(e), len(part), 3), np.int8)
            stay = np.arange(3, dtype=np.int8)
            for t in range(1, len(e)):
                cand = best[:, :, None] + self.trans
                arg = cand.argmax(1).astype(np.int8)
                new = np.take_along_axis(cand, arg[:, None, :], 1)[:, 0] + e[t]
                live = (t < n)[:, None]
                back[t] = np.where(live, arg, stay)
                best = np.where(live, new, best)
            lab = best.argmax(1)
            path = np.zeros((len(e), len(part)), np.int8)
            for t in range(len(e) - 1, -1, -1):
                path[t] = lab
                lab = back[t][np.arange(len(part)), lab]
            for b, i in enumerate(part):
                out[i] = path[: n[b], b]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(lines: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, seed: int = 3) -> Crf:
    """Maximum conditional likelihood by AdaGrad, one line at a time. lines: features per token, labels."""
    index: dict[str, int] = {}
    coded = []
    for feats, labels in lines:
        rows = [np.array([index.setdefault(f, len(index)) for f in fs]) for fs in feats]
        coded.append((rows, np.array(labels)))
    w, g2 = np.zeros((len(index), 3)), np.full((len(index), 3), 1e-6)
    trans, t2 = np.zeros((3, 3)), np.full((3, 3), 1e-6)
    trans[O, I] = NEVER
    rng = np.random.default_rng(seed)
    start = np.array([0.0, 0.0, NEVER])
    for _ in range(epochs):
        for k in rng.permutation(len(coded)):
            rows, y = coded[k]
            n = len(rows)
            if not n:
                continue
            e = np.array([w[r].sum(0) for r in rows])
            a, b = np.zeros((n, 3)), np.zeros((n, 3))
            a[0] = e[0] + start
            for t in range(1, n):
                a[t] = _logsum(a[t - 1][:, None] + trans, 0) + e[t]
            for t in range(n - 2, -1, -1):
                b[t] = _logsum(trans + (e[t + 1] + b[t + 1])[None, :], 1)
            z = _logsum(a[-1], 0)
            p = np.exp(a + b - z)
            gold = np.zeros((n, 3))
            gold[np.arange(n), y] = 1
            d = gold - p
            if np.abs(d).max() < 1e-3:
                continue
            for r, x in zip(rows, d, strict=True):
                g = x - decay * w[r]
                g2[r] += g * g
                w[r] += rate * g / np.sqrt(g2[r])
            if n > 1:
                pair = np.exp(a[:-1, :, None] + trans[None] + (e[1:] + b[1:])[:, None, :] - z).sum(0)
                seen = np.zeros((3, 3))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                g = seen - pair
                g[O, I] = 0
                t2 += g * g
                trans += rate * g / np.sqrt(t2)
                trans[O, I] = NEVER
    return Crf(index, w, trans)
