"""Train the byte network: ``python -m waymark.llm.train_langid FOLDER`` writes langid.npz.

The sample is at most TRAIN_DOCUMENTS labelled documents, those least by the hash of their ids. Labels are
noisy, so a sentence (digits masked) gets the label most of its documents have; after a first stage, sentences
that the network contradicts are dropped. Held-out documents (id hash) are never trained on, and no other table
is read. STEPS and the seeds fix the result.
"""

from __future__ import annotations

import sys
import time
import unicodedata
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq

from waymark.llm.bigru import Adam, BiGRU
from waymark.llm.langid import LANGS, WEIGHTS, Labeller, label_code, sentences, to_bytes, weight

TRAIN_DOCUMENTS = 10_000
STEPS = 6_500
HIDDEN = 32
LENGTH, BATCH = 128, 96
COUNTS: dict[str, int] = {}
"""Documents per sentence; a sentence is drawn in proportion to the root of its count."""


def held_out(doc_id: int) -> bool:
    return crc32(str(doc_id).encode()) % 10 == 0


def mask(s: str) -> str:
    return "".join("0" if c.isdigit() else c for c in s.lower())


def sample(folder: str) -> dict[str, list[str]]:
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    t = sorted((r for r in t if r["text"] and label_code(r["lang"]) in LANGS), key=lambda r: (crc32(f"sample {r['doc_id']}".encode()), r["doc_id"]))[:TRAIN_DOCUMENTS]
    votes: dict[str, Counter] = defaultdict(Counter)
    one: dict[str, str] = {}
    for r in t:
        code = label_code(r["lang"])
        if not held_out(r["doc_id"]):
            for s in sentences(r["text"]):
                if weight(s) >= 8:
                    votes[mask(s)][code] += 1
                    one.setdefault(mask(s), s)
    by: dict[str, list[str]] = {c: [] for c in LANGS}
    COUNTS.clear()
    for m, v in votes.items():
        (code, n), total = v.most_common(1)[0], sum(v.values())
        if n * 10 >= 6 * total:
            by[code].append(one[m])
            COUNTS[one[m]] = n
    return by


def invented(rng: np.random.Generator) -> str:
    """A name of random syllables, which tells no language."""
    return "".join("bcdfghjklmnprstvz"[int(rng.integers(17))] + "aeiou"[int(rng.integers(5))] + ("" if rng.random() < 0.6 else "lnrs"[int(rng.integers(4))]) for _ in range(int(rng.integers(2, 5))))


def damaged(s: str, rng: np.random.Generator) -> str:
    r = rng.random()
    if rng.random() < 0.25:
        ws = s.split(" ")
        if len(ws) > 4:
            for _ in range(1 + len(ws) // 8):
                ws.insert(int(rng.integers(len(ws) + 1)), invented(rng))
            s = " ".join(ws)
    if r < 0.3:
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    if rng.random() < 0.08:
        s = "".join(c for c in s if c.isalnum() or c == " ")
    return s


def roots(by: dict[str, list[str]]) -> dict[str, np.ndarray]:
    return {c: np.cumsum([COUNTS.get(s, 1) ** 0.5 for s in ss]) for c, ss in by.items()}


def batch(by: dict[str, list[str]], weights: dict[str, np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = np.zeros((LENGTH, BATCH), np.uint8), np.full((LENGTH, BATCH), -1, np.int64)
    n = np.full(BATCH, LENGTH)
    for b in range(BATCH):
        raw, lab, lang = b"", [], int(rng.integers(len(LANGS)))
        alone = rng.random() < 0.75
        while len(raw) < (1 if alone else LENGTH):
            if rng.random() < 0.25:
                lang = int(rng.integers(len(LANGS)))
            own, cum = by[LANGS[lang]], weights[LANGS[lang]]
            one = to_bytes(damaged(own[int(np.searchsorted(cum, rng.random() * cum[-1]))], rng)) + b" "
            raw += one
            lab += [lang] * len(one)
        at = int(rng.integers(0, max(0, len(raw) - LENGTH) + 1)) if rng.random() < 0.3 else 0
        n[b] = m = min(LENGTH, len(raw) - at)
        x[:m, b], y[:m, b] = np.frombuffer(raw[at : at + m], np.uint8), lab[at : at + m]
    return x, n, y


def main(folder: str) -> None:
    rng = np.random.default_rng(7)
    by = sample(folder)
    print({k: len(v) for k, v in by.items()})
    net = BiGRU.fresh(len(LANGS), hidden=HIDDEN)
    opt, began, loss = Adam(net.p, 4e-3), time.time(), 0.0
    weights = roots(by)
    for k in range(STEPS):
        past = k / STEPS
        if k == STEPS * 35 // 100:
            lab = Labeller(net.p)
            for code in LANGS:
                done = lab.documents(by[code])
                kept = [s for s, (m, c, _) in zip(by[code], done, strict=True) if m == code or (c or 0) < 0.7]
                print(code, len(by[code]), "->", len(kept))
                by[code] = kept
            weights = roots(by)
        x, n, y = batch(by, weights, rng)
        now, grads = net.step(x, n, y)
        loss = 0.98 * loss + 0.02 * now if k else now
        opt.update(grads, 4e-3 * (1 - past) + 1e-4)
        if k % 200 == 0:
            print(k, round(loss, 4), round(time.time() - began), flush=True)
    np.savez_compressed(WEIGHTS, **net.p)


if __name__ == "__main__":
    main(sys.argv[1])
