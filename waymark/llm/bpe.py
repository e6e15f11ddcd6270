"""Encoding of texts with a public byte-level BPE vocabulary, by a pair occurrence index.

The texts of an Arrow batch are cut into pieces by the vocabulary's split pattern. The distinct pieces that
the task has not met before are laid into one linked list of byte tokens. An index maps each adjacent pair
that has a rank to all its positions in the batch; a heap holds the active ranks. The lowest active rank is
applied at all its positions from left to right, and only the pairs next to a merged position enter the
index again. Since a piece is never merged across its borders and the lowest rank goes first, every piece
ends with the ids that merging it alone would give.

Defined results: a null text and an empty text give an empty list; text that looks like a special token is
ordinary text; repeated texts give repeated rows; lone surrogates cannot occur in Spark strings. Texts of
any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
"""Split pattern of the byte-level vocabulary (fixed value)."""

CACHE_PIECES = 1 << 17
"""Pieces whose ids a task keeps between batches; the memory is emptied at this size, results do not change."""


def default_vocabulary() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class PairIndexEncoder:
    """Encodes batches of texts; one per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT) -> None:
        import regex

        self.split = regex.compile(pattern)
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.done: dict[str, list[int]] = {}

    def rank_of(self, left: int, right: int) -> int:
        """Rank of the merged pair, or -1."""
        r = self.pair_rank.get((left, right))
        if r is None:
            r = self.pair_rank[(left, right)] = self.ranks.get(self.token[left] + self.token[right], -1)
        return r

    def merge(self, pieces: list[str]) -> None:
        """Fill ``done`` for new pieces."""
        ids: list[int] = []
        last: list[bool] = []  # position ends its piece
        spans: list[tuple[str, int, int]] = []
        for p in pieces:
            raw = p.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.done[p] = [whole]
                continue
            start = len(ids)
            ids.extend(self.byte_id[b] for b in raw)
            last.extend([False] * (len(raw) - 1) + [True])
            spans.append((p, start, len(ids)))
        n = len(ids)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        for _, s, e in spans:
            nxt[e - 1], prv[s] = -1, -1
        index: dict[int, list[int]] = {}
        for i in range(n):
            if not last[i]:
                r = self.rank_of(ids[i], ids[i + 1])
                if r >= 0:
                    index.setdefault(r, []).append(i)
        active = list(index)
        heapq.heapify(active)
        alive = [True] * n
        while active:
            r = heapq.heappop(active)
            at = index.pop(r, None)
            if at is None:
                continue
            at.sort()
            for i in at:
                j = nxt[i]
                if not alive[i] or j < 0 or self.rank_of(ids[i], ids[j]) != r:
                    continue
                ids[i] = r
                alive[j] = False
                k = nxt[j]
                nxt[i] = k
                if k >= 0:
                    prv[k] = i
                    q = self.rank_of(r, ids[k])
                    if q >= 0:
                        if q not in index:
                            index[q] = []
                            heapq.heappush(active, q)
                        index[q].append(i)
                h = prv[i]
                if h >= 0:
                    q = self.rank_of(ids[h], r)
                    if q >= 0:
                        if q not in index:
                            index[q] = []
                            heapq.heappush(active, q)
                        index[q].append(h)
        for p, s, e in spans:
            self.done[p] = [ids[i] for i in range(s, e) if alive[i]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each text."""
        if len(self.done) > CACHE_PIECES:
            self.done.clear()
        cut = [self.split.findall(t) if t else [] for t in texts]
        new = {p for ps in cut for p in ps if p not in self.done}
        if new:
            self.merge(list(new))
        flat: list[int] = []
        offsets = np.zeros(len(texts) + 1, np.int32)
        done = self.done
        for k, ps in enumerate(cut):
            for p in ps:
                flat += done[p]
            offsets[k + 1] = len(flat)
        return np.asarray(flat, np.int32), offsets


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) of every row; the vocabulary (under 1 MB, fixed) is sent to the executors once."""
    spark = df.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PairIndexEncoder(read_ranks(raw.value))
        for b in batches:
            flat, offsets = enc.encode(b.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
