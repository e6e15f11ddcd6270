"""Frequency of every distinct value, by a global integer dictionary and blockwise count arrays.

Stages
1. ``places``: distinct (field, term, path, line, col), hashed over all five columns, so no value is hot.
2. ``blocks``: the places reduced to (field, term, path), then each block (a partition by path) is turned
   into counts per local identifier with numpy; a block holds a term once, however hot it is.
3. ``dictionary``: distinct (field, term) get dense global integers, range-partitioned and numbered inside
   each range; only one count per range is gathered for the offsets.
4. ``encode``: block counts get their identifiers; the arrays of each identifier range are added up.

Definitions: a term's occurrences are the distinct (path, line, col) that have it, its files the distinct
paths. A null term is no value; the empty string is one. A null path, line or col is a value of its own
place. Repeated rows change nothing; an empty table gives no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import cut

RANGE_BITS = 12
"""Identifiers per count array: 2**RANGE_BITS."""


def term_places(df: DataFrame, fields: list[str], place: list[str]) -> DataFrame:
    """Distinct (field, term, place columns) of the given string columns, long form."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("term")) for f in fields]))
    long = df.select(*place, pairs.alias("ft")).select(F.col("ft.field").alias("field"), F.col("ft.term").alias("term"), *place)
    return long.filter(F.col("term").isNotNull()).distinct()


def block_counts(places: DataFrame, file: str) -> DataFrame:
    """(field, term, occ, files) per block: the term's places and files among the block's files.

    A (term, file) pair is reduced to one row first, so it lies in one block and is counted once as present.
    """
    per_file = places.groupBy("field", "term", file).agg(F.count(F.lit(1)).alias("n"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local: dict[tuple[str, str], int] = {}
        occ = np.zeros(1024, np.int64)
        rec = np.zeros(1024, np.int64)
        for b in batches:
            ids = np.fromiter((local.setdefault(k, len(local)) for k in zip(b["field"], b["term"], strict=True)), np.int64, len(b))
            if len(local) > len(occ):
                size = max(2 * len(occ), len(local))
                occ, rec = np.concatenate([occ, np.zeros(size - len(occ), np.int64)]), np.concatenate([rec, np.zeros(size - len(rec), np.int64)])
            occ += np.bincount(ids, weights=b["n"].to_numpy(), minlength=len(occ)).astype(np.int64)
            rec += np.bincount(ids, minlength=len(rec))
            if len(local) >= 1 << 18:
                yield emit(local, occ, rec)
                local = {}
                occ[:] = 0
                rec[:] = 0
        if local:
            yield emit(local, occ, rec)

    def emit(local: dict, occ: np.ndarray, rec: np.ndarray) -> pd.DataFrame:
        keys = list(local)
        return pd.DataFrame({"field": [k[0] for k in keys], "term": [k[1] for k in keys], "occ": occ[: len(keys)], "files": rec[: len(keys)]})

    return per_file.select("field", "term", "n").mapInPandas(count, "field string, term string, occ long, files long")


def dictionary(terms: DataFrame) -> DataFrame:
    """Dense integers 0..n-1 for distinct (field, term), in (field, term) order within ranges.

    The numbered ranges are checkpointed, so a recomputed task cannot hand out other numbers.
    """
    ranged = terms.distinct().repartitionByRange("field", "term").sortWithinPartitions("field", "term")
    raw = cut(ranged.select("field", "term", F.monotonically_increasing_id().alias("m")))
    part, pos = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = raw.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # one row per range: the number of ranges is the number of shuffle partitions, not of terms
    offsets = sizes.selectExpr("part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset")
    return raw.select("field", "term", part.alias("part"), pos.alias("pos")).join(F.broadcast(offsets), "part").select("field", "term", (F.col("offset") + F.col("pos")).alias("id"))


def add_ranges(encoded: DataFrame) -> DataFrame:
    """Sum (id, occ, files) rows by identifier range with count arrays; one row per identifier."""
    width = 1 << RANGE_BITS
    schema = "range long, ids array<int>, occ array<long>, files array<long>"

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            ids = b["id"].to_numpy()
            order = np.argsort(ids >> RANGE_BITS, kind="stable")
            ids, o, f = ids[order], b["occ"].to_numpy()[order], b["files"].to_numpy()[order]
            ranges, starts = np.unique(ids >> RANGE_BITS, return_index=True)
            for r, s, e in zip(ranges.tolist(), starts, [*starts[1:], len(ids)], strict=True):
                a = held.setdefault(r, np.zeros((2, width), np.int64))
                local = ids[s:e] & (width - 1)
                a[0] += np.bincount(local, weights=o[s:e], minlength=width).astype(np.int64)
                a[1] += np.bincount(local, weights=f[s:e], minlength=width).astype(np.int64)
            if len(held) > 256:
                yield sparse(held)
                held = {}
        if held:
            yield sparse(held)

    def sparse(held: dict[int, np.ndarray]) -> pd.DataFrame:
        nz = {r: np.flatnonzero(a[0]) for r, a in held.items()}
        return pd.DataFrame({"range": list(held), "ids": [i.astype(np.int32) for i in nz.values()], "occ": [held[r][0][i] for r, i in nz.items()], "files": [held[r][1][i] for r, i in nz.items()]})

    def total(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((2, width), np.int64)
        for b in batches:
            for i, o, f in zip(b["ids"], b["occ"], b["files"], strict=True):
                a[0][i] += o
                a[1][i] += f
        i = np.flatnonzero(a[0])
        yield pd.DataFrame({"id": (int(key[0]) << RANGE_BITS) + i, "occurrences": a[0][i], "files": a[1][i]})

    block = encoded.mapInPandas(arrays, schema)
    return block.groupBy("range").applyInPandas(total, "id long, occurrences long, files long")


def frequencies(df: DataFrame, fields: list[str], file: str = "path", place: tuple[str, ...] = ("path", "line", "col"), common_one_in: int = 20, rare_below: int = 3) -> DataFrame:
    """(field, term, occurrences, files, mark): mark is common, rare or null.

    common: in more than 1/common_one_in of the distinct files of ``df``; else rare: fewer than rare_below
    occurrences.
    """
    blocks = cut(block_counts(term_places(df, fields, list(place)), file))
    words = dictionary(blocks.select("field", "term"))
    sums = add_ranges(blocks.join(words, ["field", "term"]).select("id", "occ", "files"))
    n_files = df.select(F.count_distinct(file)).scalar()
    return words.join(sums, "id").select("field", "term", "occurrences", "files", mark(F.col("occurrences"), F.col("files"), n_files, common_one_in, rare_below).alias("mark"))


def mark(occurrences: Column, files: Column, n_files: Column, common_one_in: int, rare_below: int) -> Column:
    return F.when(files * common_one_in > n_files, "common").when(occurrences < rare_below, "rare")
