"""Keep-first deduplication and coupled caps.

The caps of a stream of references are coupled: a row that one cap drops does not use up another. Per-file
caps are expressed as two windows, first the finer key, then, among the rows left, the coarser one; both
windows are partitioned by file, so one shuffle serves them. Groups of a window are bounded by the rows of one
file. The cap over all files is inherently a fold in path order; it runs on rows that the per-file caps have
already bounded, in one pass over candidate lists per file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut, written

PER_FILE, PER_KIND = 96, 64
PER_TARGET, PER_SOURCE, PER_BUILD = 20, 50, 5_000
"""Caps of file references per file and per file and kind; of references per target, file and build (fixed values)."""


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The least row of each key by ``order``; null key parts equal each other.

    A group by with min of a struct reduces where rows are read, so a key that holds a third of all rows does
    not gather them in one task, as a window would.
    """
    cols = [c for c in df.columns if c not in key]
    names = [f"_o{k}" for k in range(len(order))]
    tagged = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names, strict=True)])
    best = tagged.groupBy(*key).agg(F.min(F.struct(*names, *cols)).alias("_b"))
    return best.select(*[F.col(c) if c in key else F.col(f"_b.{c}").alias(c) for c in df.columns])


def coupled_caps(df: DataFrame, file: str, finer: str, per_finer: int, per_file: int, order: list[str]) -> DataFrame:
    """Rows kept when at most ``per_finer`` rows of a (file, finer) pair and ``per_file`` of a file are kept in order."""
    a = Window.partitionBy(file, finer).orderBy(*order)
    b = Window.partitionBy(file).orderBy(*order)
    first = df.withColumn("_rk", F.row_number().over(a)).filter(F.col("_rk") <= per_finer).drop("_rk")
    return first.withColumn("_rf", F.row_number().over(b)).filter(F.col("_rf") <= per_file).drop("_rf")


def file_reference_caps(refs: DataFrame) -> DataFrame:
    order = ["source_line", "source_col", "raw_target", "reference_kind", "confidence", "source"]
    return coupled_caps(refs, "source_path", "reference_kind", PER_KIND, PER_FILE, order)


def cap_warnings(refs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(source_path, reference_kind, kept, dropped, cap): rows dropped behind the file cap, and by the kind cap before it.

    The file cap closes a file at its 96th kept row; every later row counts against the file, earlier drops
    against their kind. reference_kind is null for the file's own warning.
    """
    order = order or ["source_line", "source_col", "raw_target", "reference_kind", "confidence", "source"]
    by_kind = Window.partitionBy("source_path", "reference_kind").orderBy(*order)
    by_file = Window.partitionBy("source_path").orderBy(*order)
    r = refs.select("source_path", "reference_kind", *[c for c in order if c != "reference_kind"]).withColumn("rk", F.row_number().over(by_kind))
    r = r.withColumn("passed", F.sum(F.when(F.col("rk") <= PER_KIND, 1).otherwise(0)).over(by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    passes = F.col("rk") <= PER_KIND
    before = F.col("passed") - F.when(passes, 1).otherwise(0)
    state = F.when(before >= PER_FILE, "file").when(~passes, "kind")
    dropped = r.withColumn("state", state).filter(F.col("state").isNotNull())
    kind = F.when(F.col("state") == "kind", F.col("reference_kind"))
    cap = F.when(F.col("state") == "file", PER_FILE).otherwise(PER_KIND)
    return dropped.groupBy("source_path", kind.alias("reference_kind"), cap.alias("cap")).agg(F.count(F.lit(1)).alias("dropped")).select("source_path", "reference_kind", F.col("cap").alias("kept"), "dropped", "cap")


REF_ORDER = ["from_line", "from_col", "to_name", "ref_kind", "source", "confidence", "evidence"]


def ref_caps_per_file(refs: DataFrame) -> DataFrame:
    """At most 20 references per target and file, then 50 per file."""
    return coupled_caps(refs, "from_path", "to_name", PER_TARGET, PER_SOURCE, REF_ORDER)


def ref_caps_global(refs: DataFrame, per_target: int = PER_TARGET, per_file: int = PER_SOURCE, total: int = PER_BUILD) -> DataFrame:
    """The cap over a whole build: 20 per target over all files, 50 per file, 5,000 in all, in path order.

    A row only counts when every cap lets it pass, so the fold needs the order of paths. Each (file, target)
    pair first keeps its 20 least rows, which changes nothing. The rest is written in ranges of paths. The fold
    takes one range after the other, each in one task; before a range, rows of targets that are full are filtered
    out, and ranges with no other rows are skipped. Every range that is taken keeps a row at least, so there are
    at most ``total`` of them; the driver holds only the counters of the kept rows.
    """
    pre = Window.partitionBy("from_path", "to_name").orderBy(*REF_ORDER)
    rows = refs.withColumn("_rk", F.row_number().over(pre)).filter(F.col("_rk") <= per_target).drop("_rk")
    blocks = written(rows.repartitionByRange("from_path").withColumn("_block", F.spark_partition_id()), "_block")
    cols, left, last = rows.columns, total, -1
    by_target: dict[str, int] = {}
    kept: list[DataFrame] = []

    def fold(have: dict[str, int], room: int):  # noqa: ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts, file, in_file, n = dict(have), None, 0, 0
            for b in batches:
                take = []
                for p, t in zip(b["from_path"], b["to_name"], strict=True):
                    if p != file:
                        file, in_file = p, 0
                    ok = n < room and in_file < per_file and counts.get(t, 0) < per_target
                    if ok:
                        n += 1
                        in_file += 1
                        counts[t] = counts.get(t, 0) + 1
                    take.append(ok)
                yield b[take]

        return run

    while left > 0:
        full = [t for t, n in by_target.items() if n >= per_target]
        ahead = blocks.filter(F.col("_block") > last)
        ahead = ahead.filter(~F.coalesce(F.col("to_name").isin(full), F.lit(False))) if full else ahead
        last = ahead.agg(F.min("_block")).first()[0]
        if last is None:
            break
        one = ahead.filter(F.col("_block") == last).select(*cols).repartition(1).sortWithinPartitions("from_path", *REF_ORDER)
        got = cut(one.mapInPandas(fold(by_target, left), rows.schema))
        for r in got.groupBy("to_name").count().collect():  # at most ``left`` targets
            by_target[r["to_name"]] = by_target.get(r["to_name"], 0) + r["count"]
            left -= r["count"]
        kept.append(got)
    return reduce(DataFrame.unionByName, kept) if kept else rows.limit(0)
