"""Manifest diff, freshness and incremental merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.paths import basename

RESOLVER_FILES = ("go.mod", "package.json", "pubspec.yaml")
"""Files whose change re-resolves every edge (fixed values)."""


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): added, changed, deleted or unchanged by (mtime_ns, size). Paths are unique on each side."""
    o = old.select("path", F.struct("mtime_ns", "size").alias("o"))
    n = new.select("path", F.struct("mtime_ns", "size").alias("n"))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", state.alias("state"))


def is_fresh(old: DataFrame, new: DataFrame) -> bool:
    """No path, time or size differs; reads metadata only and stops at the first difference."""
    return diff(old, new).filter(F.col("state") != "unchanged").isEmpty()


def without(df: DataFrame, stale: DataFrame, path: str) -> DataFrame:
    """Rows whose path is not stale."""
    return df.join(stale.select(F.col("path").alias(path)), path, "left_anti")


def merge(old: DataFrame, fresh: DataFrame, stale: DataFrame, path: str) -> DataFrame:
    """Rows of untouched paths and recomputed rows of stale ones."""
    return without(old, stale, path).select(fresh.columns).unionByName(fresh)


def target_keys(records: DataFrame, stale: DataFrame) -> DataFrame:
    """Distinct (kind, name) of records of stale paths: what other files may refer to."""
    return records.join(stale.select("path"), "path", "left_semi").select("kind", "name").distinct()


def same_targets(before: DataFrame, after: DataFrame) -> bool:
    """Both sets of target keys are equal: references of untouched files stay valid."""
    return before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def needs_full(state: Column, path: Column) -> Column:
    """Rows that force a full rebuild of relations: added or deleted paths, and changed resolver files."""
    return state.isin("added", "deleted") | ((state == "changed") & basename(path).isin(*RESOLVER_FILES))


def caps_may_bite(refs: DataFrame, file_refs: DataFrame, total: int = 5_000, per_file: int = 96, per_kind: int = 64) -> DataFrame:
    """One row (refs_full, files_full, kinds_full): whether a cap may have cut rows."""
    n = refs.agg((F.count(F.lit(1)) >= total).alias("refs_full"))
    by_kind = file_refs.groupBy("source_path", "reference_kind").agg(F.count(F.lit(1)).alias("n"))
    by_file = by_kind.groupBy("source_path").agg(F.sum("n").alias("f"), F.max("n").alias("k"))
    most = by_file.agg(F.coalesce(F.max("f") >= per_file, F.lit(False)).alias("files_full"), F.coalesce(F.max("k") >= per_kind, F.lit(False)).alias("kinds_full"))
    return n.select("refs_full", most.select("files_full").scalar().alias("files_full"), most.select("kinds_full").scalar().alias("kinds_full"))
