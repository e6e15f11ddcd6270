"""Queries: manifest diff, freshness, incremental merge, built tables, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import manifest
from waymark.plans import build
from waymark.plans.context_queries import tables as context_tables
from waymark.registry import Registry, table
from waymark.sources import files as tree

MANIFESTS = """o AS (SELECT path, min({'m': mtime_ns, 's': size}) AS o FROM files GROUP BY path),
  n AS (SELECT f.path, max({'m': mtime_ns, 's': size}) AS n FROM files f WHERE f.path IN (SELECT path FROM source_files WHERE text IS NOT NULL) GROUP BY f.path)"""


def manifests(spark, d):  # noqa: ANN001, ANN201
    """Oldest copy of every path, and the newest copy of those whose text was kept."""
    f = table(spark, d, "files")
    one = lambda agg: f.groupBy("path").agg(agg(F.struct("mtime_ns", "size")).alias("m")).select("path", "m.*")
    kept = table(spark, d, "source_files").filter(F.col("text").isNotNull()).select("path").distinct()
    return one(F.min), one(F.max).join(kept, "path", "left_semi")


def register(reg: Registry) -> None:
    diff_sql = f"WITH {MANIFESTS}, j AS (SELECT path, o, n, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'deleted' WHEN o = n THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n USING (path))"

    @reg.query("manifest_diff", diff_sql + " SELECT path, state FROM j")
    def manifest_diff(spark, d):
        return manifest.diff(*manifests(spark, d))

    @reg.query("manifest_states", diff_sql + " SELECT state, count(*) AS n, count(*) FILTER (state IN ('added', 'deleted')) AS forcing FROM j GROUP BY state")
    def manifest_states(spark, d):
        m = manifest.diff(*manifests(spark, d))
        return m.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(manifest.needs_full(F.col("state"), F.col("path"))).alias("forcing"))

    @reg.query("stale_target_keys", diff_sql + " SELECT DISTINCT kind, name FROM records WHERE path IN (SELECT path FROM j WHERE state <> 'unchanged')")
    def stale_target_keys(spark, d):
        stale = manifest.diff(*manifests(spark, d)).filter(F.col("state") != "unchanged")
        return manifest.target_keys(table(spark, d, "records"), stale)

    @reg.query("untouched_records", diff_sql + " SELECT * FROM records WHERE path NOT IN (SELECT path FROM j WHERE state <> 'unchanged')")
    def untouched_records(spark, d):
        return manifest.without(table(spark, d, "records"), manifest.diff(*manifests(spark, d)).filter(F.col("state") != "unchanged"), "path")

    @reg.query("incremental_merge")
    def incremental_merge(spark, d):
        """Stored records of untouched paths and records parsed again for stale paths that still have a text."""
        stale = manifest.diff(*manifests(spark, d)).filter(F.col("state") != "unchanged").select("path")
        texts = table(spark, d, "source_files").filter(F.col("text").isNotNull()).select("path", "text").join(stale, "path", "left_semi")
        return manifest.merge(table(spark, d, "records"), build.records_of(texts), stale, "path")

    @reg.query("built_records")
    def built_records(spark, d):
        return build.records_of(table(spark, d, "source_files").select("path", "text"))

    def files_with_text(spark, d):  # noqa: ANN001, ANN202
        newest = table(spark, d, "files").groupBy("path").agg(F.max(F.struct("mtime_ns", "size")).alias("m")).select("path", "m.*")
        return newest.join(table(spark, d, "source_files").select("path", "text"), "path", "left")

    @reg.query("built_references")
    def built_references(spark, d):
        return build.full(spark, files_with_text(spark, d))["refs"]

    @reg.query("built_file_references")
    def built_file_references(spark, d):
        return build.full(spark, files_with_text(spark, d))["file_references"]

    @reg.query(
        "size_policy",
        "WITH f AS (SELECT path, max({'m': mtime_ns, 's': size}).s AS size FROM files GROUP BY path) SELECT path, size, (CASE WHEN size > 2097152 THEN 2097152 ELSE 524288 END)::BIGINT AS threshold, CASE WHEN size > 2097152 THEN 'Skipped' ELSE 'Indexed' END AS action FROM f WHERE size >= 524288 ORDER BY size DESC, path LIMIT 20",
    )
    def size_policy(spark, d):
        f = table(spark, d, "files").groupBy("path").agg(F.max(F.struct("mtime_ns", "size")).alias("m")).select("path", "m.*")
        return tree.size_warnings(f)

    @reg.query("total_bytes", "WITH f AS (SELECT path, max({'m': mtime_ns, 's': size}).s AS size FROM files GROUP BY path) SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM f")
    def total_bytes(spark, d):
        return table(spark, d, "files").groupBy("path").agg(F.max_by("size", F.struct("mtime_ns", "size")).alias("size")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))

    @reg.query(
        "caps_may_bite",
        """WITH fr AS (SELECT DISTINCT from_path, import_path, CASE WHEN contains(dependency_kind, 'include') THEN 'include' WHEN contains(dependency_kind, 'export') THEN 'export' WHEN contains(dependency_kind, 'require') THEN 'require' WHEN contains(dependency_kind, 'source') THEN 'source' ELSE 'import' END AS k
          FROM dependencies WHERE unresolved_reason IS NULL OR unresolved_reason NOT IN ('external_package', 'system_include')), c AS (SELECT from_path, k, count(*) AS n FROM fr GROUP BY 1, 2), f AS (SELECT from_path, sum(n) AS f, max(n) AS m FROM c GROUP BY 1)
        SELECT (SELECT count(*) FROM refs) >= 5000 AS refs_full, coalesce(max(f) >= 96, false) AS files_full, coalesce(max(m) >= 64, false) AS kinds_full FROM f""",
    )
    def caps_may_bite(spark, d):
        return manifest.caps_may_bite(table(spark, d, "refs"), context_tables(spark, d).file_references)

    counts = [("by_kind", "reference_kind"), ("by_reason", "unresolved_reason")]
    fr = "fr AS (SELECT DISTINCT ON (from_path, import_path, k) from_path, k AS reference_kind, unresolved_reason FROM (SELECT *, CASE WHEN contains(dependency_kind, 'include') THEN 'include' WHEN contains(dependency_kind, 'export') THEN 'export' WHEN contains(dependency_kind, 'require') THEN 'require' WHEN contains(dependency_kind, 'source') THEN 'source' ELSE 'import' END AS k, CASE confidence WHEN 'resolved' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'unresolved' THEN 2 ELSE 3 END AS cr FROM dependencies WHERE unresolved_reason IS NULL OR unresolved_reason NOT IN ('external_package', 'system_include')) ORDER BY from_path, import_path, k, from_line, from_col, cr, target_path NULLS FIRST, lang, confidence, unresolved_reason NULLS FIRST)"
    for name, col in counts:
        where = "" if name == "by_kind" else " WHERE unresolved_reason IS NOT NULL"
        reg.query(f"file_references_{name}", f"WITH {fr} SELECT {col}, count(*) AS n FROM fr{where} GROUP BY 1")(
            lambda spark, d, col=col, name=name: context_tables(spark, d).file_references.filter(F.lit(True) if name == "by_kind" else F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        )

    @reg.query("top_file_reference_sources", f"WITH {fr} SELECT from_path AS source_path, count(*) AS n FROM fr GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
    def top_file_reference_sources(spark, d):
        return context_tables(spark, d).file_references.groupBy("source_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_path").limit(10)
