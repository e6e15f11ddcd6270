"""Snapshots of the six tables, the usage log, and benchmark and comparator inputs.

A snapshot is written table by table under ``snapshot=N`` and becomes current when a small pointer file is
moved over the old one, so readers see all tables of one build or of the one before. Tables are written in ranges
of their canonical order and sorted within them, so row groups are pruned by path and name statistics. The pointer
goes through pyarrow's file systems, so a snapshot may lie in any folder or URI that Spark writes to as well.
"""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.files import file_system, read_text

SCHEMA_VERSION = 12
TABLES = ("files", "records", "refs", "dependencies", "file_references", "semantic_facts")


ORDER = {
    "files": ("path",),
    "records": ("path", "line", "col", "kind", "name", "source"),
    "refs": ("from_path", "from_line", "from_col", "to_name", "ref_kind", "source"),
    "dependencies": ("from_path", "from_line", "from_col", "import_path", "dependency_kind", "lang", "source"),
    "file_references": ("source_path", "source_line", "source_col", "raw_target", "reference_kind", "source"),
    "semantic_facts": ("source_path", "source_line", "source_col", "kind", "symbol", "target_path"),
}
"""Canonical orders of the stored tables."""


def pointer(root: str) -> dict | None:
    text = read_text(root, "CURRENT.json")
    return json.loads(text) if text else None


def set_pointer(root: str, value: dict) -> None:
    own, base = file_system(root)
    own.create_dir(base, recursive=True)
    with own.open_output_stream(f"{base}/CURRENT.json.new") as f:
        f.write(json.dumps(value).encode())
    own.move(f"{base}/CURRENT.json.new", f"{base}/CURRENT.json")


def write_snapshot(root: str, tables: dict[str, DataFrame], updated_at: int) -> int:
    """Write all tables, sorted, as the next snapshot and make it current."""
    n = (pointer(root) or {"snapshot": 0})["snapshot"] + 1
    for name in TABLES:
        ordered = tables[name].repartitionByRange(*ORDER[name]).sortWithinPartitions(*ORDER[name])
        ordered.write.mode("overwrite").parquet(f"{root}/snapshot={n}/{name}")
    set_pointer(root, {"snapshot": n, "schema_version": SCHEMA_VERSION, "updated_at": updated_at})
    return n


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The current tables; None without a snapshot or with one of another schema version."""
    p = pointer(root)
    if p is None or p["schema_version"] != SCHEMA_VERSION:
        return None
    return {name: spark.read.parquet(f"{root}/snapshot={p['snapshot']}/{name}") for name in TABLES}


def counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {name: t.count() for name, t in tables.items()}


def append_usage(events: DataFrame, root: str) -> None:
    events.write.mode("append").parquet(f"{root}/usage_events")


def read_usage(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/usage_events")


def comparator_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a comparator's JSON lines: (path, line, column, kind, name, language)."""
    schema = "_type string, path string, name string, kind string, line int, column int, language string"
    raw = spark.read.schema(schema).json(path)
    ok = raw.filter((F.col("_type") == "tag") & F.col("path").isNotNull() & F.col("name").isNotNull() & F.col("kind").isNotNull())
    return ok.select(F.regexp_replace("path", r"^\./", "").alias("path"), F.coalesce("line", F.lit(0)).alias("line"), "column", "kind", "name", "language")


def benchmark_manifest(text: str) -> list[dict]:
    """Repositories of a benchmark manifest with their queries, expectations and thresholds."""
    known = ("expected_symbol", "expected_absent_symbol", "expected_symbol_pattern", "quality_threshold")
    return [{"name": r.get("name"), "path": r.get("path"), "queries": list(dict.fromkeys(r.get("queries", []))), "skip_reason": r.get("skip_reason")} | {k: r.get(k, []) for k in known} for r in tomllib.loads(text).get("repo", [])]


def expectations(spark: SparkSession, manifest: list[dict]) -> dict[str, DataFrame]:
    """Expected symbols, absent symbols, patterns and thresholds as tables."""
    rows = lambda key, cols: [(m["name"], *[x.get(c) for c in cols]) for m in manifest for x in m[key]]
    sym, pat, thr = ("language", "path", "kind", "name"), ("language", "path_glob", "kind", "name_regex", "min_count"), ("language", "min_records", "max_duplicate_locations", "max_malformed_records")
    ddl = "repo string, language string, path string, kind string, name string"
    return {
        "expected_symbol": spark.createDataFrame(rows("expected_symbol", sym), ddl),
        "expected_absent_symbol": spark.createDataFrame(rows("expected_absent_symbol", sym), ddl),
        "expected_symbol_pattern": spark.createDataFrame(rows("expected_symbol_pattern", pat), "repo string, language string, path_glob string, kind string, name_regex string, min_count int"),
        "quality_threshold": spark.createDataFrame(rows("quality_threshold", thr), "repo string, language string, min_records int, max_duplicate_locations int, max_malformed_records int"),
    }


def benchmark_queries(records: DataFrame, text: str | None = None, limit: int = 20) -> list[str]:
    """Queries of a list file without blanks and comments, else the first distinct names in order."""
    if text is not None:
        own = [ln.strip() for ln in text.splitlines() if ln.strip() and not ln.strip().startswith("#")]
        if own:
            return list(dict.fromkeys(own))
    return [r["name"] for r in records.filter(F.col("name") != "").select("name").distinct().orderBy("name").limit(limit).collect()]
