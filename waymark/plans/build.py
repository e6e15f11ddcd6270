"""The build: from a manifest with texts to the six tables, in full or for changed files only.

References are kept uncapped in the snapshot and capped when read, so an incremental build equals a full one
by construction.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import caps, extract, file_refs, manifest, resolve, symbols
from waymark.plans.context_queries import dedupe_records
from waymark.session import cut
from waymark.sources import files as tree
from waymark.sources import store

MAX_RECORDS_PER_FILE = 50_000
FACTS = "source_path string, source_line int, source_col int, kind string, symbol string, target_path string, target_line int, target_col int, detail string, confidence string, adapter string"

Adapter = Callable[[DataFrame, DataFrame], DataFrame | None]
"""(records, dependencies) -> facts, or None if unavailable."""


def records_of(texts: DataFrame) -> DataFrame:
    """Parsed symbols and line landmarks, one per place."""
    return dedupe_records(symbols.symbols(texts).unionByName(extract.line_landmarks(texts)))


def edges_of(texts: DataFrame, records: DataFrame, files: DataFrame, **packages: str | None) -> DataFrame:
    return resolve.resolve(resolve.edges_from_imports(records).unionByName(resolve.scanned_edges(texts)), files, **packages)


def file_refs_of(texts: DataFrame, deps: DataFrame, files: DataFrame) -> DataFrame:
    return file_refs.finalize(file_refs.from_dependencies(deps).unionByName(file_refs.resolve(extract.scan_file_references(texts), files)))


def refs_of(texts: DataFrame, records: DataFrame, deps: DataFrame) -> DataFrame:
    """All references, one per (place, name, kind); caps are applied on reading."""
    scanned = symbols.syntax_refs(texts).unionByName(extract.line_imports(texts)).unionByName(extract.text_references(texts, records)).unionByName(extract.structured_refs(texts))
    every = extract.enrich(scanned, records).unionByName(extract.refs_from_dependencies(deps, records))
    return caps.keep_first(every, ["from_path", "from_line", "from_col", "to_name", "ref_kind"], ["source", "to_kind", "confidence", "reason", "evidence"])


def facts_of(spark: SparkSession, records: DataFrame, deps: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Facts of all adapters; one that is unavailable or fails, while planning or running, is skipped. Blank
    confidence and adapter get defaults. Each adapter's rows are written once, so a failure stays with it."""
    out = spark.createDataFrame([], FACTS)
    for k, make in enumerate(adapters):
        try:
            got = make(records, deps)
            got = None if got is None else cut(got.select(*out.columns))
        except Exception:  # noqa: BLE001
            continue
        if got is not None:
            name = getattr(make, "__name__", f"adapter{k}")
            blank = lambda c, v: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", v).otherwise(F.col(c)).alias(c)
            out = out.unionByName(got.select(*[blank(c, "semantic") if c == "confidence" else blank(c, name) if c == "adapter" else F.col(c) for c in out.columns]))
    return finalize_facts(out)


def finalize_facts(facts: DataFrame) -> DataFrame:
    """One fact per (place, kind, symbol, target_path, adapter)."""
    key = ["source_path", "source_line", "source_col", "kind", "symbol", "target_path", "adapter"]
    return caps.keep_first(facts, key, ["target_line", "target_col", "confidence", "detail"])


def full(spark: SparkSession, files: DataFrame, adapters: list[Adapter] | None = None, **packages: str | None) -> dict[str, DataFrame]:
    """All tables of ``files(path, mtime_ns, size, text)``."""
    texts = files.filter(F.col("text").isNotNull()).select("path", "text")
    records = cut(records_of(texts))  # parsed once, read by every table
    deps = cut(edges_of(texts, records, files, **packages))
    return {
        "files": files.select("path", "mtime_ns", "size"),
        "records": records,
        "refs": refs_of(texts, records, deps),
        "dependencies": deps,
        "file_references": file_refs_of(texts, deps, files),
        "semantic_facts": facts_of(spark, records, deps, adapters or []),
    }


def incremental(spark: SparkSession, old: dict[str, DataFrame], files: DataFrame, adapters: list[Adapter] | None = None, read: Callable[[DataFrame], DataFrame] | None = None, **packages: str | None) -> dict[str, DataFrame]:
    """Tables after a change: only stale paths are parsed again; relations of untouched files are kept if they stay valid.

    ``files`` holds texts, or ``read`` gives the texts of listed files, so that untouched files are only read
    where relations of all files are needed again.
    """
    d = cut(manifest.diff(old["files"], files).filter(F.col("state") != "unchanged"))
    stale = d.select("path")
    changed = files.join(stale, "path", "left_semi")
    changed = cut(read(changed)) if read else changed
    texts = changed.filter(F.col("text").isNotNull()).select("path", "text")
    fresh = cut(records_of(texts))
    records = manifest.merge(old["records"], fresh, stale, "path")
    everything = not d.filter(manifest.needs_full(F.col("state"), F.col("path"))).isEmpty() or bool(adapters)
    all_texts = (read(files) if read else files).filter(F.col("text").isNotNull()).select("path", "text")
    if everything:
        deps = cut(edges_of(all_texts, records, files, **packages))
        frefs = file_refs_of(all_texts, deps, files)
    else:
        deps = cut(manifest.merge(old["dependencies"], edges_of(texts, fresh, files, **packages), stale, "from_path"))
        own = deps.join(stale.select(F.col("path").alias("from_path")), "from_path", "left_semi")
        frefs = manifest.merge(old["file_references"], file_refs_of(texts, own, files), stale, "source_path")
    if everything or not manifest.same_targets(manifest.target_keys(old["records"], stale), manifest.target_keys(fresh, stale)):
        refs = refs_of(all_texts, records, deps)
    else:
        own = deps.join(stale.select(F.col("path").alias("from_path")), "from_path", "left_semi")
        refs = manifest.merge(old["refs"], refs_of(texts, records, own), stale, "from_path")
    return {"files": files.select("path", "mtime_ns", "size"), "records": records, "refs": refs, "dependencies": deps, "file_references": frefs, "semantic_facts": facts_of(spark, records, deps, adapters or [])}


def too_many_records(records: DataFrame) -> DataFrame:
    """Paths over the record limit of a file; a build with any is refused."""
    return records.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_RECORDS_PER_FILE)


def build_index(spark: SparkSession, root: str, store_dir: str | None = None, adapters: list[Adapter] | None = None) -> dict:
    """Build or refresh the snapshot of a directory; returns what was done and the counts of the manifest diff."""
    store_dir = store_dir or f"{root}/.dev_index"
    meta = cut(tree.walk(spark, root))
    old = store.read_snapshot(spark, store_dir)
    if old is not None and not adapters and manifest.is_fresh(old["files"], meta):
        return {"built": False, "added": 0, "changed": 0, "deleted": 0}
    read = lambda some: tree.read_texts(spark, root, files=some)
    names = tree.package_names({p: tree.read_text(root, p) or "" for p in ("go.mod", "package.json", "pubspec.yaml")})
    states = {r["state"]: r["n"] for r in manifest.diff(old["files"], meta).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()} if old else {"added": meta.count()}
    tables = full(spark, read(meta), adapters, **names) if old is None else incremental(spark, old, meta, adapters, read, **names)
    if not too_many_records(tables["records"]).isEmpty():
        raise ValueError(f"a file has more than {MAX_RECORDS_PER_FILE} records")
    store.write_snapshot(store_dir, tables, int(time.time()))
    return {"built": True} | {k: states.get(k, 0) for k in ("added", "changed", "deleted")}


def ready(spark: SparkSession, root: str, store_dir: str | None = None) -> dict[str, DataFrame]:
    """The current tables, rebuilt once if anything changed."""
    build_index(spark, root, store_dir)
    tables = store.read_snapshot(spark, store_dir or f"{root}/.dev_index")
    assert tables is not None
    return tables


def capped(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as readers see them: reference caps per file and build, file reference caps."""
    return tables | {"refs": caps.ref_caps_global(caps.ref_caps_per_file(tables["refs"])), "file_references": caps.file_reference_caps(tables["file_references"])}
