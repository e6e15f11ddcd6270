"""File references: from dependency edges, from text scans, and their resolution against the known paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import paths
from waymark.functions.ranks import file_reference_confidence_rank
from waymark.functions.text import ascii_lower, compact, truncate, utrim
from waymark.operators.caps import keep_first

# Extensions and index files tried for a target without extension (fixed values).
COMMON_EXTENSIONS = (
    "rs py js jsx ts tsx mjs cjs json toml yaml yml md markdown html htm css scss sass png jpg jpeg svg gif webp ico sh bash rb php go h hpp hh c cc cpp cs java kt swift dart resx config settings sln csproj props targets xml"
).split()
DIRECTORY_INDEXES = "index.rs mod.rs __init__.py index.py index.js index.jsx index.ts index.tsx index.mjs index.cjs index.html README.md readme.md".split()
ASSET_EXTENSIONS = tuple("png jpg jpeg svg gif webp ico avif bmp woff woff2 ttf otf mp4 webm mp3 wav".split())
PROJECT_EXTENSIONS = ("csproj", "vbproj", "fsproj", "props", "targets")
BUILD_FILES = ("package.json", "Cargo.toml", "pyproject.toml", "tsconfig.json", "composer.json", "pubspec.yaml", "pubspec.yml", "Makefile", "makefile", "Justfile", "justfile")

COLUMNS = ("source_path", "source_line", "source_col", "raw_target", "target_path", "reference_kind", "lang", "confidence", "unresolved_reason", "evidence", "source")


def ext_low(path: Column) -> Column:
    return F.coalesce(ascii_lower(paths.extension(path)), F.lit(""))


def kind_from_dependency(kind: Column) -> Column:
    return F.when(kind.contains("include"), "include").when(kind.contains("export"), "export").when(kind.contains("require"), "require").when(kind.contains("source"), "source").otherwise("import")


def from_dependencies(deps: DataFrame) -> DataFrame:
    """File references of dependency edges, without external packages and system includes."""
    kept = deps.filter(F.col("unresolved_reason").isNull() | ~F.col("unresolved_reason").isin("external_package", "system_include"))
    return kept.select(
        F.col("from_path").alias("source_path"),
        F.col("from_line").alias("source_line"),
        F.col("from_col").alias("source_col"),
        F.col("import_path").alias("raw_target"),
        "target_path",
        kind_from_dependency(F.col("dependency_kind")).alias("reference_kind"),
        "lang",
        "confidence",
        "unresolved_reason",
        truncate(compact(F.col("evidence"))).alias("evidence"),
        F.lit("dependency_graph").alias("source"),
    )


def finalize(refs: DataFrame) -> DataFrame:
    """Keep-first by (source_path, raw_target, reference_kind) in storage order."""
    order = ["source_line", "source_col", file_reference_confidence_rank(F.col("confidence")), "source", "target_path"]
    return keep_first(refs.select(*COLUMNS), ["source_path", "raw_target", "reference_kind"], order)


# targets
def is_template(c: Column) -> Column:
    return c.rlike(r"\{\{|\}\}|\{%|%\}|\$\(|\$\{|^\$|\{ | \}")


def is_external(c: Column) -> Column:
    """Empty, fragment, or another scheme than a file."""
    t = ascii_lower(utrim(c))
    return (t == "") | t.startswith("#") | t.startswith("//") | t.rlike(r"^[a-z][a-z0-9+.\-]+:")


def clean_target(c: Column) -> Column:
    """Local path of a raw target, without fragment and query; null for external and template targets."""
    t = utrim(c)
    cut = utrim(F.replace(F.regexp_replace(t, r"[#?].*$", ""), F.lit("\\"), F.lit("/")))
    return F.when(~is_external(t) & ~is_template(t), F.nullif(cut, F.lit("")))


def is_path_like(c: Column) -> Column:
    k = F.coalesce(clean_target(c), F.lit(""))
    shaped = k.startswith("./") | k.startswith("../") | k.startswith("/") | k.contains("/") | c.contains("\\") | ext_low(k).isin(*COMMON_EXTENSIONS)
    return ~is_external(c) & (k != "") & ~k.contains(":") & ~is_template(k) & ~k.rlike(r"^(?=.*\d)(?=.*\.)[\d.]+$") & shaped


def is_asset(c: Column) -> Column:
    return ext_low(c).isin(*ASSET_EXTENSIONS)


def is_project_file(c: Column) -> Column:
    return ext_low(c).isin(*PROJECT_EXTENSIONS)


def is_build_file(c: Column) -> Column:
    return paths.basename(c).isin(*BUILD_FILES) | c.startswith(".github/workflows/")


def scan_lang(path: Column) -> Column:
    e = F.coalesce(paths.extension(path), F.lit(""))
    return F.when(e == "bash", "sh").when(e == "htm", "html").when(e == "markdown", "md").when(e.isin("rs py js jsx ts tsx mjs cjs json toml yaml yml md html css scss sass rb php go c cc cpp h hpp sh".split()), e).otherwise("text")


def config_kind(path: Column, raw: Column) -> Column:
    return F.when(paths.file_refs_testish_path(path) | raw.contains("fixture"), "fixture").when(is_build_file(path) | is_project_file(path), "package_entry").otherwise("config_path")


def candidates(base: Column, raw: Column) -> Column:
    """Paths to try for a target: itself, with each extension, partial style sheets, index files."""
    name, dir_ = paths.basename(base), paths.parent(base)
    partial = [F.when(dir_ == "", F.concat(F.lit("_"), name, F.lit(f".{e}"))).otherwise(F.concat(dir_, F.lit("/_"), name, F.lit(f".{e}"))) for e in ("scss", "sass", "css")]
    bare = ~(raw.startswith("./") | raw.startswith("../") | raw.startswith("/"))
    rdir, rname = paths.parent(raw), paths.basename(raw)
    sass = [F.when(bare, x) for e in ("scss", "sass", "css") for x in (F.concat(F.lit("_sass/"), raw, F.lit(f".{e}")), F.when(raw.contains("/"), F.concat(F.lit("_sass/"), rdir, F.lit("/_"), rname, F.lit(f".{e}"))).otherwise(F.concat(F.lit("_sass/_"), rname, F.lit(f".{e}"))))]
    tried = F.array(base, *[F.concat(base, F.lit(f".{e}")) for e in COMMON_EXTENSIONS], *partial, *sass, *[F.concat(base, F.lit(f"/{i}")) for i in DIRECTORY_INDEXES])
    return F.array_distinct(F.array_compact(F.when(paths.extension(raw).isNotNull(), F.array(base)).otherwise(tried)))


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve scanned candidates (source_path, ..., raw_target) against ``files(path)``.

    The candidates of a target are exploded and equi-joined with the path set on the lower-cased path; a
    candidate's exact spelling beats another one. One distinct match resolves, several are ambiguous, none is
    unresolved with its reason.
    """
    src = F.col("source_path")
    key = ["source_path", "raw_target"]  # what the resolution depends on
    c = found.withColumn("cleaned", clean_target(F.col("raw_target")))
    relative = F.col("cleaned").startswith("./") | F.col("cleaned").startswith("../")
    bare = ~F.col("cleaned").contains("/") & paths.extension(F.col("cleaned")).isNotNull() & (is_project_file(src) | scan_lang(src).isin("html", "css", "scss", "sass", "md"))
    base = F.when(relative | bare, paths.normalize_rel(F.concat_ws("/", paths.parent(src), F.col("cleaned")))).otherwise(paths.normalize_rel(F.col("cleaned")))
    local = c.filter(F.col("cleaned").isNotNull() & ~F.col("cleaned").startswith("/")).withColumn("base", base)
    tries = local.select(*key, F.explode(F.transform(candidates(F.col("base"), F.col("cleaned")), paths.normalize_rel)).alias("try")).distinct().withColumn("key", ascii_lower(F.col("try")))
    known = files.select("path").distinct().withColumn("key", ascii_lower(F.col("path")))
    hit = tries.join(known, "key").groupBy(*key, "try").agg(F.coalesce(F.max(F.when(F.col("path") == F.col("try"), F.col("path"))), F.max("path")).alias("hit"))
    per = hit.groupBy(*key).agg(F.count_distinct("hit").alias("n"), F.min("hit").alias("hit"))
    r = c.join(per, key, "left")
    n = F.coalesce("n", F.lit(0))
    reason = F.when(F.col("cleaned").isNull(), "external_url").when(F.col("cleaned").startswith("/"), "absolute_path").when(n == 0, "target_not_found").when(n > 1, "ambiguous_match")
    return r.select(
        "source_path", "source_line", "source_col", "raw_target",
        F.when(n == 1, F.col("hit")).alias("target_path"),
        "reference_kind",
        scan_lang(src).alias("lang"),
        F.when(F.col("cleaned").isNull() | F.col("cleaned").startswith("/") | (n == 0), "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("confidence"),
        reason.alias("unresolved_reason"),
        truncate(compact(F.col("evidence"))).alias("evidence"),
        F.lit("file_scan").alias("source"),
    )
