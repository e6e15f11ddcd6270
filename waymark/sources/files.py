"""Reading source trees: walk with ignore rules, size and binary policy, UTF-8 decoding, repository root.

Folders are listed and files read through pyarrow's file systems, so a root may be a local folder or any URI they
know; names that begin with a dot or an underscore and empty files are seen, which Spark's own file sources leave
out. The driver lists only the uppermost folders; the rest is listed on the executors. Sizes and times filter
before any content is read, and content is only read for files that are indexed. Ignore files are few and small;
their rules are compiled on the driver into one pattern each and applied as filters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE_DIRS = (".git", ".dev_index", "test_repos")
MAX_BYTES = 2 * 1024 * 1024
WARN_BYTES = 512 * 1024
SNIFF_BYTES = 8192
IGNORE_FILES = (".gitignore", ".ignore", ".waymarkignore")
"""Directories never read, size limits, and names of ignore files (fixed values)."""


def find_root(start: str) -> str:
    """The nearest folder at or above ``start`` that holds .git, else ``start``."""
    p = Path(start).resolve()
    return str(next((q for q in (p, *p.parents) if (q / ".git").exists()), p))


def glob_regex(pattern: str) -> str:
    """A gitignore glob as a regular expression over a path relative to the ignore file."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def ignore_rules(text: str, base: str = "") -> list[tuple[str, bool]]:
    """(regular expression over the whole path, is a negation) of each rule, in file order.

    Supported: comments, escapes, negation, anchoring, directory-only rules, *, ?, ** and classes.
    """
    rules = []
    prefix = re.escape(base + "/") if base else ""
    for line in text.splitlines():
        rule = line.rstrip("\r")
        rule = re.sub(r"(?<!\\)\s+$", "", rule)
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        rule = rule[1:] if negated else rule
        only_dir = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        body = glob_regex(rule.lstrip("/"))
        rules.append((f"^{prefix}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if only_dir else '(?:/.*)?'}$", negated))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for pattern, negated in rules:
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def always_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/", -1), F.array(*[F.lit(d) for d in IGNORE_DIRS]))


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or URI, and its path there."""
    if "://" in root:
        own, path = pafs.FileSystem.from_uri(root)
        return own, path.rstrip("/")
    return pafs.LocalFileSystem(), str(Path(root).resolve()).rstrip("/")


FOLDERS, LEVELS = 256, 4
"""The driver lists folders level by level until there are so many, or so deep."""
LISTING = "path string, mtime_ns bigint, size bigint"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_ns, size) of every file below ``root`` but in folders that are never read."""
    own, base = file_system(root)
    skip = len(base) + 1
    folders, files = [base], []
    for _ in range(LEVELS):
        if not 0 < len(folders) < FOLDERS:
            break
        found = [x for d in folders for x in own.get_file_info(pafs.FileSelector(d)) if x.base_name not in IGNORE_DIRS]
        files += [(x.path[skip:], x.mtime_ns, x.size) for x in found if x.type == pafs.FileType.File]
        folders = [x.path for x in found if x.type == pafs.FileType.Directory]
    top = spark.createDataFrame(files, LISTING)
    if not folders:
        return top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, _ = file_system(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                todo = [folder]
                while todo:
                    found = [x for x in here.get_file_info(pafs.FileSelector(todo.pop())) if x.base_name not in IGNORE_DIRS]
                    todo += [x.path for x in found if x.type == pafs.FileType.Directory]
                    rows = [x for x in found if x.type == pafs.FileType.File]
                    yield pa.RecordBatch.from_arrays([pa.array([x.path[skip:] for x in rows], pa.string()), pa.array([x.mtime_ns for x in rows], pa.int64()), pa.array([x.size for x in rows], pa.int64())], names=["path", "mtime_ns", "size"])

    parts = min(len(folders), max(1, spark.sparkContext.defaultParallelism) * 4)
    below = spark.createDataFrame([(d,) for d in folders], "folder string").repartition(parts).mapInArrow(run, LISTING)
    return top.unionByName(below)


def read_text(root: str, path: str) -> str | None:
    """A small text file below the root, None if there is none."""
    own, base = file_system(root)
    full = f"{base}/{path}"
    if own.get_file_info(full).type != pafs.FileType.File:
        return None
    with own.open_input_file(full) as f:
        return f.read().decode("utf-8", "replace")


def root_rules(files: DataFrame, root: str, global_rules: str = "") -> list[tuple[str, bool]]:
    """Rules of a global text, of .git/info/exclude and of all ignore files below the root, outer ones first."""
    found = [r["path"] for r in files.filter(F.substring_index("path", "/", -1).isin(*IGNORE_FILES)).select("path").collect()]  # ignore files are few
    found.sort(key=lambda p: (p.count("/"), IGNORE_FILES.index(p.rpartition("/")[2]), p))
    rules = ignore_rules(global_rules) + ignore_rules(read_text(root, ".git/info/exclude") or "")
    return rules + [r for p in found for r in ignore_rules(read_text(root, p) or "", p.rpartition("/")[0])]


def walk(spark: SparkSession, root: str, rules: list[tuple[str, bool]] | None = None, global_rules: str = "") -> DataFrame:
    """(path, mtime_ns, size) of the files below ``root`` that are not ignored, hidden ones included; no content is read."""
    every = listed(spark, root)
    rules = root_rules(every, root, global_rules) if rules is None else rules
    return every.filter(~always_ignored(F.col("path")) & ~ignored(F.col("path"), rules))


def read_texts(spark: SparkSession, root: str, rules: list[tuple[str, bool]] | None = None, global_rules: str = "", files: DataFrame | None = None) -> DataFrame:
    """(path, mtime_ns, size, text) of a walk, or of the listed ``files``: text is null for files too large, binary, or no valid UTF-8.

    Files are spread by path before they are read; one that vanishes meanwhile has no text.
    """
    _, base = file_system(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(root)
        for b in batches:
            for row in b.to_pylist():
                content = None
                if row["size"] <= MAX_BYTES:
                    try:
                        with own.open_input_file(f"{base}/{row['path']}") as f:
                            content = f.read()
                    except FileNotFoundError:
                        content = None
                yield pa.RecordBatch.from_pylist([row | {"content": content}], schema=pa.schema([("path", pa.string()), ("mtime_ns", pa.int64()), ("size", pa.int64()), ("content", pa.binary())]))

    kept = (walk(spark, root, rules, global_rules) if files is None else files.select("path", "mtime_ns", "size")).repartition("path")
    return kept.mapInArrow(run, LISTING + ", content binary").select("path", "mtime_ns", "size", decoded(F.col("content")).alias("text"))


def decoded(content: Column) -> Column:
    """UTF-8 text of a file's bytes, null for a NUL byte near the start or invalid bytes."""
    text = content.cast("string")
    binary = F.contains(F.substring(content, 1, SNIFF_BYTES), F.unhex(F.lit("00")))
    return F.when(~binary & F.is_valid_utf8(text), text)


def size_warnings(files: DataFrame, limit: int = 20) -> DataFrame:
    """The largest files at or above the warning size: (path, size, threshold, action)."""
    big = files.filter(F.col("size") >= WARN_BYTES)
    over = F.col("size") > MAX_BYTES
    return big.select("path", "size", F.when(over, MAX_BYTES).otherwise(WARN_BYTES).cast("bigint").alias("threshold"), F.when(over, "Skipped").otherwise("Indexed").alias("action")).orderBy(F.desc("size"), "path").limit(limit)


def package_names(texts: dict[str, str]) -> dict[str, str | None]:
    """Go module, package.json and pubspec names of a repository's root files."""
    import json

    go = next((m.group(1).strip() for m in [re.search(r"^\s*module (.+)$", texts.get("go.mod", ""), re.MULTILINE)] if m), None)
    try:
        js = json.loads(texts.get("package.json", "null"))
    except ValueError:
        js = None
    name = js.get("name").strip() or None if isinstance(js, dict) and isinstance(js.get("name"), str) else None
    dart = re.search(r"^\s*name:\s*[\"']*([^\"'\s]+)", re.sub(r"(?m)^\s*#.*$", "", texts.get("pubspec.yaml", "")), re.MULTILINE)
    return {"go_module": go, "js_package": name, "dart_package": dart.group(1) if dart else None}
