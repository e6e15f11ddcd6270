"""Path expressions: roles, penalties, depths, test and fixture tests, match ranks, normal form."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.text import ascii_lower

# Directory names, file names and endings by which paths are classified (fixed values).
VENDOR_DIRS = ("vendor", "vendors", "node_modules", "third_party", "3rdparty", "external")
GENERATED_DIRS = ("generated", "gen", "dist", "build", "target")
GENERATED_ENDS = (".gen.rs", ".pb.go", ".min.js", ".min.css")
DOC_ENDS = (".md", ".mdx", ".rst", ".adoc")
TEST_DIRS = ("tests", "test", "__tests__", "spec")
MANIFEST_NAMES = ("cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "gemfile", "pubspec.yaml", "pubspec.yml", "mix.exs", "deno.json", "deno.jsonc")
MANIFEST_ENDS = (".csproj", ".fsproj", ".vbproj", ".sln")
BUILD_NAMES = ("makefile", "cmakelists.txt", "dockerfile", "justfile", "rakefile")
CONFIG_DIRS = ("config", "configs", "routes", "schemas")
CONFIG_PARTS = ("config", "settings", "route", "router", "schema")
CONFIG_ENDS = (".json", ".toml", ".yaml", ".yml")
SOURCE_ENDS = (".rs", ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".c", ".h", ".cc", ".cpp", ".cxx", ".hh", ".hpp", ".hxx", ".cs", ".sh", ".bash", ".rb", ".php", ".scala", ".kt", ".kts", ".swift", ".dart", ".nix")
FIXTURE_DIRS = ("fixtures", "fixture", "examples", "example")
SENSITIVE_NAMES = (".env", ".env.local", ".env.production", ".env.development", ".envrc", ".netrc", ".npmrc", ".pypirc", "credentials", "credentials.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519")
SENSITIVE_ENDS = (".pem", ".key", ".p12", ".pfx")
SENSITIVE_DIRS = ("secrets", "secret", "credentials", "private_keys")


def named(name: Column, names: tuple[str, ...], suffixes: tuple[str, ...]) -> Column:
    """A whole name, or one of the endings."""
    return name.rlike("^(?:" + "|".join(map(re.escape, names)) + ")$|(?:" + "|".join(map(re.escape, suffixes)) + ")$")


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def normal(path: Column) -> Column:
    """Forward slashes, ASCII lower case."""
    return ascii_lower(F.replace(path, F.lit("\\"), F.lit("/")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def in_dir(p: Column, names: tuple[str, ...]) -> Column:
    """A directory of one of the names at the start or inside; p in normal form."""
    return p.rlike("(?:^|/)(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")/")


def ends(p: Column, suffixes: tuple[str, ...]) -> Column:
    return p.rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")


def holds(p: Column, parts: tuple[str, ...]) -> Column:
    return p.rlike("|".join(re.escape(s) for s in parts))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``; without it long rules repeat in generated code."""
    return F.element_at(F.transform(F.array(value), body), 1)


def file_role(path: Column) -> Column:
    """First of vendor, generated, docs, test, package_manifest, build, config, source, unknown."""
    p = normal(path)
    name = basename(p)
    return (
        F.when(in_dir(p, VENDOR_DIRS), "vendor")
        .when(in_dir(p, GENERATED_DIRS) | name.contains(".generated.") | ends(name, GENERATED_ENDS), "generated")
        .when(in_dir(p, ("docs",)) | ends(p, DOC_ENDS), "docs")
        .when(in_dir(p, TEST_DIRS) | name.startswith("test_") | holds(name, ("_test", ".test.", ".spec.")), "test")
        .when(named(name, MANIFEST_NAMES, MANIFEST_ENDS), "package_manifest")
        .when(name.rlike("^(?:" + "|".join(map(re.escape, BUILD_NAMES)) + r")$|^dockerfile\.") | p.rlike(r"(?:^|/)(?:\.github/workflows/|\.gitlab-ci\.|ci/)"), "build")
        .when(in_dir(p, CONFIG_DIRS) | holds(name, CONFIG_PARTS) | ends(p, CONFIG_ENDS), "config")
        .when(ends(name, SOURCE_ENDS), "source")
        .when(p.isNotNull(), "unknown")
    )


def is_source_role(role: Column) -> Column:
    return role.isin("source", "test")


def is_operational_role(role: Column) -> Column:
    return role.isin("build", "package_manifest", "config")


def is_fixture_path(path: Column) -> Column:
    return in_dir(normal(path), FIXTURE_DIRS)


def search_penalty(path: Column) -> Column:
    """Penalty of the ranked search: fixtures 25, tests 10, docs 15."""
    p = normal(path)
    return F.when(in_dir(p, FIXTURE_DIRS), 25).when(in_dir(p, ("tests", "test")), 10).when(in_dir(p, ("docs",)) | ends(p, (".md", ".mdx")), 15).otherwise(0)


def context_penalty(path: Column) -> Column:
    """Penalty of refs, pack and impact: by role; not the same as the search's."""
    return let(file_role(path), lambda role: F.when(role.isin("generated", "vendor"), 30).when(is_fixture_path(path), 25).when(role == "test", 10).when(role == "docs", 15).when(is_operational_role(role), 20).otherwise(0))


def path_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), lambda x: x != ""))


def refs_test_path(path: Column) -> Column:
    """The reference scanner's narrower test path."""
    p = normal(path)
    name = basename(p)
    return in_dir(p, ("tests", "test", "__tests__")) | holds(name, ("_test", ".test.", ".spec."))


def file_refs_testish_path(path: Column) -> Column:
    p = normal(path)
    return in_dir(p, ("tests", "test")) | p.contains("fixture")


def extension(path: Column) -> Column:
    """Text behind the last dot of the file name, null for dot files and names without one."""
    return F.nullif(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1), F.lit(""))


def stem(path: Column) -> Column:
    """File name without its last extension; null where nothing is left."""
    name = basename(path)
    return F.nullif(F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name), F.lit(""))


def file_match_rank(path: Column, term: str) -> Column:
    """0 path, 1 name, 2 and 3 the same without case, 4 stem, 5 name start, 6 component, 10 inside; else null."""
    term = term.strip()
    if not term:
        return F.lit(None).cast("int")
    low = term.replace("\\", "/").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    pl = ascii_lower(p)
    name = basename(p)
    nl = ascii_lower(name)
    st = ascii_lower(F.when(name.rlike(r"^.+\."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name))
    part = F.exists(F.split(pl, "/", -1), lambda x: x.startswith(low))
    return F.when(p == term, 0).when(name == term, 1).when(pl == low, 2).when(nl == low, 3).when(st == low, 4).when(nl.startswith(low), 5).when(part, 6).when(pl.contains(low), 10)


def sensitive_reason(path: Column) -> Column:
    p = normal(path)
    name = basename(p)
    part = F.arrays_overlap(F.split(p, "/", -1), F.array(*[F.lit(x) for x in SENSITIVE_DIRS]))
    return F.when(name.isin(*SENSITIVE_NAMES), "sensitive filename").when(ends(name, SENSITIVE_ENDS), "private key or certificate-like extension").when(part, "sensitive directory name")


def normalize_rel(path: Column) -> Column:
    """Drop empty and . parts; .. takes the part before it and never leaves the root."""
    keep = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    none = F.array().cast("array<string>")
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(none)).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(keep, none, step), "/")


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def top_dir(path: Column) -> Column:
    return F.nullif(F.substring_index(F.regexp_replace(path, r"^(?:\./)+", ""), "/", 1), F.lit(""))


def test_name(c: Column) -> Column:
    """ASCII letters and digits only, lower case."""
    return F.regexp_replace(ascii_lower(c), "[^a-z0-9]", "")
