"""Dependency edges: statements, per-language candidates in tiers, and their resolution by equi-joins.

Every import becomes an array of candidates (tier, mode, key). The known paths are spelled as keys of the same
modes: the path itself, each of its suffixes, each suffix of its directory. So suffix and directory matches
are equi-joins too; no import is compared with every path. The lowest tier with a match decides: one distinct
path resolves, several are ambiguous, none leaves the language's reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import paths
from waymark.functions.text import lines, truncate, utrim
from waymark.operators.extract import path_lang

# Extensions, source roots and well-known external names by language (fixed values).
JS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "json")
C = ("h", "hpp", "hh", "hxx")
KOTLIN = ("kt", "kts")
SHELL = ("sh", "bash")
PYTHON_ROOTS = ("src", "lib", "app")
JVM_ROOTS = ("src/main/java", "src/test/java", "src/main/kotlin", "src/test/kotlin", "src/main/scala", "src/test/scala", "src")
DOTNET_ROOTS = ("src", "test", "tests")
SYSTEM_INCLUDES = "assert.h ctype.h errno.h float.h limits.h math.h stddef.h stdint.h stdio.h stdlib.h string.h time.h unistd.h iostream memory string vector".split()
JVM_EXTERNAL = ("java", "javax", "jdk", "kotlin", "scala", "sbt")
KINDS = {"py": "python_import", "js": "js_import", "jsx": "js_import", "ts": "js_import", "tsx": "js_import", "go": "go_import", "java": "java_import", "cs": "cs_import", "c": "c_include", "cpp": "cpp_include", "php": "php_include", "scala": "scala_import", "kt": "kotlin_import", "swift": "swift_import", "dart": "dart_import"}

EDGE = ("from_path", "from_line", "from_col", "import_path", "dependency_kind", "lang", "evidence", "source")
CAND = "array<struct<tier:int,mode:string,key:string,exts:array<string>>>"


def cand(tier: int, mode: str, key: Column, exts: tuple[str, ...] = ()) -> Column:
    listed = F.array(*[F.lit(e) for e in exts]) if exts else F.array().cast("array<string>")
    return F.struct(F.lit(tier).alias("tier"), F.lit(mode).alias("mode"), key.alias("key"), listed.alias("exts"))


def cands(*items: Column) -> Column:
    return F.array(*items).cast(CAND)


def join_rel(parent: Column, child: Column) -> Column:
    """Joined, not yet in normal form: ``resolve`` normalises all keys at once."""
    return F.concat_ws("/", F.nullif(parent, F.lit("")), child)


def tried(tier: int, base: Column, given: Column, exts: tuple[str, ...]) -> Column:
    """The path itself; without an extension also with each extension and as a directory's index."""
    more = [F.concat(base, F.lit(f".{e}")) for e in exts] + [F.concat(base, F.lit(f"/index.{e}")) for e in exts]
    bare = cands(*[cand(tier, "path", x) for x in (base, *more)])
    return F.when(paths.extension(given).isNotNull(), cands(cand(tier, "path", base))).otherwise(bare)


def candidates(kind: Column, imp: Column, src: Column, evidence: Column, go_module: str | None = None, js_package: str | None = None, dart_package: str | None = None) -> tuple[Column, Column, Column]:
    """(candidates, reason if nothing matches, reason that forbids a match) of an edge's columns."""
    here = paths.parent(src)
    rel = imp.startswith("./") | imp.startswith("../")

    module = F.regexp_replace(imp, r"^\.+", "")
    mod_path = F.replace(module, F.lit("."), F.lit("/"))
    py_of = lambda t, base: [cand(t, "path", F.concat(base, F.lit(x))) for x in (".py", "/__init__.py", "/mod.py")]
    py = cands(*[x for t, base in enumerate([F.when(here != "", join_rel(here, mod_path)), *[F.concat(F.lit(f"{r}/"), mod_path) for r in PYTHON_ROOTS], mod_path]) for x in py_of(t, base)])

    def package_path(name: str | None) -> Column:
        if not name:
            return F.lit(None).cast("string")
        rest = F.when(imp.startswith(name), F.substring(imp, len(name) + 1, 1 << 30))
        return F.nullif(F.when((rest == "") | rest.startswith("/"), F.regexp_replace(rest, "^/+", "")), F.lit(""))

    def relative(exts: tuple[str, ...], tier: int = 0) -> Column:
        return tried(tier, join_rel(here, imp), imp, exts)

    def rooted(text: Column, exts: tuple[str, ...], tier: int = 1) -> Column:
        return tried(tier, text, text, exts)

    js_pkg, go_pkg = package_path(js_package), package_path(go_module)
    js = F.when(rel, relative(JS)).when(js_pkg.isNotNull(), rooted(js_pkg, JS))
    bare_go = F.regexp_replace(imp, "^/+|/+$", "")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(bare_go), F.lit(1))), lambda k: F.substring(bare_go, k, F.char_length(bare_go)))
    go_any = F.concat(cands(cand(0, "dir", bare_go, ("go",))), F.transform(tails, lambda x: cand(0, "tail", x, ("go",))).cast(CAND))
    go = F.when(rel, relative(("go",))).when(go_pkg.isNotNull(), cands(cand(0, "dir", go_pkg, ("go",)))).otherwise(go_any)

    jvm_name = utrim(F.regexp_replace(utrim(F.regexp_replace(utrim(imp), "^static ", "")), r"(?:\.\*)+$|(?:\._)+$", ""))
    jvm_path = F.replace(jvm_name, F.lit("."), F.lit("/"))
    star = imp.endswith(".*") | imp.endswith("._")

    def jvm(exts: tuple[str, ...]) -> Column:
        roots = [cand(0, "path", F.concat(F.lit(f"{r}/"), jvm_path, F.lit(f".{e}"))) for r in JVM_ROOTS for e in exts]
        named = [cand(1, "suffix", F.concat(jvm_path, F.lit(f".{e}"))) for e in exts]
        return F.when(star, cands(cand(0, "dir", jvm_path, exts))).otherwise(cands(*roots, *named, cand(2, "dir", jvm_path, exts)))

    net = utrim(F.regexp_replace(utrim(imp), "^static ", ""))
    net_path = F.replace(net, F.lit("."), F.lit("/"))
    cs = cands(*[cand(0, "path", F.concat(F.lit(f"{r}/"), net_path, F.lit(".cs"))) for r in DOTNET_ROOTS], cand(1, "suffix", F.concat(net_path, F.lit(".cs"))), cand(2, "dir", net_path, ("cs",)))
    c_inc = F.concat(relative(C), cands(cand(1, "suffix", imp)))
    php = F.concat(relative(("php",)), rooted(imp, ("php",)))
    swift = cands(cand(0, "suffix", F.concat(F.replace(imp, F.lit("."), F.lit("/")), F.lit(".swift"))))
    pkg, pkg_path = F.regexp_extract(imp, "^package:([^/]*)/", 1), F.regexp_extract(imp, "^package:[^/]*/(.*)$", 1)
    own_pkg = F.lit(dart_package is not None) & (pkg == (dart_package or ""))
    dart = F.when(own_pkg, tried(0, join_rel(F.lit("lib"), pkg_path), pkg_path, ("dart",))).when(rel, relative(("dart",)))

    rs_of = lambda base: cands(cand(0, "path", F.concat(base, F.lit(".rs"))), cand(0, "path", F.concat(base, F.lit("/mod.rs"))))
    use = utrim(F.regexp_replace(imp, ";+$", ""))
    root, rest = F.substring_index(use, "::", 1), F.regexp_extract(use, r"^[^:]*::(.*)$", 1)
    seg = F.filter(F.split(rest, "::", -1), lambda x: (x != "") & ~x.contains("{"))
    joined = F.array_join(F.when(F.size(seg) > 1, F.slice(seg, F.lit(1), F.size(seg) - 1)).otherwise(seg), "/")
    up = paths.parent(here)
    use_base = F.when((F.size(seg) > 0) & use.contains("::"), F.when(root == "crate", join_rel(F.lit("src"), joined)).when(root == "super", F.when(up == "", joined).otherwise(join_rel(up, joined))).when(root == "self", join_rel(here, joined)))
    ruby = F.when(evidence.startswith("require_relative ") | imp.startswith("."), relative(("rb",))).otherwise(rooted(imp, ("rb",)))
    shell = F.concat(relative(SHELL), rooted(imp, SHELL))

    found = (
        F.when(kind == "python_import", py).when(kind == "js_import", js).when(kind == "go_import", go).when(kind == "java_import", jvm(("java",))).when(kind == "kotlin_import", jvm(KOTLIN))
        .when(kind == "scala_import", jvm(("scala",))).when(kind == "cs_import", cs).when(kind.isin("c_include", "cpp_include"), c_inc).when(kind == "php_include", php).when(kind == "swift_import", swift)
        .when(kind == "dart_import", dart).when(kind == "rust_module", rs_of(join_rel(here, imp))).when(kind == "rust_use", F.when(use_base.isNotNull(), rs_of(use_base))).when(kind == "ruby_require", ruby)
        .when(kind == "shell_source", shell).when(kind == "nix_import", relative(("nix",)))
    )
    ext, sysinc, gone = "external_package", "system_include", "target_not_found"
    first = F.substring_index(imp, ".", 1)
    missing = (
        F.when((kind == "python_import") & ~imp.startswith(".") & ~module.contains("."), ext).when((kind == "js_import") & ~rel & js_pkg.isNull(), ext)
        .when((kind == "go_import") & ~rel & go_pkg.isNull(), ext).when(kind == "swift_import", ext).when((kind == "dart_import") & imp.startswith("package:") & ~own_pkg, ext)
        .when((kind == "rust_use") & use_base.isNull(), ext).when((kind == "ruby_require") & ~(evidence.startswith("require_relative ") | imp.startswith(".")), ext).otherwise(gone)
    )
    jvm_kinds = kind.isin("java_import", "kotlin_import", "scala_import")
    forbidden = (
        F.when(jvm_kinds & (first.isin(*JVM_EXTERNAL) | imp.startswith("org.w3c.") | imp.startswith("org.xml.")), ext)
        .when(jvm_kinds & ((jvm_name == "") | jvm_name.rlike("[{}]")), gone).when((kind == "cs_import") & net.rlike(r"^(?:System\.|System$|Microsoft\.)"), ext)
        .when(kind.isin("c_include", "cpp_include") & imp.isin(*SYSTEM_INCLUDES), sysinc).when((kind == "dart_import") & imp.startswith("dart:"), ext)
        .when((kind == "shell_source") & imp.startswith("/"), "absolute_path").when((kind == "python_import") & (module == ""), gone).when(~kind.isin(*KINDS.values(), "rust_module", "rust_use", "ruby_require", "shell_source", "nix_import"), "unsupported_language")
    )
    return F.coalesce(found, F.array().cast(CAND)), missing, forbidden


def path_keys(files: DataFrame) -> DataFrame:
    """(mode, key, path, ext): a path as itself, by its suffixes, by the suffixes of its directory, and by its directory's proper suffixes."""
    p = files.select("path").distinct()
    parts = F.split("path", "/", -1)
    n = F.size(parts)
    suffix = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), "/"))
    d = F.when(n > 1, F.slice(parts, F.lit(1), n - 1)).otherwise(F.array(F.lit("")))
    m = F.size(d)
    dirs = F.transform(F.sequence(F.lit(1), m), lambda k: F.array_join(F.slice(d, k, m), "/"))
    tails = F.slice(dirs, F.lit(2), m)
    keyed = lambda mode, keys: F.transform(keys, lambda k: F.struct(F.lit(mode).alias("mode"), k.alias("key")))
    every = F.concat(keyed("path", F.array("path")), keyed("suffix", suffix), keyed("dir", dirs), keyed("tail", tails))
    return p.select("path", paths.extension(F.col("path")).alias("ext"), F.explode(every).alias("k")).select("k.mode", "k.key", "path", "ext")


def resolve(edges: DataFrame, files: DataFrame, go_module: str | None = None, js_package: str | None = None, dart_package: str | None = None) -> DataFrame:
    """Edges (EDGE columns) with target_path, confidence and unresolved_reason, deduplicated by keep-first."""
    from waymark.operators.caps import keep_first

    names = ("dependency_kind", "import_path", "from_path", "evidence")
    rules = lambda *c: candidates(*c, go_module, js_package, dart_package)
    # the rules of all languages are one large expression: bound to one row it is interpreted, not generated
    bound = lambda k: paths.let(F.struct(*names), lambda r: rules(*[r[c] for c in names])[k])
    found, missing, forbidden = bound(0), bound(1), bound(2)
    normal = lambda c: F.struct(c["tier"].alias("tier"), c["mode"].alias("mode"), F.when(c["mode"] == "tail", c["key"]).otherwise(paths.normalize_rel(c["key"])).alias("key"), c["exts"].alias("exts"))
    e = edges.select(*EDGE).withColumns({"missing": missing, "forbidden": forbidden})
    key = ["from_path", "import_path", "dependency_kind", "evidence"]  # what the candidates depend on
    tries = e.filter(F.col("forbidden").isNull()).select(*key).distinct().select(*key, F.explode(F.transform(found, normal)).alias("c")).select(*key, "c.*").filter(F.col("key").isNotNull())
    # both sides are exploded, which Spark's size estimates leave out: unhinted, millions of rows pass for a broadcast
    hits = tries.join(path_keys(files).hint("merge"), ["mode", "key"]).filter((F.size("exts") == 0) | F.array_contains("exts", F.col("ext")))
    tier = hits.groupBy(*key, "tier").agg(F.count_distinct("path").alias("n"), F.min("path").alias("p"))
    best = tier.groupBy(*key).agg(F.min(F.struct("tier", "n", "p")).alias("b"))
    r = e.join(best, key, "left")
    n = F.coalesce(F.col("b.n"), F.lit(0))
    reason = F.coalesce("forbidden", F.when(n == 0, F.col("missing")).when(n > 1, F.lit("ambiguous_match")))
    out = r.select(
        "from_path", "from_line", "from_col", "import_path", F.when(n == 1, F.col("b.p")).alias("target_path"), "dependency_kind", "lang",
        F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("confidence"), reason.alias("unresolved_reason"), truncate(F.col("evidence")).alias("evidence"), "source",
    )
    return keep_first(out, ["from_path", "import_path", "target_path", "dependency_kind"], ["from_line", "from_col", "lang", "confidence", "unresolved_reason", "evidence", "source"])


def clean_import(c: Column) -> Column:
    """An import record's name without quotes, angle brackets and semicolon; null if nothing is left."""

    def cleaned(t: Column) -> Column:
        quoted = F.regexp_extract(t, r"""["'`]""", 0)
        inner = F.coalesce(*[F.when(quoted == q, F.nullif(F.regexp_extract(t, f"{q}([^{q}]*){q}", 1), F.lit(""))) for q in "\"'`"])
        plain = utrim(F.regexp_replace(F.regexp_replace(t, r"^[\"'`]+|[\"'`]+$", ""), "^<|>$", ""))
        return F.coalesce(inner, F.nullif(plain, F.lit("")))

    return paths.let(utrim(F.regexp_replace(utrim(c), ";+$", "")), cleaned)


def edges_from_imports(records: DataFrame) -> DataFrame:
    """Edges of parsed import records whose language has a resolver."""
    r = records.filter((F.col("kind") == "import") & (F.col("source") == "tree_sitter"))
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("lang")]
    full = F.regexp_extract(F.regexp_replace(utrim(F.col("text")), ";+$", ""), r"^import\s+([^\s{},]+)", 1)
    name = clean_import(F.col("name"))
    path = F.when((F.col("lang") == "scala") & ~name.contains(".") & (full != ""), full).otherwise(name)
    out = r.select(F.col("path").alias("from_path"), F.col("line").alias("from_line"), F.col("col").alias("from_col"), path.alias("import_path"), kind.alias("dependency_kind"), "lang", F.col("text").alias("evidence"), F.lit("tree_sitter").alias("source"))
    return out.filter(F.col("import_path").isNotNull() & F.col("dependency_kind").isNotNull())


def scanned_edges(files: DataFrame) -> DataFrame:
    """Edges of Rust mod and use, Ruby require, shell source and Nix import lines."""
    def statement(ln: Column, lang: Column) -> Column:
        ob = F.octet_length
        row = lambda col, imp, kind: F.struct(col.cast("int").alias("col"), imp.alias("imp"), F.lit(kind).alias("kind"))
        mod_head, mod = F.regexp_extract(ln, r"^(\s*(?:pub |pub\(crate\) |pub\(super\) )?mod )[A-Za-z0-9_]", 1), F.regexp_extract(ln, r"^\s*(?:pub |pub\(crate\) |pub\(super\) )?mod ([A-Za-z0-9_]+)[^{]*$", 1)
        use_head, use = F.regexp_extract(ln, r"^(\s*use )", 1), utrim(F.regexp_replace(F.regexp_extract(ln, r"^\s*use ([^{]*)$", 1), ";+$", ""))
        rs = F.when(mod != "", row(ob(mod_head) + 1, mod, "rust_module")).when(~ln.rlike(r"^\s*(?:pub |pub\(crate\) |pub\(super\) )?mod ") & (use != ""), row(ob(use_head) + 1, use, "rust_use"))
        rb_re = r"^(\s*require(?:_relative)? [^\"'`]*[\"'`])([^\"'`]+)[\"'`]"
        rb = F.when(ln.rlike(rb_re), row(ob(F.regexp_extract(ln, rb_re, 1)) + 1, F.regexp_extract(ln, rb_re, 2), "ruby_require"))
        sh_re = r"^(\s*(?:source |\. )\s*[\"'`]?)([^\s;\"'`]+)"
        sh_imp = F.regexp_extract(ln, sh_re, 2)
        sh = F.when((sh_imp != "") & ~sh_imp.rlike("^[$~]"), row(ob(F.regexp_extract(ln, sh_re, 1)) + 1, sh_imp, "shell_source"))
        nix_re = r"^(\s*(?!#).*?import \s*)(\.\.?/[^\s;)\]}]*)"
        nix = F.when(ln.rlike(nix_re), row(ob(F.regexp_extract(ln, nix_re, 1)) + 1, F.regexp_extract(ln, nix_re, 2), "nix_import"))
        return F.when(lang == "rs", rs).when(lang == "rb", rb).when(lang.isin("sh", "bash"), sh).when(lang == "nix", nix)

    found = paths.let(F.struct("line", "lang"), lambda r: statement(r["line"], r["lang"]))
    r = lines(files).withColumn("lang", path_lang(F.col("path"))).withColumn("m", found).filter(F.col("m").isNotNull())
    return r.select(F.col("path").alias("from_path"), F.col("line_no").alias("from_line"), F.col("m.col").alias("from_col"), F.col("m.imp").alias("import_path"), F.col("m.kind").alias("dependency_kind"), "lang", utrim(F.col("line")).alias("evidence"), F.lit("line_scan").alias("source"))
