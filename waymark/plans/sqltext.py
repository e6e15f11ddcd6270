"""DuckDB spellings of the path and rank rules, written for the oracle queries only."""

from __future__ import annotations

UP, LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(c: str) -> str:
    return f"translate({c}, '{UP}', '{LO}')"


def norm(c: str) -> str:
    return low(f"replace({c}, '\\', '/')")


def base(c: str) -> str:
    return f"regexp_extract({c}, '[^/]*$')"


def dirs(c: str, *names: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '/{n}/') OR starts_with({c}, '{n}/')" for n in names) + ")"


def ends(c: str, *tails: str) -> str:
    return "(" + " OR ".join(f"ends_with({c}, '{t}')" for t in tails) + ")"


def has(c: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in parts) + ")"


def role(path: str) -> str:
    p = norm(path)
    f = base(p)
    quoted = lambda *n: "(" + ", ".join(f"'{x}'" for x in n) + ")"
    manifests = quoted("cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "gemfile", "pubspec.yaml", "pubspec.yml", "mix.exs", "deno.json", "deno.jsonc")
    return f"""CASE WHEN {dirs(p, 'vendor', 'vendors', 'node_modules', 'third_party', '3rdparty', 'external')} THEN 'vendor'
      WHEN {dirs(p, 'generated', 'gen', 'dist', 'build', 'target')} OR contains({f}, '.generated.') OR {ends(f, '.gen.rs', '.pb.go', '.min.js', '.min.css')} THEN 'generated'
      WHEN {dirs(p, 'docs')} OR {ends(p, '.md', '.mdx', '.rst', '.adoc')} THEN 'docs'
      WHEN {dirs(p, 'tests', 'test', '__tests__', 'spec')} OR starts_with({f}, 'test_') OR {has(f, '_test', '.test.', '.spec.')} THEN 'test'
      WHEN {f} IN {manifests} OR {ends(f, '.csproj', '.fsproj', '.vbproj', '.sln')} THEN 'package_manifest'
      WHEN {f} IN ('makefile', 'cmakelists.txt', 'dockerfile', 'justfile', 'rakefile') OR starts_with({f}, 'dockerfile.') OR {dirs(p, '.github/workflows', 'ci')} OR contains({p}, '/.gitlab-ci.') OR starts_with({p}, '.gitlab-ci.') THEN 'build'
      WHEN {dirs(p, 'config', 'configs', 'routes', 'schemas')} OR {has(f, 'config', 'settings', 'route', 'schema')} OR {ends(p, '.json', '.toml', '.yaml', '.yml')} THEN 'config'
      WHEN {ends(f, '.rs', '.py', '.js', '.jsx', '.ts', '.tsx', '.java', '.go', '.c', '.h', '.cc', '.cpp', '.cxx', '.hh', '.hpp', '.hxx', '.cs', '.sh', '.bash', '.rb', '.php', '.scala', '.kt', '.kts', '.swift', '.dart', '.nix')} THEN 'source'
      WHEN {path} IS NOT NULL THEN 'unknown' END"""


def fixture(path: str) -> str:
    return dirs(norm(path), "fixtures", "fixture", "examples", "example")


def search_penalty(path: str) -> str:
    p = norm(path)
    return f"CASE WHEN {fixture(path)} THEN 25 WHEN {dirs(p, 'tests', 'test')} THEN 10 WHEN {dirs(p, 'docs')} OR {ends(p, '.md', '.mdx')} THEN 15 ELSE 0 END"


def context_penalty(path: str, role_col: str) -> str:
    return f"CASE WHEN {role_col} IN ('generated', 'vendor') THEN 30 WHEN {fixture(path)} THEN 25 WHEN {role_col} = 'test' THEN 10 WHEN {role_col} = 'docs' THEN 15 WHEN {role_col} IN ('build', 'package_manifest', 'config') THEN 20 ELSE 0 END"


def depth(path: str) -> str:
    return f"len(list_filter(string_split(replace({path}, '\\', '/'), '/'), lambda x: x <> ''))"


KIND_RANK = """CASE WHEN kind IN ('function','class','method','component','component_def') THEN 0 WHEN kind IN ('interface','type','struct','enum','trait') THEN 1
  WHEN kind IN ('const','constant','variable','module','import','export') THEN 2 WHEN kind IN ('target','make_target') THEN 3
  WHEN kind IN ('css_id','css_class','css_variable','keyframes') THEN 4 WHEN kind IN ('jsx_class','component_usage') THEN 5
  WHEN kind IN ('html_id','html_class','html_tag','data_attribute','id','key','table') THEN 6 WHEN kind IN ('todo','fixme') THEN 7
  WHEN kind IN ('heading','markdown_heading','section') THEN 8 WHEN kind IN ('checklist','link') THEN 9 ELSE 99 END"""


def match_rank(q: str) -> str:
    """For a query that is one word of letters, digits and underscores."""
    lq = q.lower()
    n, t = low("name"), low("text")
    abbr = "regexp_replace(name, '[^A-Z0-9]', '', 'g')"
    word = lambda c: f"list_contains(string_split_regex({c}, '[^A-Za-z0-9_]'), '{lq}')"
    return f"""CASE WHEN name = '{q}' THEN 0 WHEN {n} = '{lq}' THEN 1 WHEN starts_with({n}, '{lq}') THEN 2
      WHEN {word(n)} OR ({abbr} <> '' AND starts_with({low(abbr)}, '{lq}')) THEN 3 WHEN contains({n}, '{lq}') THEN 4
      WHEN kind IN ('todo','fixme','checklist','link','section','heading','markdown_heading') THEN
        CASE WHEN {t} = '{lq}' THEN 20 WHEN {word(t)} THEN 21 WHEN contains({t}, '{lq}') THEN 30 END END"""


def search(q: str, where: str = "TRUE", limit: int = 30, table: str = "records") -> str:
    return f"""SELECT path, line, col, lang, kind, name, text, source, score FROM (
      SELECT *, {match_rank(q)} AS score FROM {table} WHERE {where}) WHERE score IS NOT NULL
      ORDER BY CASE WHEN score <= 1 THEN 0 ELSE 1 END, {search_penalty('path')}, score, {KIND_RANK}, {depth('path')}, length(text), path, line, col, kind, name, source, lang, text LIMIT {limit}"""


def file_rank(q: str) -> str:
    lq = q.lower()
    p = "replace(path, '\\', '/')"
    pl, f = low(p), base(p)
    fl = low(f)
    return f"""CASE WHEN {p} = '{q}' THEN 0 WHEN {f} = '{q}' THEN 1 WHEN {pl} = '{lq}' THEN 2 WHEN {fl} = '{lq}' THEN 3
      WHEN CASE WHEN regexp_matches({f}, '^.+\\.') THEN regexp_replace({fl}, '\\.[^.]*$', '') ELSE {fl} END = '{lq}' THEN 4
      WHEN starts_with({fl}, '{lq}') THEN 5 WHEN len(list_filter(string_split({pl}, '/'), lambda x: starts_with(x, '{lq}'))) > 0 THEN 6 WHEN contains({pl}, '{lq}') THEN 10 END"""


def file_search(q: str, limit: int = 30) -> str:
    return f"""SELECT path, score FROM (SELECT path, {file_rank(q)} AS score FROM (SELECT DISTINCT path FROM files)) WHERE score IS NOT NULL
      ORDER BY score, {depth('path')}, {low('path')}, path LIMIT {limit}"""
