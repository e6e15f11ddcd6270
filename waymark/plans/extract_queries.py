"""Queries: lines, identifiers, landmarks, references and edges read off the source texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.text import lines
from waymark.operators import extract as X
from waymark.operators import file_refs, resolve, symbols
from waymark.plans import sqltext as Q
from waymark.registry import Registry, table

LINES = """ar AS (SELECT path, string_split(text, chr(10)) AS a FROM source_files WHERE text IS NOT NULL),
  ak AS (SELECT path, CASE WHEN a[-1] = '' THEN a[:len(a) - 1] ELSE a END AS a FROM ar),
  lines AS (SELECT path, k AS line_no, regexp_replace(a[k], '\\r$', '') AS line, CASE WHEN contains(path, '.') THEN regexp_extract(path, '[^.]*$') ELSE 'unknown' END AS lang FROM (SELECT path, a, unnest(generate_series(1, len(a))) AS k FROM ak))"""


def spans(name: str, pattern: str, where: str = "TRUE") -> str:
    p = pattern.replace("'", "''")
    return f"""{name}_f AS (SELECT *, regexp_extract_all(line, '{p}') AS f, string_split_regex(line, '{p}') AS g FROM lines WHERE {where}),
      {name} AS (SELECT path, line_no, line, lang, f[k] AS t, (coalesce(list_sum(list_transform(g[1:k], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(f[1:k-1], lambda x: strlen(x))), 0) + 1)::INTEGER AS col
        FROM (SELECT *, unnest(generate_series(1, len(f))) AS k FROM {name}_f WHERE len(f) > 0))"""


def texts(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "source_files").select("path", "text")


STOP = "('test','main','new','run','app','id','name','type','value')"


def register(reg: Registry) -> None:
    @reg.query("lines", f"WITH {LINES} SELECT path, line_no::INTEGER AS line_no, line FROM lines")
    def all_lines(spark, d):
        return lines(texts(spark, d))

    @reg.query("identifier_spans", f"WITH {LINES}, {spans('s', '[A-Za-z0-9_]+')} SELECT path, line_no::INTEGER AS line_no, col, t AS name FROM s WHERE regexp_matches(t, '^[A-Za-z_]')")
    def identifier_spans(spark, d):
        return X.identifier_spans(texts(spark, d))

    only = lambda *kinds: lambda spark, d: X.line_landmarks(texts(spark, d)).filter(F.col("kind").isin(*kinds)).select("path", "line", "col", "kind", "name")
    todo = lambda w: f"SELECT path, line_no::INTEGER AS line, (strlen(split_part(line, '{w}', 1)) + 1)::INTEGER AS col, '{w.lower()}' AS kind, '{w}' AS name FROM lines WHERE contains(line, '{w}')"
    reg.query("todo_landmarks", f"WITH {LINES} {todo('TODO')} UNION ALL {todo('FIXME')}")(only("todo", "fixme"))
    css_token = "[.#][A-Za-z_-][A-Za-z0-9_-]*|--[A-Za-z0-9_-]+"
    where_css = "lang = 'css'"
    css_sql = f"""WITH {LINES}, {spans('s', css_token, where_css)}
      SELECT path, line_no::INTEGER AS line, col, CASE WHEN starts_with(t, '.') THEN 'css_class' WHEN starts_with(t, '#') THEN 'css_id' ELSE 'css_variable' END AS kind, t AS name FROM s"""
    reg.query("css_landmarks", css_sql)(only("css_class", "css_id", "css_variable"))
    link = r"\[[^\]]*\]\([^)]+\)"
    where_md = "lang IN ('md', 'markdown')"
    links_sql = f"""{spans('s', link, where_md)},
      l AS (SELECT path, line_no, (col + strlen(t) - strlen(g) - 1)::INTEGER AS col, g AS name, t FROM (SELECT *, regexp_extract(t, '^\\[[^\\]]*\\]\\(([^)]+)\\)$', 1) AS g FROM s))"""
    md_sql = f"""WITH {LINES}, {links_sql} SELECT path, line_no::INTEGER AS line, col, 'link' AS kind, name FROM l
      UNION ALL SELECT path, line_no::INTEGER, (strlen(regexp_extract(line, '^(\\s*#{{1,6}}\\s+)\\S', 1)) + 1)::INTEGER, 'section', regexp_extract(line, '^\\s*#{{1,6}}\\s+(\\S.*?)\\s*$', 1) FROM lines WHERE {where_md} AND regexp_matches(line, '^\\s*#{{1,6}}\\s+\\S')
      UNION ALL SELECT path, line_no::INTEGER, (strlen(regexp_extract(line, '^(\\s*- \\[[ xX]\\] )', 1)) + 1)::INTEGER, 'checklist', trim(regexp_extract(line, '^\\s*- \\[[ xX]\\] (.*)$', 1)) FROM lines WHERE {where_md} AND regexp_matches(line, '^\\s*- \\[[ xX]\\] .*\\S')"""

    @reg.query("markdown_landmarks", md_sql)
    def markdown_landmarks(spark, d):
        return X.line_landmarks(texts(spark, d)).filter(F.col("lang").isin("md", "markdown") & F.col("kind").isin("link", "section", "checklist")).select("path", "line", "col", "kind", "name")

    json_pat = r'"[^"\\]*(?:\\.[^"\\]*)*"(?:\s*:)?'
    where_json = "lang = 'json'"
    key_ok = "regexp_matches(n, '^[A-Za-z0-9_\\-.$@:]+$') AND regexp_matches(n, '[A-Za-z0-9]')"
    json_sql = f"""WITH {LINES}, {spans('s', json_pat, where_json)}
      SELECT path, line_no::INTEGER AS line, col + 1 AS col, 'key' AS kind, n AS name FROM (SELECT *, trim(regexp_extract(t, '^"(.*)"\\s*:$', 1)) AS n FROM s WHERE ends_with(t, ':')) WHERE {key_ok}"""

    @reg.query("json_keys", json_sql)
    def json_keys(spark, d):
        return X.line_landmarks(texts(spark, d)).filter((F.col("lang") == "json") & (F.col("kind") == "key")).select("path", "line", "col", "kind", "name")

    run = lambda stop: rf"""^((?:[^"'{stop}\\]|\\.|"[^"\\]*(?:\\.[^"\\]*)*"?|'[^'\\]*(?:\\.[^'\\]*)*'?)*)""".replace("'", "''")
    bare = lambda c: f"trim(regexp_replace(trim({c}, ' ' || chr(9)), '^(?:\"(.*)\"|''(.*)'')$', '\\1\\2'), ' ' || chr(9))"
    named = lambda c: f"CASE WHEN NOT regexp_matches(trim({c}, ' ' || chr(9)), '^[#?]') AND regexp_matches({bare(c)}, '^[A-Za-z0-9_\\-.$@:]+$') AND regexp_matches({bare(c)}, '[A-Za-z0-9]') THEN {bare(c)} END"
    lead = lambda c: f"strlen(regexp_extract({c}, '^(\\s*)', 1))"
    config_todo = " UNION ALL ".join(f"SELECT path, line_no, lang, line, strlen(split_part(line, '{w}', 1)) + 1 AS col, '{w.lower()}' AS kind, '{w}' AS name FROM u WHERE contains(line, '{w}')" for w in ("TODO", "FIXME"))
    config_sql = f"""WITH {LINES}, u AS (SELECT path, line_no, lang, line, regexp_extract(line, '{run('#')}', 1) AS body FROM lines WHERE lang IN ('toml', 'yaml', 'yml')),
      a AS (SELECT *, regexp_extract(body, '^\\s*(.*)$', 1) AS t, CASE WHEN regexp_matches(body, '{run('=')}=') THEN regexp_extract(body, '{run('=')}=', 1) END AS before FROM u WHERE lang = 'toml'),
      b AS (SELECT *, CASE WHEN starts_with(t, '[[') THEN regexp_extract(t, '^\\[\\[(.*?)\\]\\]', 1) WHEN starts_with(t, '[') THEN regexp_extract(t, '^\\[(.*?)\\]', 1) END AS inside FROM a),
      c AS (SELECT *, {named('inside')} AS tb, {named('before')} AS key FROM b),
      y AS (SELECT *, regexp_extract(body, '^\\s*(.*)$', 1) AS t0 FROM u WHERE lang IN ('yaml', 'yml')), y1 AS (SELECT *, regexp_extract(t0, '^(- \\s*)', 1) AS dash FROM y), y2 AS (SELECT *, substr(t0, length(dash) + 1) AS c FROM y1),
      y3 AS (SELECT *, CASE WHEN regexp_matches(c, '{run(':')}:') THEN regexp_extract(c, '{run(':')}:', 1) END AS before FROM y2), y4 AS (SELECT *, {named('before')} AS key, trim(substr(c, length(before) + 2), ' ' || chr(9)) AS value FROM y3),
      f AS (SELECT path, line_no, lang, line, {lead('body')} + CASE WHEN starts_with(t, '[[') THEN 2 ELSE 1 END + {lead('inside')} + 1 AS col, 'table' AS kind, tb AS name FROM c WHERE starts_with(t, '[') AND tb IS NOT NULL
        UNION ALL SELECT path, line_no, lang, line, {lead('before')} + 1, 'key', key FROM c WHERE key IS NOT NULL AND NOT (starts_with(t, '[') AND tb IS NOT NULL)
        UNION ALL SELECT path, line_no, lang, line, {lead('body')} + strlen(dash) + {lead('before')} + 1, CASE WHEN value = '' THEN 'section' ELSE 'key' END, key FROM y4 WHERE key IS NOT NULL AND c NOT IN ('', '---', '...')
        UNION ALL {config_todo})
      SELECT path, line_no::INTEGER AS line, col::INTEGER AS col, lang, kind, name, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text, 'extras' AS source FROM f"""
    reg.query("config_keys", config_sql)(lambda spark, d: X.line_landmarks(texts(spark, d)).filter(F.col("lang").isin("toml", "yaml", "yml")))
    reg.query("line_landmarks")(lambda spark, d: X.line_landmarks(texts(spark, d)))
    reg.query("parsed_symbols")(lambda spark, d: symbols.symbols(texts(spark, d)))
    reg.query("call_references")(lambda spark, d: symbols.syntax_refs(texts(spark, d)))
    reg.query("line_imports")(lambda spark, d: X.line_imports(texts(spark, d)))

    py_sql = f"""WITH {LINES}, p AS (SELECT path, line_no, line, regexp_extract(line, '^(\\s*from .*? import |\\s*import )', 1) AS head FROM lines WHERE lang = 'py'),
      q AS (SELECT *, string_split(substr(line, length(head) + 1), ',') AS parts FROM p WHERE head <> ''),
      r AS (SELECT path, line_no, parts[k] AS part, strlen(head) + coalesce(list_sum(list_transform(parts[1:k-1], lambda x: strlen(x) + 1)), 0) AS base FROM (SELECT *, unnest(generate_series(1, len(parts))) AS k FROM q)),
      z AS (SELECT path, line_no, (base + strlen(regexp_extract(part, '^(\\s*)', 1)) + 1)::INTEGER AS col, regexp_extract(regexp_extract(trim(part), '^(\\S*)', 1), '[^.]*$') AS name FROM r)
      SELECT path AS from_path, line_no::INTEGER AS from_line, col AS from_col, name AS to_name FROM z WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_-]*$') AND {Q.low('name')} NOT IN {STOP}"""

    @reg.query("python_imports", py_sql)
    def python_imports(spark, d):
        return X.line_imports(texts(spark, d).filter(F.col("path").endswith(".py"))).select("from_path", "from_line", "from_col", "to_name")

    style_token = r"\.[A-Za-z_-][A-Za-z0-9_-]*|--[A-Za-z0-9_-]+"
    usage_sql = f"""WITH {LINES}, {spans('c', style_token, where_css)}, {links_sql}
      SELECT path AS from_path, line_no::INTEGER AS from_line, col AS from_col, t AS to_name, CASE WHEN starts_with(t, '.') THEN 'css_class' ELSE 'css_variable' END AS to_kind, 'css_usage' AS ref_kind FROM c WHERE {Q.low('t')} NOT IN {STOP}
      UNION ALL SELECT path, line_no::INTEGER, col, name, 'link', 'markdown_link' FROM l WHERE {Q.low('name')} NOT IN {STOP}"""

    @reg.query("structured_references", usage_sql)
    def structured_references(spark, d):
        return X.structured_refs(texts(spark, d)).select("from_path", "from_line", "from_col", "to_name", "to_kind", "ref_kind")

    is_test = f"({Q.dirs(Q.norm('path'), 'tests', 'test', '__tests__')} OR {Q.has(Q.base(Q.norm('path')), '_test', '.test.', '.spec.')})"
    text_sql = f"""WITH {LINES}, {spans('s', '[A-Za-z0-9_]+')},
      tg AS (SELECT name, min({{'path': path, 'line': line, 'col': col, 'kind': kind}}).kind AS to_kind FROM records WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]{{2,}}$') AND {Q.low('name')} NOT IN {STOP} GROUP BY name)
      SELECT path AS from_path, line_no::INTEGER AS from_line, s.col AS from_col, t AS to_name, to_kind, CASE WHEN {is_test} THEN 'test_reference' ELSE 'text_reference' END AS ref_kind
      FROM s JOIN tg ON tg.name = s.t WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.path = s.path AND r.line = s.line_no AND r.col = s.col AND r.name = s.t)"""

    @reg.query("text_references", text_sql)
    def text_references(spark, d):
        return X.text_references(texts(spark, d), table(spark, d, "records")).select("from_path", "from_line", "from_col", "to_name", "to_kind", "ref_kind")

    local = "('class','constant','enum','function','interface','method','module','struct','trait','type','variable')"

    @reg.query(
        "enriched_references",
        f"""WITH k AS (SELECT DISTINCT name FROM records WHERE kind IN {local} AND source = 'tree_sitter'), e AS (SELECT r.*, ref_kind IN ('import','export','call','type_reference') AND to_name IN (SELECT name FROM k WHERE name IS NOT NULL) AS x FROM refs r)
        SELECT * EXCLUDE (x) REPLACE (CASE WHEN x THEN 'exact_local' ELSE confidence END AS confidence, CASE WHEN x THEN 'local_symbol_match' ELSE reason END AS reason) FROM e""",
    )
    def enriched_references(spark, d):
        return X.enrich(table(spark, d, "refs"), table(spark, d, "records"))

    @reg.query(
        "module_references",
        f"""WITH k AS (SELECT DISTINCT path FROM records WHERE kind IN {local} AND source = 'tree_sitter')
        SELECT from_path, from_line, from_col, coalesce(target_path, import_path) AS to_name, CASE WHEN target_path IS NOT NULL THEN 'file' ELSE 'module' END AS to_kind, 'module_dependency' AS ref_kind,
          CASE WHEN target_path IS NOT NULL THEN 'dependency' ELSE 'unresolved' END AS confidence,
          CASE WHEN target_path IN (SELECT path FROM k) THEN 'dependency_graph_resolved_file' WHEN target_path IS NOT NULL THEN 'dependency_graph_resolved_path' ELSE coalesce(unresolved_reason, 'dependency_unresolved') END AS reason,
          CASE WHEN length(ev) > 120 THEN left(ev, 119) || '…' ELSE ev END AS evidence, 'dependency_graph' AS source FROM (SELECT *, trim(regexp_replace(evidence, '\\s+', ' ', 'g')) AS ev FROM dependencies)""",
    )
    def module_references(spark, d):
        return X.refs_from_dependencies(table(spark, d, "dependencies"), table(spark, d, "records"))

    @reg.query("file_reference_scan")
    def file_reference_scan(spark, d):
        """Candidates of all texts, resolved against all known paths."""
        return file_refs.resolve(X.scan_file_references(texts(spark, d)), table(spark, d, "files"))

    js_sql = """WITH e AS (SELECT DISTINCT from_path, import_path FROM dependencies WHERE starts_with(import_path, './')),
      p AS (SELECT *, CASE WHEN contains(from_path, '/') THEN regexp_replace(from_path, '/[^/]*$', '') ELSE '' END AS here FROM e),
      b AS (SELECT *, array_to_string(list_filter(string_split(here || '/' || import_path, '/'), lambda x: x NOT IN ('', '.')), '/') AS base FROM p),
      c AS (SELECT from_path, import_path, unnest(CASE WHEN regexp_matches(regexp_extract(import_path, '[^/]*$'), '^.+\\.[^.]+$') THEN [base]
        ELSE list_concat([base], list_concat(list_transform(['ts','tsx','js','jsx','mjs','cjs','json'], lambda x: base || '.' || x), list_transform(['ts','tsx','js','jsx','mjs','cjs','json'], lambda x: base || '/index.' || x))) END) AS key FROM b),
      h AS (SELECT from_path, import_path, count(DISTINCT f.path) AS n, min(f.path) AS p FROM c JOIN (SELECT DISTINCT path FROM files) f ON f.path = c.key GROUP BY 1, 2)
      SELECT e.from_path, e.import_path, CASE WHEN n = 1 THEN h.p END AS target_path, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS confidence,
        CASE WHEN n = 1 THEN NULL WHEN n > 1 THEN 'ambiguous_match' ELSE 'target_not_found' END AS unresolved_reason FROM e LEFT JOIN h ON h.from_path = e.from_path AND h.import_path = e.import_path"""

    @reg.query("resolve_relative_imports", js_sql)
    def resolve_relative_imports(spark, d):
        """All relative imports, ./ and ../, of the edge table by the JavaScript rules, over all known paths."""
        e = table(spark, d, "dependencies").filter(F.col("import_path").startswith("./") | F.col("import_path").startswith("../")).select("from_path", "import_path").distinct()
        e = e.select("from_path", F.lit(1).alias("from_line"), F.lit(1).alias("from_col"), "import_path", F.lit("js_import").alias("dependency_kind"), F.lit("js").alias("lang"), F.lit("").alias("evidence"), F.lit("x").alias("source"))
        return resolve.resolve(e, table(spark, d, "files")).select("from_path", "import_path", "target_path", "confidence", "unresolved_reason")

    suffix_sql = """WITH f AS (SELECT DISTINCT path, string_split(path, '/') AS p FROM files), s AS (SELECT path, array_to_string(p[k:], '/') AS key FROM (SELECT *, unnest(generate_series(1, len(p))) AS k FROM f)),
      b AS (SELECT DISTINCT regexp_extract(import_path, '[^/]*$') AS stem FROM dependencies)
      SELECT stem, count(DISTINCT path) AS n, min(path) AS first_path FROM b JOIN s ON s.key = b.stem || '.py' GROUP BY stem"""

    @reg.query("suffix_join", suffix_sql)
    def suffix_join(spark, d):
        """Which paths end in /NAME.py for the last name of each import: an equi-join on exploded suffixes."""
        b = table(spark, d, "dependencies").select(F.substring_index("import_path", "/", -1).alias("stem")).distinct()
        keys = resolve.path_keys(table(spark, d, "files")).filter(F.col("mode") == "suffix")
        return b.join(keys, F.concat("stem", F.lit(".py")) == F.col("key")).groupBy("stem").agg(F.count_distinct("path").alias("n"), F.min("path").alias("first_path"))

    @reg.query("dependency_edges")
    def dependency_edges(spark, d):
        """Edges of all texts: parsed imports and scanned statements, resolved over all known paths."""
        t = texts(spark, d)
        return resolve.resolve(resolve.edges_from_imports(symbols.symbols(t)).unionByName(resolve.scanned_edges(t)), table(spark, d, "files"))
