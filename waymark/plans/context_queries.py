"""Queries: references, impact groups, pack and impact of a search term; deduplication and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import ranks
from waymark.operators import caps
from waymark.operators import context as C
from waymark.operators import file_refs
from waymark.plans import sqltext as Q
from waymark.registry import Registry, table

TERM = "config"
DIRECT = "('class','constant','css_class','css_id','css_variable','data_attribute','enum','function','html_class','html_id','html_tag','interface','key','keyframes','method','module','section','struct','table','trait','type','variable')"
IMPORTS = "('import','export','include','require','source')"
CONF = "CASE WHEN confidence IN ('direct','exact_local','semantic') THEN 0 WHEN confidence IN ('dependency','resolved') THEN 1 WHEN confidence IN ('syntax','test-related') THEN 2 WHEN confidence IN ('ambiguous','heuristic') THEN 3 WHEN confidence = 'unresolved' THEN 4 ELSE 3 END"

FILE_REFS = """fr AS (
  SELECT source_path, source_line, source_col, raw_target, target_path, reference_kind, lang, confidence, unresolved_reason, evidence, 'dependency_graph' AS source FROM (
    SELECT *, row_number() OVER (PARTITION BY source_path, raw_target, reference_kind ORDER BY source_line, source_col, cr, target_path NULLS FIRST, lang, confidence, unresolved_reason NULLS FIRST, evidence) AS rn FROM (
      SELECT from_path AS source_path, from_line AS source_line, from_col AS source_col, import_path AS raw_target, target_path,
        CASE WHEN contains(dependency_kind, 'include') THEN 'include' WHEN contains(dependency_kind, 'export') THEN 'export' WHEN contains(dependency_kind, 'require') THEN 'require' WHEN contains(dependency_kind, 'source') THEN 'source' ELSE 'import' END AS reference_kind,
        lang, confidence, unresolved_reason, CASE WHEN length(ev) > 120 THEN left(ev, 119) || '…' ELSE ev END AS evidence,
        CASE confidence WHEN 'resolved' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'unresolved' THEN 2 ELSE 3 END AS cr
      FROM (SELECT *, trim(regexp_replace(evidence, '\\s+', ' ', 'g')) AS ev FROM dependencies WHERE unresolved_reason IS NULL OR unresolved_reason NOT IN ('external_package', 'system_include')))) WHERE rn = 1)"""


def prim(term: str) -> str:
    return f"""prim AS ({Q.search(term, limit=3)}), dp AS (SELECT * FROM prim WHERE kind IN {DIRECT} OR NOT EXISTS (SELECT 1 FROM prim WHERE kind IN {DIRECT}))"""


def refs(src: str, term: str) -> str:
    """References that match the primaries of CTE ``src``."""
    return f"""(SELECT * FROM refs r WHERE r.to_name IN (SELECT name FROM {src} UNION ALL SELECT '{term}' FROM {src})
      AND NOT (r.ref_kind = 'text_reference' AND EXISTS (SELECT 1 FROM {src} p WHERE p.path = r.from_path AND p.line = r.from_line AND p.name = r.to_name)))"""


def roles(path: str) -> str:
    return Q.role(path)


def refs_of_sql(term: str) -> str:
    return f"""WITH {prim(term)}, {FILE_REFS},
      sym AS (SELECT 'symbol' AS producer, from_path AS path, from_line AS line, from_col AS col, ref_kind AS kind, to_name AS target, confidence, reason, evidence,
        CASE WHEN ref_kind IN ('import','export','call','type_reference') THEN 0 WHEN ref_kind = 'module_dependency' AND confidence <> 'unresolved' THEN 1 WHEN ref_kind IN ('markdown_link','css_usage','html_usage') THEN 3
          WHEN ref_kind = 'test_reference' THEN 4 WHEN ref_kind = 'module_dependency' THEN 6 WHEN ref_kind = 'text_reference' THEN 8 ELSE 5 END AS evidence_priority,
        CASE WHEN {Q.fixture('from_path')} THEN 5 WHEN ref_kind = 'test_reference' THEN 2 WHEN ref_kind = 'import' THEN 1 WHEN ref_kind = 'markdown_link' THEN 3 WHEN ref_kind IN ('css_usage','html_usage') THEN 4 WHEN {roles('from_path')} = 'test' THEN 2 ELSE 0 END AS rank
        FROM {refs('prim', term)}),
      fil AS (SELECT 'file' AS producer, source_path AS path, source_line AS line, source_col AS col, reference_kind AS kind, raw_target AS target, confidence,
        CASE WHEN target_path IS NOT NULL THEN reference_kind || ' resolves to ' || target_path ELSE 'unresolved ' || reference_kind || ': ' || coalesce(unresolved_reason, 'unknown') END AS reason, evidence,
        CASE WHEN target_path IS NULL THEN 7 WHEN reference_kind IN {IMPORTS} THEN 1 WHEN reference_kind IN ('script','stylesheet') THEN 2 WHEN reference_kind IN ('asset','fixture') THEN 3 WHEN reference_kind = 'link' THEN 4 ELSE 5 END AS evidence_priority,
        CASE WHEN {Q.fixture('source_path')} OR reference_kind = 'fixture' THEN 5 WHEN reference_kind IN {IMPORTS} THEN 1 WHEN reference_kind = 'link' THEN 3 WHEN reference_kind IN ('asset','script','stylesheet') THEN 4 WHEN {roles('source_path')} = 'test' THEN 2 ELSE 0 END AS rank
        FROM fr WHERE target_path IN (SELECT path FROM dp) AND source_path NOT IN (SELECT path FROM dp)),
      a AS (SELECT *, {roles('path')} AS role FROM (SELECT * FROM sym UNION ALL SELECT * FROM fil))
      SELECT producer, path, line, col, kind, target, confidence, reason, evidence, evidence_priority, rank FROM a
      ORDER BY {CONF}, evidence_priority, rank, {Q.context_penalty('path', 'role')}, path, line, col, kind, target, producer DESC, confidence, reason NULLS FIRST, evidence LIMIT 20"""


def impact_ctes(term: str) -> str:
    pp = "(SELECT path FROM dp)"
    role = roles("from_path")
    return f"""WITH {prim(term)}, {FILE_REFS},
      rr AS (SELECT *, {role} AS role, {Q.fixture('from_path')} AS fix FROM {refs('dp', term)}),
      rg AS (SELECT *, CASE WHEN ref_kind = 'test_reference' OR role = 'test' THEN 'Tests' WHEN ref_kind = 'module_dependency' THEN CASE WHEN confidence = 'unresolved' THEN 'Unknown' ELSE 'Dependents' END
          WHEN ref_kind = 'markdown_link' OR role = 'docs' THEN 'Docs' WHEN role IN ('build','package_manifest','config') THEN 'Config' WHEN fix OR role IN ('generated','vendor') THEN 'Unknown' ELSE 'References' END AS grp FROM rr),
      i1 AS (SELECT grp, from_path AS path, from_line AS line, from_col AS col, ref_kind AS kind, to_name AS target,
          CASE WHEN confidence = 'semantic' THEN 'semantic' WHEN grp = 'Tests' THEN 'test-related' WHEN grp = 'Dependents' THEN 'dependency' WHEN grp = 'References' AND confidence = 'exact_local' THEN 'direct' ELSE 'heuristic' END AS confidence,
          CASE grp WHEN 'Tests' THEN 'test references ' WHEN 'Dependents' THEN 'dependency reference to ' WHEN 'Docs' THEN 'docs reference ' WHEN 'Config' THEN 'build/config reference '
            WHEN 'Unknown' THEN CASE WHEN confidence = 'unresolved' THEN 'unresolved dependency ' ELSE 'unknown impact from ' END
            ELSE CASE ref_kind WHEN 'import' THEN 'imports ' WHEN 'call' THEN 'calls ' WHEN 'export' THEN 'exports ' WHEN 'type_reference' THEN 'type reference to ' WHEN 'text_reference' THEN 'references ' ELSE ref_kind || ' to ' END END || to_name AS reason,
          CASE grp WHEN 'Tests' THEN CASE WHEN ref_kind = 'test_reference' THEN 0 WHEN ref_kind IN ('call','import') THEN 1 ELSE 2 END WHEN 'References' THEN CASE ref_kind WHEN 'import' THEN 0 WHEN 'call' THEN 1 WHEN 'type_reference' THEN 2 WHEN 'text_reference' THEN 5 ELSE 8 END
            WHEN 'Dependents' THEN 0 WHEN 'Config' THEN 0 WHEN 'Docs' THEN CASE WHEN ref_kind = 'markdown_link' THEN 0 ELSE 2 END ELSE CASE WHEN fix THEN 20 ELSE 10 END END AS priority FROM rg),
      dd AS (SELECT *, CASE WHEN {role} = 'test' THEN 'Tests' WHEN {Q.fixture('from_path')} THEN 'Unknown' ELSE 'Dependents' END AS g FROM dependencies WHERE target_path IN {pp}),
      i2 AS (SELECT g, from_path, from_line, from_col, dependency_kind, target_path, CASE g WHEN 'Tests' THEN 'test-related' WHEN 'Unknown' THEN 'heuristic' ELSE 'dependency' END,
          CASE g WHEN 'Tests' THEN 'test dependency imports ' WHEN 'Unknown' THEN 'fixture/example dependency imports ' ELSE 'dependency imports ' END || target_path, CASE g WHEN 'Unknown' THEN 20 ELSE 0 END FROM dd
        UNION ALL SELECT 'Unknown', from_path, from_line, from_col, dependency_kind, import_path, 'heuristic', 'unresolved dependency: ' || unresolved_reason, 10 FROM dependencies WHERE from_path IN {pp} AND target_path IS NULL AND unresolved_reason IS NOT NULL
        UNION ALL SELECT 'Unknown', from_path, from_line, from_col, dependency_kind, import_path, 'heuristic', 'dependent file has unresolved dependency: ' || unresolved_reason, 20 FROM dependencies WHERE from_path IN (SELECT from_path FROM dd) AND target_path IS NULL AND unresolved_reason IS NOT NULL),
      ff AS (SELECT *, {roles('source_path')} AS role, {Q.fixture('source_path')} AS fix FROM fr WHERE target_path IN {pp}),
      i3 AS (SELECT CASE WHEN fix THEN 'Unknown' WHEN reference_kind = 'fixture' OR role = 'test' THEN 'Tests' WHEN reference_kind IN {IMPORTS} THEN 'Dependents' WHEN reference_kind = 'link' OR role = 'docs' THEN 'Docs'
            WHEN reference_kind IN ('config_path','package_entry') OR role IN ('build','package_manifest','config') THEN 'Config' ELSE 'References' END, source_path, source_line, source_col, 'file_' || reference_kind, target_path,
          CASE WHEN role = 'test' OR reference_kind = 'fixture' THEN 'test-related' WHEN reference_kind IN {IMPORTS} AND confidence = 'resolved' THEN 'dependency' ELSE 'heuristic' END, reference_kind || ' file reference to ' || target_path,
          CASE WHEN reference_kind IN {IMPORTS} THEN 0 WHEN reference_kind IN ('script','stylesheet') THEN 1 WHEN reference_kind IN ('asset','fixture') THEN 2 WHEN reference_kind IN ('config_path','package_entry') THEN 3 WHEN reference_kind = 'link' THEN 4 ELSE 8 END FROM ff
        UNION ALL SELECT 'Unknown', source_path, source_line, source_col, 'file_' || reference_kind, raw_target, 'heuristic', 'unresolved file reference: ' || unresolved_reason, 10 FROM fr WHERE source_path IN {pp} AND target_path IS NULL AND unresolved_reason IS NOT NULL
        UNION ALL SELECT 'Unknown', source_path, source_line, source_col, 'file_' || reference_kind, raw_target, 'heuristic', 'dependent file has unresolved file reference: ' || unresolved_reason, 20 FROM fr WHERE source_path IN (SELECT source_path FROM ff) AND target_path IS NULL AND unresolved_reason IS NOT NULL),
      firsts AS (SELECT path, r.line AS line, r.col AS col, r.name AS name, {roles('path')} AS role FROM (SELECT path, min({{'line': line, 'col': col, 'kind': kind, 'name': name}}) AS r FROM records GROUP BY path)),
      needles AS (SELECT DISTINCT n FROM (SELECT regexp_replace({Q.low("regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')")}, '[^a-z0-9]', '', 'g') AS n FROM dp UNION ALL SELECT regexp_replace({Q.low('name')}, '[^a-z0-9]', '', 'g') FROM dp UNION ALL SELECT '{term.lower()}' FROM dp) WHERE n <> ''),
      i4 AS (SELECT 'Tests', path, line, col, 'test_mapping', name, 'test-related', 'same-name test convention', 5 FROM firsts WHERE role = 'test' AND EXISTS (SELECT 1 FROM needles WHERE contains(regexp_replace({Q.low('path')}, '[^a-z0-9]', '', 'g'), n))),
      roots AS (SELECT list_sort(list(DISTINCT split_part(path, '/', 1))) AS roots FROM dp WHERE {roles('path')} IN ('source','test')),
      i5 AS (SELECT 'Config', path, line, col, 'file_role:' || role, array_to_string(roots, ','), 'heuristic', role || ' applies to source area', CASE WHEN role = 'package_manifest' THEN 0 WHEN role = 'build' AND starts_with({Q.norm('path')}, '.github/') THEN 4 WHEN role = 'build' THEN 1 ELSE 3 END
        FROM firsts, roots WHERE len(roots) > 0 AND path NOT IN {pp} AND ((role IN ('package_manifest','build') AND (NOT contains(path, '/') OR starts_with({Q.norm('path')}, '.github/workflows/') OR list_contains(roots, split_part({Q.norm('path')}, '/', 1))))
          OR (role = 'config' AND (regexp_matches({Q.norm('path')}, '^(config|configs|routes|schemas)/') OR list_contains(roots, split_part({Q.norm('path')}, '/', 1)))))),
      allrows AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2 UNION ALL SELECT * FROM i3 UNION ALL SELECT * FROM i4 UNION ALL SELECT * FROM i5)"""


def taken_sql(term: str, groups: tuple[tuple[str, int], ...], total: str, source: str, key: str, extra: str = "") -> str:
    """Chained group takes; each step skips paths that earlier steps used."""
    steps, used, before = [], "SELECT path FROM dp", "0"
    for k, (g, n) in enumerate(groups):
        steps.append(
            f"""t{k} AS (SELECT * EXCLUDE (rn, pn) FROM (SELECT *, row_number() OVER (ORDER BY {key}) AS rn FROM (
              SELECT *, row_number() OVER (PARTITION BY path ORDER BY {key}) AS pn FROM {source} WHERE grp = '{g}' AND path NOT IN ({used})) WHERE pn = 1) WHERE rn <= least({n}, {total} - ({before})))"""
        )
        used += f" UNION ALL SELECT path FROM t{k}"
        before += f" + (SELECT count(*) FROM t{k})"
    cols = "grp, path, line, col, kind, target, confidence, reason, priority" + extra
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {cols} FROM t{k}" for k in range(len(groups)))


PENALTY_KEY = Q.context_penalty("path", "prole")


def impact_sql(term: str) -> str:
    key = f"priority, {PENALTY_KEY}, path, line, col, kind, target, confidence, reason"
    return impact_ctes(term) + f", src AS (SELECT *, {roles('path')} AS prole FROM allrows), " + taken_sql(term, C.IMPACT_GROUPS, "15", "src", key)


def pack_sql(term: str) -> str:
    key = f"priority, {CONF}, {PENALTY_KEY}, ref_count DESC, path, line, col, kind, target, confidence, reason"
    place = "|| ':' || from_line"
    return (
        impact_ctes(term)
        + f""", cnt AS (SELECT from_path AS path, count(*) AS ref_count FROM {refs('dp', term)} GROUP BY 1),
      near AS (SELECT CASE WHEN grp = 'Unknown' THEN CASE WHEN {roles('path')} IN ('docs','generated','vendor') OR {Q.fixture('path')} THEN 'Docs' ELSE 'Unresolved' END ELSE grp END AS grp, path, line, col, kind, target, confidence, reason, priority, coalesce(ref_count, 0) AS ref_count FROM allrows LEFT JOIN cnt USING (path)),
      far AS (SELECT 'Dependencies' AS grp, target_path AS path, coalesce(line, 1) AS line, coalesce(col, 1) AS col, dependency_kind AS kind, coalesce(name, import_path) AS target, 'dependency' AS confidence, 'primary dependency imported at ' || from_path {place} AS reason, 0 AS priority, 0 AS ref_count
          FROM dependencies LEFT JOIN firsts ON firsts.path = target_path WHERE from_path IN (SELECT path FROM dp) AND target_path IS NOT NULL AND target_path NOT IN (SELECT path FROM dp)
        UNION ALL SELECT 'Dependencies', target_path, coalesce(line, 1), coalesce(col, 1), 'file_' || reference_kind, coalesce(name, raw_target), CASE WHEN {roles('source_path')} = 'test' OR reference_kind = 'fixture' THEN 'test-related' WHEN reference_kind IN {IMPORTS} AND confidence = 'resolved' THEN 'dependency' ELSE 'heuristic' END,
          'primary file ' || reference_kind || ' at ' || source_path || ':' || source_line, CASE WHEN reference_kind IN {IMPORTS} THEN 0 WHEN reference_kind IN ('script','stylesheet') THEN 1 WHEN reference_kind IN ('asset','fixture') THEN 2 WHEN reference_kind IN ('config_path','package_entry') THEN 3 WHEN reference_kind = 'link' THEN 4 ELSE 8 END, 0
          FROM fr LEFT JOIN firsts ON firsts.path = target_path WHERE source_path IN (SELECT path FROM dp) AND target_path IS NOT NULL AND target_path NOT IN (SELECT path FROM dp)),
      src AS (SELECT *, {roles('path')} AS prole FROM (SELECT * FROM near UNION ALL SELECT * FROM far)), """
        + taken_sql(term, C.PACK_GROUPS, "(10 - (SELECT count(*) FROM dp))", "src", key, ", ref_count")
        + " UNION ALL SELECT 'Primary', path, line, col, kind, name, 'direct', 'exact symbol match', 0, 0 FROM dp"
    )


def tables(spark, d) -> C.Tables:  # noqa: ANN001
    deps = table(spark, d, "dependencies")
    return C.Tables(table(spark, d, "records"), table(spark, d, "refs"), deps, file_refs.finalize(file_refs.from_dependencies(deps)))


def register(reg: Registry) -> None:
    @reg.query("refs_of", refs_of_sql(TERM))
    def refs_of(spark, d):
        return C.refs_of(tables(spark, d), TERM)

    @reg.query("refs_of_name", refs_of_sql("Config"))
    def refs_of_name(spark, d):
        return C.refs_of(tables(spark, d), "Config")

    @reg.query("impact_groups", impact_ctes(TERM) + " SELECT * FROM allrows")
    def impact_groups(spark, d):
        t = tables(spark, d)
        return C.impact_rows(t, C.primary(t, TERM).direct())

    @reg.query("impact", impact_sql(TERM))
    def impact(spark, d):
        return C.impact(tables(spark, d), TERM)

    @reg.query("pack", pack_sql(TERM))
    def pack(spark, d):
        return C.pack(tables(spark, d), TERM)

    @reg.query("file_references_from_dependencies", f"WITH {FILE_REFS} SELECT * FROM fr")
    def file_references_from_dependencies(spark, d):
        return tables(spark, d).file_references

    pref = """CASE WHEN source = 'tree_sitter' AND kind = 'section' THEN 0 WHEN source = 'extras' AND kind IN ('css_class','css_id','css_variable','keyframes','html_tag','html_id','html_class','data_attribute','jsx_class','component_usage','key','table','todo','fixme','checklist','link') THEN 0
      WHEN source = 'tree_sitter' THEN 1 WHEN source = 'extras' AND kind = 'section' THEN 2 WHEN source = 'extras' AND kind IN ('heading','markdown_heading') THEN 3 ELSE 9 END"""

    @reg.query("dedupe_locations", f"SELECT DISTINCT ON (path, line, col) path, line, col, lang, kind, name, text, source FROM records ORDER BY path, line, col, {pref}, name, lang, kind, text, source")
    def dedupe_locations(spark, d):
        return dedupe_records(table(spark, d, "records"))

    @reg.query(
        "dedupe_refs",
        "SELECT DISTINCT ON (from_path, from_line, from_col, to_name, ref_kind) * FROM refs ORDER BY from_path, from_line, from_col, to_name, ref_kind, to_kind NULLS FIRST, confidence, reason NULLS FIRST, evidence, source",
    )
    def dedupe_refs(spark, d):
        r = table(spark, d, "refs")
        return caps.keep_first(r, ["from_path", "from_line", "from_col", "to_name", "ref_kind"], ["to_kind", "confidence", "reason", "evidence", "source"])

    @reg.query(
        "dedupe_dependencies",
        "SELECT DISTINCT ON (from_path, import_path, target_path, dependency_kind) * FROM dependencies ORDER BY from_path, import_path, target_path NULLS FIRST, dependency_kind, from_line, from_col, lang, confidence, unresolved_reason NULLS FIRST, evidence, source",
    )
    def dedupe_dependencies(spark, d):
        return caps.keep_first(table(spark, d, "dependencies"), ["from_path", "import_path", "target_path", "dependency_kind"], ["from_line", "from_col", "lang", "confidence", "unresolved_reason", "evidence", "source"])

    two = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY from_path, to_name ORDER BY from_line, from_col, to_name, ref_kind, source, confidence, evidence, to_kind NULLS FIRST, reason NULLS FIRST) AS rk FROM refs),
      b AS (SELECT *, row_number() OVER (PARTITION BY from_path ORDER BY from_line, from_col, to_name, ref_kind, source, confidence, evidence, to_kind NULLS FIRST, reason NULLS FIRST) AS rf FROM a WHERE rk <= 20) SELECT * EXCLUDE (rk, rf) FROM b WHERE rf <= 50"""

    @reg.query("ref_caps_per_file", two)
    def ref_caps_per_file(spark, d):
        return caps.coupled_caps(table(spark, d, "refs"), "from_path", "to_name", caps.PER_TARGET, caps.PER_SOURCE, [*caps.REF_ORDER, "to_kind", "reason"])

    @reg.query("ref_caps_global")
    def ref_caps_global(spark, d):
        return caps.ref_caps_global(table(spark, d, "refs"))

    as_refs = "SELECT l_suppkey::VARCHAR AS source_path, l_returnflag AS reference_kind, l_orderkey::INTEGER AS source_line, l_linenumber AS source_col, l_partkey::VARCHAR AS raw_target, l_linestatus AS confidence, 'lineitem' AS source FROM lineitem"
    order = "source_line, source_col, raw_target, reference_kind, confidence, source"

    def lineitem_refs(spark, d):  # noqa: ANN001, ANN202
        return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_path"), F.col("l_returnflag").alias("reference_kind"), F.col("l_orderkey").cast("int").alias("source_line"), F.col("l_linenumber").alias("source_col"), F.col("l_partkey").cast("string").alias("raw_target"), F.col("l_linestatus").alias("confidence"), F.lit("lineitem").alias("source"))

    @reg.query("file_reference_caps", f"WITH r AS ({as_refs}), a AS (SELECT *, row_number() OVER (PARTITION BY source_path, reference_kind ORDER BY {order}) AS rk FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY {order}) AS rf FROM a WHERE rk <= 64) SELECT * EXCLUDE (rk, rf) FROM b WHERE rf <= 96")
    def file_reference_caps(spark, d):
        return caps.file_reference_caps(lineitem_refs(spark, d))

    @reg.query(
        "cap_warnings",
        f"""WITH r AS ({as_refs}), a AS (SELECT *, row_number() OVER (PARTITION BY source_path, reference_kind ORDER BY {order}) AS rk FROM r),
        b AS (SELECT *, coalesce(sum(CASE WHEN rk <= 64 THEN 1 ELSE 0 END) OVER (PARTITION BY source_path ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
        SELECT source_path, CASE WHEN before < 96 THEN reference_kind END AS reference_kind, CASE WHEN before >= 96 THEN 96 ELSE 64 END AS kept, count(*) AS dropped, CASE WHEN before >= 96 THEN 96 ELSE 64 END AS cap FROM b WHERE before >= 96 OR rk > 64 GROUP BY ALL""",
    )
    def cap_warnings(spark, d):
        return caps.cap_warnings(lineitem_refs(spark, d))

    @reg.query(
        "rank_tables",
        f"""SELECT DISTINCT kind, {Q.KIND_RANK} AS kind_rank, CASE WHEN kind IN ('function','func','f','method','m','constructor') THEN 'callable' WHEN kind IN ('class','c','struct','s','interface','trait','enum','type','typedef') THEN 'type'
          WHEN kind IN ('module','namespace','package') THEN 'module' WHEN kind IN ('constant','const','variable','var','field','property','member') THEN 'value' WHEN kind IN ('import','export') THEN 'module-edge' END AS kind_group, kind IN {DIRECT} AS direct FROM records""",
    )
    def rank_tables(spark, d):
        k = F.col("kind")
        return table(spark, d, "records").select("kind").distinct().select("kind", ranks.kind_rank(k).alias("kind_rank"), ranks.kind_group(k).alias("kind_group"), k.isin(*ranks.DIRECT_KINDS).alias("direct"))


def location_preference(kind, source):  # noqa: ANN001, ANN201
    """Which of several records at one place wins: 0 first."""
    extras0 = "css_class css_id css_variable keyframes html_tag html_id html_class data_attribute jsx_class component_usage key table todo fixme checklist link".split()
    return (
        F.when((source == "tree_sitter") & (kind == "section"), 0)
        .when((source == "extras") & kind.isin(*extras0), 0)
        .when(source == "tree_sitter", 1)
        .when((source == "extras") & (kind == "section"), 2)
        .when((source == "extras") & kind.isin("heading", "markdown_heading"), 3)
        .otherwise(9)
    )


def dedupe_records(records):  # noqa: ANN001, ANN201
    """One record per place, by location preference."""
    return caps.keep_first(records.select("path", "line", "col", "lang", "kind", "name", "text", "source"), ["path", "line", "col"], [location_preference(F.col("kind"), F.col("source")), "name", "lang", "kind", "text", "source"])
