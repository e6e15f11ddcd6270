"""Queries: quality gates, comparator matching, gaps, plans and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import gate, symbols
from waymark.operators import quality as G
from waymark.plans import sqltext as Q
from waymark.registry import Registry, table

LANG = f"CASE WHEN trim(coalesce(lang, '')) = '' THEN 'unknown' ELSE {Q.low('trim(lang)')} END"
QPATH = lambda c: f"regexp_replace(replace({c}, '\\', '/'), '^\\./', '')"
EMPTY = lambda *n: " OR ".join(f"coalesce({x}, '') = ''" for x in n)
EXPECTED = [("py", None, "function", "config"), (None, None, None, "Config"), ("rs", None, "struct", "NoSuchName"), (None, "nowhere/x.py", None, "config")]
PATTERNS = [
    {"name_regex": "^load_", "min_count": 1, "language": "py", "kind": "function"},
    {"name_regex": "Ledger$", "min_count": 100_000_000},
    {"name_regex": "^[A-Z]", "min_count": 1, "path_glob": "**/tests/**", "kind": "class"},
]
THRESHOLDS = [("py", 1, 0, 0), ("ts", 100_000_000, None, None), ("cobol", 1, None, None)]
METRICS = f"""r AS (SELECT {LANG} AS language, {QPATH('path')} AS p, line, col, ({EMPTY('path', 'lang', 'kind', 'name', 'source')} OR coalesce(line, 0) = 0 OR coalesce(col, 0) = 0) AS bad, contains(path, '.dev_index') AS idx, source = 'ctags' AS cmp FROM records),
  d AS (SELECT *, row_number() OVER (PARTITION BY p, line, col ORDER BY language) AS rn FROM r),
  m AS (SELECT language, count(*) AS records, count(*) FILTER (rn > 1) AS duplicate_locations, count(*) FILTER (bad) AS malformed, count(*) FILTER (idx) AS index_dir_paths, count(*) FILTER (cmp) AS comparator_sources FROM d GROUP BY language)"""


def expected(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(EXPECTED, "language string, path string, kind string, name string")


def thresholds(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(THRESHOLDS, "language string, min_records int, max_duplicate_locations int, max_malformed_records int")


ABSENT = [("py", None, "function", "config"), (None, None, None, "NoSuchName")]
"""Symbols that must not be found."""


def absent(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(ABSENT, "language string, path string, kind string, name string")


def comparator_of(spark, d):  # noqa: ANN001, ANN201
    """An independent comparator: the symbols parsed from the source texts."""
    s = symbols.symbols(table(spark, d, "source_files"))
    return s.select("path", "line", F.col("col").alias("column"), "kind", "name", F.col("lang").alias("language"))


def only(df):  # noqa: ANN001, ANN201
    return df.filter(F.col("ok") & ~F.col("matched")).select("path", "line", "kind", "name", "language")


def register(reg: Registry) -> None:
    @reg.query("gate_record_metrics", f"WITH {METRICS} SELECT language, records, duplicate_locations, malformed, index_dir_paths, comparator_sources FROM m")
    def gate_record_metrics(spark, d):
        return G.record_metrics(table(spark, d, "records"))

    bad_ref = f"({EMPTY('from_path', 'to_name', 'ref_kind', 'confidence', 'reason', 'evidence', 'source')} OR coalesce(from_line, 0) = 0 OR coalesce(from_col, 0) = 0)"

    @reg.query("gate_ref_metrics", f"WITH k AS (SELECT {QPATH('from_path')} AS p, from_line, from_col, to_name, ref_kind, count(*) AS n, count(*) FILTER ({bad_ref}) AS bad, count(*) FILTER (contains(from_path, '.dev_index')) AS idx FROM refs GROUP BY 1, 2, 3, 4, 5) SELECT sum(n)::BIGINT AS refs, sum(n - 1)::BIGINT AS duplicate_refs, sum(bad)::BIGINT AS malformed_refs, sum(idx)::BIGINT AS index_dir_paths FROM k")
    def gate_ref_metrics(spark, d):
        return G.ref_metrics(table(spark, d, "refs"), table(spark, d, "records"))

    @reg.query(
        "gate_refs_by_language",
        f"""WITH k AS (SELECT {QPATH('path')} AS p, min({{'path': path, 'line': line, 'col': col, 'kind': kind, 'name': name, 'source': source, 'lang': lang}}).lang AS lang FROM records GROUP BY 1), l AS (SELECT p, {LANG} AS known FROM k),
        n AS (SELECT {QPATH('from_path')} AS p, count(*) AS n FROM refs GROUP BY 1)
        SELECT coalesce(known, nullif({Q.low("regexp_extract(regexp_extract(n.p, '[^/]*$'), '^.+[.]([^.]*)$', 1)")}, ''), 'unknown') AS language, sum(n)::BIGINT AS refs FROM n LEFT JOIN l USING (p) GROUP BY 1""",
    )
    def gate_refs_by_language(spark, d):
        return G.refs_by_language(table(spark, d, "refs"), table(spark, d, "records"))

    lit = lambda v: "NULL" if v is None else f"'{v}'"
    values = ", ".join(f"({', '.join(lit(x) for x in row)})" for row in EXPECTED)

    @reg.query(
        "gate_expected",
        f"""WITH e(language, path, kind, name) AS (SELECT * FROM (VALUES {values}) v(a, b, c, d)) SELECT e.language::VARCHAR AS language, e.path::VARCHAR AS path, e.kind::VARCHAR AS kind, e.name, count(r.path) AS matches FROM e LEFT JOIN records r ON r.name = e.name AND (e.language IS NULL OR {LANG.replace('lang', 'r.lang')} = e.language)
          AND (e.path IS NULL OR {QPATH('r.path')} = e.path) AND (e.kind IS NULL OR r.kind = e.kind) GROUP BY ALL""",
    )
    def gate_expected(spark, d):
        return G.expected_matches(expected(spark), table(spark, d, "records"))

    pats = " UNION ALL ".join(
        f"SELECT '{p['name_regex']}' AS name_regex, {p['min_count']} AS min_count, count(*) AS actual FROM records WHERE regexp_matches(name, '{p['name_regex']}')" + (f" AND {LANG} = '{p['language']}'" if p.get("language") else "") + (f" AND kind = '{p['kind']}'" if p.get("kind") else "") + (" AND (regexp_matches(path, '^.*/tests/.*$') OR regexp_matches(path, '^tests/.*$'))" if p.get("path_glob") else "")
        for p in PATTERNS
    )

    @reg.query("gate_patterns", pats)
    def gate_patterns(spark, d):
        return G.pattern_counts(PATTERNS, table(spark, d, "records"))

    th = ", ".join(f"({', '.join('NULL' if x is None else repr(x) for x in row)})" for row in THRESHOLDS)
    thr_sql = f"""WITH {METRICS}, t(language, a, b, c) AS (VALUES {th}), j AS (SELECT t.*, coalesce(m.records, 0) AS r, coalesce(m.duplicate_locations, 0) AS d, coalesce(m.malformed, 0) AS x FROM t LEFT JOIN m USING (language))
      SELECT language, 'min_records=' || a || ' actual=' || r AS message FROM j WHERE r < a UNION ALL SELECT language, 'max_duplicate_locations=' || b || ' actual=' || d FROM j WHERE d > b UNION ALL SELECT language, 'max_malformed_records=' || c || ' actual=' || x FROM j WHERE x > c"""

    @reg.query("gate_thresholds", thr_sql)
    def gate_thresholds(spark, d):
        return G.threshold_failures(thresholds(spark), gate_record_metrics(spark, d))

    @reg.query("unsupported_extensions", f"SELECT '.' || {Q.low('e')} AS extension, count(*) AS n FROM (SELECT regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1) AS e FROM records WHERE lang = 'unknown') WHERE e <> '' GROUP BY 1")
    def unsupported_extensions(spark, d):
        return G.unsupported_extensions(table(spark, d, "records"))

    @reg.query(
        "bench_integrity",
        f"""WITH r AS (SELECT count(*) AS n, count(*) FILTER ({EMPTY('path', 'lang', 'kind', 'name', 'source')} OR coalesce(line, 0) = 0) AS bad FROM records GROUP BY path, line, col, kind, name),
        f AS (SELECT count(*) AS n, count(*) FILTER ({EMPTY('from_path', 'to_name', 'ref_kind', 'confidence', 'reason', 'evidence', 'source')} OR coalesce(from_line, 0) = 0) AS bad FROM refs GROUP BY from_path, from_line, from_col, to_name, ref_kind)
        SELECT (SELECT sum(n) FROM r)::BIGINT AS records, (SELECT sum(n - 1) FROM r)::BIGINT AS duplicate_records, (SELECT sum(bad) FROM r)::BIGINT AS malformed_records, (SELECT sum(n) FROM f)::BIGINT AS refs, (SELECT sum(n - 1) FROM f)::BIGINT AS duplicate_refs, (SELECT sum(bad) FROM f)::BIGINT AS malformed_refs""",
    )
    def bench_integrity(spark, d):
        return G.bench_integrity(table(spark, d, "records"), table(spark, d, "refs"))

    @reg.query("comparator_match")
    def comparator_match(spark, d):
        r, c = G.comparator_match(table(spark, d, "records"), comparator_of(spark, d))
        return r.withColumn("side", F.lit("record")).unionByName(c.withColumn("side", F.lit("comparator")))

    @reg.query("comparison_metrics")
    def comparison_metrics(spark, d):
        return G.comparison_metrics(table(spark, d, "records"), comparator_of(spark, d))

    counter_sql = f"""WITH {METRICS}, k AS (SELECT count(*) AS n, count(*) FILTER ({bad_ref}) AS bad, count(*) FILTER (contains(from_path, '.dev_index')) AS idx FROM refs GROUP BY {QPATH('from_path')}, from_line, from_col, to_name, ref_kind),
        a AS (SELECT coalesce(sum(duplicate_locations), 0) AS d, coalesce(sum(malformed), 0) AS x, coalesce(sum(index_dir_paths), 0) AS i, coalesce(sum(comparator_sources), 0) AS c FROM m), b AS (SELECT coalesce(sum(n - 1), 0) AS d, coalesce(sum(bad), 0) AS x, coalesce(sum(idx), 0) AS i FROM k)
        SELECT unnest(['duplicate-records', 'duplicate-refs', 'malformed-records', 'malformed-refs', 'dev-index-paths', 'ctags-sources']) AS name, unnest([a.d, b.d, a.x, b.x, a.i + b.i, a.c])::BIGINT AS n FROM a, b"""

    @reg.query("gate_counters", counter_sql)
    def gate_counters(spark, d):
        return gate.counters(table(spark, d, "records"), table(spark, d, "refs"))

    lang_sql = reg.sql["gate_refs_by_language"]
    told = sorted({x[0] for x in EXPECTED + ABSENT + THRESHOLDS if x[0]} | {p["language"] for p in PATTERNS if p.get("language")})

    @reg.query("gate_languages", f"SELECT DISTINCT {LANG} AS language FROM records UNION SELECT language FROM ({lang_sql}) UNION SELECT unnest({told})")
    def gate_languages(spark, d):
        return gate.languages_checked(table(spark, d, "records"), gate_refs_by_language(spark, d), expected(spark), absent(spark), thresholds(spark), spark.createDataFrame([(p["language"],) for p in PATTERNS if p.get("language")], "language string"))

    all_values = ", ".join(f"({', '.join(lit(x) for x in row)})" for row in EXPECTED)
    top = "coalesce(nullif(array_to_string(list_transform(list_slice(list_sort(list_distinct(list(x))), 1, 3), lambda r: r.path || ':' || r.line || ':' || r.col || ' ' || r.kind || ' ' || r.name || ' (' || r.lang || ')'), '; '), ''), 'none')"
    at = "{'path': r.path, 'line': r.line, 'col': r.col, 'kind': r.kind, 'name': r.name, 'source': r.source, 'lang': r.lang}"

    @reg.query(
        "gate_nearby",
        f"""WITH e(language, path, kind, name) AS (SELECT a::VARCHAR, b::VARCHAR, c::VARCHAR, d::VARCHAR FROM (VALUES {all_values}) v(a, b, c, d)),
        h AS (SELECT e.*, {at} AS x FROM e JOIN records r ON {QPATH('r.path')} = {QPATH('e.path')} OR {LANG.replace('lang', 'r.lang')} = e.language OR r.kind = e.kind),
        f AS (SELECT e.*, {at} AS x FROM e, (SELECT * FROM records ORDER BY path, line, col, kind, name, source, lang LIMIT 3) r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.name = e.name AND h.path IS NOT DISTINCT FROM e.path AND h.kind IS NOT DISTINCT FROM e.kind AND h.language IS NOT DISTINCT FROM e.language))
        SELECT language, path, kind, name, {top} AS nearby FROM (SELECT * FROM h UNION ALL SELECT * FROM f) GROUP BY language, path, kind, name""",
    )
    def gate_nearby(spark, d):
        return gate.near(expected(spark), table(spark, d, "records"))

    gone = ", ".join(f"({', '.join(lit(x) for x in row)})" for row in ABSENT)

    @reg.query(
        "gate_absent_found",
        f"""WITH e(language, path, kind, name) AS (SELECT a::VARCHAR, b::VARCHAR, c::VARCHAR, d::VARCHAR FROM (VALUES {gone}) v(a, b, c, d)), h AS (SELECT e.*, {at} AS x FROM e JOIN records r ON r.name = e.name AND (e.language IS NULL OR {LANG.replace('lang', 'r.lang')} = e.language) AND (e.path IS NULL OR {QPATH('r.path')} = e.path) AND (e.kind IS NULL OR r.kind = e.kind))
        SELECT language, path, kind, name, {top.replace('list_distinct(list(x))', 'list(x)')} AS nearby FROM h GROUP BY language, path, kind, name""",
    )
    def gate_absent_found(spark, d):
        return gate.matching(absent(spark), table(spark, d, "records"))

    def the_gate(spark, d, compare=True):  # noqa: ANN001, ANN202
        return gate.evaluate("all", table(spark, d, "records"), table(spark, d, "refs"), expected(spark), absent(spark), PATTERNS, thresholds(spark), comparator_of(spark, d) if compare else None)

    parts = f"""SELECT 'expected symbols' AS item, {len(EXPECTED)}::BIGINT AS checked, count(*) AS failing FROM ({reg.sql['gate_expected']}) WHERE matches = 0
        UNION ALL SELECT 'expected patterns', {len(PATTERNS)}, count(*) FROM ({pats}) WHERE actual < min_count UNION ALL SELECT 'expected absent symbols', {len(ABSENT)}, count(*) FROM ({reg.sql['gate_absent_found']})
        UNION ALL SELECT 'thresholds', {len(THRESHOLDS)}, count(*) FROM ({thr_sql}) UNION ALL SELECT name, NULL, n FROM ({counter_sql})"""

    @reg.query("gate_summary", parts)
    def gate_summary(spark, d):
        return the_gate(spark, d, False).summary()

    def all_gaps(spark, d):  # noqa: ANN001, ANN202
        g = the_gate(spark, d)
        c, r = g.comparator
        return G.gaps(g.missing, g.failing, g.thresholds, g.integrity, g.extensions, c, r, g.found_absent)

    reg.query("quality_gaps")(all_gaps)
    reg.query("gap_groups")(lambda spark, d: G.gap_groups(all_gaps(spark, d)))
    reg.query("gap_summary")(lambda spark, d: G.gap_summary(all_gaps(spark, d)))
    reg.query("cycle_plan")(lambda spark, d: G.cycle_plan(all_gaps(spark, d), 5))
    reg.query("cycle_targets")(lambda spark, d: gate.change_targets(G.cycle_plan(all_gaps(spark, d), 5)))

    @reg.query("cycle_end")
    def cycle_end(spark, d):
        gaps = all_gaps(spark, d)
        return gate.finalize(G.cycle_plan(gaps, 5), gaps)

    @reg.query("quality_details")
    def quality_details(spark, d):
        g = the_gate(spark, d)
        c, r = g.comparator
        return gate.details("all", g, G.gaps(g.missing, g.failing, g.thresholds, g.integrity, g.extensions, c, r, g.found_absent))

    def all_triage(spark, d):  # noqa: ANN001, ANN202
        r, c = G.comparator_match(table(spark, d, "records"), comparator_of(spark, d))
        return G.triage(only(c), only(r))

    reg.query("triage_items")(all_triage)
    reg.query("triage_groups")(lambda spark, d: G.triage_groups(all_triage(spark, d)))
