"""Queries of the hot-key problem."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import skew
from waymark.registry import Registry, table


def register(reg: Registry) -> None:
    @reg.query(
        "p5_found",
        """
        WITH a AS (SELECT 'refs.to_name' AS field, to_name AS hot_key, count(*) AS n FROM refs GROUP BY to_name
                   UNION ALL SELECT 'records.path', path, count(*) FROM records GROUP BY path),
             t AS (SELECT field, sum(n) AS total FROM a GROUP BY field)
        SELECT a.field, a.hot_key FROM a JOIN t USING (field) WHERE a.hot_key IS NOT NULL AND a.n * 50 > t.total
        """,
    )
    def p5_found(spark, d):
        return skew.hot_keys(
            [
                ("refs.to_name", skew.table_states(table(spark, d, "refs"), "to_name")),
                ("records.path", skew.table_states(table(spark, d, "records"), "path")),
            ]
        )

    @reg.query(
        "p5_names",
        """
        WITH r AS (SELECT to_name AS key, count(*) AS n_rows, count(DISTINCT from_path) AS n_files,
                          min({'file': from_path, 'line': from_line, 'col': from_col}) AS f,
                          max({'file': from_path, 'line': from_line, 'col': from_col}) AS l
                   FROM refs WHERE to_name IS NOT NULL GROUP BY 1),
             d AS (SELECT name AS key, count(*) AS n_rows, count(DISTINCT path) AS n_files
                   FROM records WHERE name IS NOT NULL GROUP BY 1)
        SELECT r.key AS to_name, r.n_rows AS refs, r.n_files AS ref_files,
               r.f.file AS first_path, r.f.line AS first_line, r.f.col AS first_col,
               r.l.file AS last_path, r.l.line AS last_line, r.l.col AS last_col,
               coalesce(d.n_rows, 0) AS definitions, coalesce(d.n_files, 0) AS definition_files,
               r.n_rows * coalesce(d.n_rows, 0) AS pairs
        FROM r LEFT JOIN d USING (key)
        """,
    )
    def p5_names(spark, d):
        """Per referenced name: references, files, first and last place, and its pairs with definitions."""
        refs = skew.key_states(table(spark, d, "refs").select("to_name", "from_path", F.col("from_line").alias("line"), F.col("from_col").alias("col")), "to_name", "from_path", ["line", "col"])
        defs = skew.key_states(table(spark, d, "records").select("name", "path", "line", "col"), "name", "path", ["line", "col"])
        j = skew.joined_states(refs, defs, "left")
        n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
        return j.select(
            F.col("key").alias("to_name"),
            F.col("l_n_rows").alias("refs"),
            F.col("l_n_files").alias("ref_files"),
            *[F.col(f"l_{w}.{a}").alias(f"{w}_{b}") for w in ("first", "last") for a, b in (("file", "path"), ("line", "line"), ("col", "col"))],
            n("r_n_rows").alias("definitions"),
            n("r_n_files").alias("definition_files"),
            F.col("n_pairs").alias("pairs"),
        )

    @reg.query(
        "p5_paths",
        """
        WITH r AS (SELECT path AS key, count(*) AS n_rows,
                          min({'line': line, 'col': col}) AS f, max({'line': line, 'col': col}) AS l
                   FROM records WHERE path IS NOT NULL GROUP BY 1),
             q AS (SELECT from_path AS key, count(*) AS n_rows FROM refs WHERE from_path IS NOT NULL GROUP BY 1)
        SELECT r.key AS path, r.n_rows AS records, r.f.line AS first_line, r.f.col AS first_col,
               r.l.line AS last_line, r.l.col AS last_col, coalesce(q.n_rows, 0) AS refs,
               r.n_rows * coalesce(q.n_rows, 0) AS pairs
        FROM r LEFT JOIN q USING (key)
        """,
    )
    def p5_paths(spark, d):
        """Per path: records, first and last place, references from it, and the size of their join."""
        rec = skew.key_states(table(spark, d, "records").select("path", "line", "col"), "path", "path", ["line", "col"])
        refs = skew.count_states(table(spark, d, "refs"), "from_path")
        j = skew.joined_states(rec, refs, "left")
        return j.select(
            F.col("key").alias("path"),
            F.col("l_n_rows").alias("records"),
            *[F.col(f"l_{w}.{a}").alias(f"{w}_{a}") for w in ("first", "last") for a in ("line", "col")],
            F.coalesce("r_n_rows", F.lit(0).cast("bigint")).alias("refs"),
            F.col("n_pairs").alias("pairs"),
        )
