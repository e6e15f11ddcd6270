"""Queries: frequency of every name and kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.llm.frequency import frequencies
from waymark.registry import Registry, table

TERMS_SQL = """
WITH p AS (SELECT DISTINCT 'name' AS field, name AS term, path, line, col FROM records WHERE name IS NOT NULL
           UNION ALL SELECT DISTINCT 'kind', kind, path, line, col FROM records WHERE kind IS NOT NULL),
     t AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT path) AS files FROM p GROUP BY 1, 2),
     n AS (SELECT count(DISTINCT path) AS n FROM records),
     m AS (SELECT t.*, CASE WHEN files * 20 > (SELECT n FROM n) THEN 'common' WHEN occurrences < 3 THEN 'rare' END AS mark FROM t)
"""


def register(reg: Registry) -> None:
    @reg.query("p4_frequencies", TERMS_SQL + "SELECT field, term, occurrences, files, mark FROM m")
    def p4_frequencies(spark, d):
        return frequencies(table(spark, d, "records").select("path", "line", "col", "name", "kind"), ["name", "kind"])

    @reg.query("p4_found", TERMS_SQL + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL")
    def p4_found(spark, d):
        return p4_frequencies(spark, d).filter(F.col("mark").isNotNull()).select("field", "term", "mark")
