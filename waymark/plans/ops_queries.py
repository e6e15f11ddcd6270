"""Queries: support levels and rendered results."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import search as S
from waymark.plans import ops, support
from waymark.plans import sqltext as Q
from waymark.registry import Registry, table


def register(reg: Registry) -> None:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({', '.join(lit(v) for v in row)})" for row in support.MATRIX)
    base = f"m(name, language_id, e, level, k) AS (VALUES {rows})"
    case = lambda labels: "CASE level " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in labels.items()) + " END"
    either = lambda special, labels: f"CASE WHEN name IN {support.SYNTHETIC} THEN {lit(special)} ELSE {case(labels)} END"

    @reg.query(
        "support_matrix",
        f"WITH {base} SELECT name, language_id, replace(e, ' ', ', ') AS extensions, level, {case(support.BACKENDS)} AS backend, replace(k, ' ', ', ') AS kinds, {case(support.CONFORMANCE)} AS conformance, {either(support.SYNTHETIC_REAL_REPO, support.REAL_REPO)} AS real_repo, {either(support.SYNTHETIC_EXPECTED, support.EXPECTED)} AS expected_symbols, {case(support.COMPARATOR)} AS comparator FROM m",
    )
    def support_matrix(spark, d):
        m = support.matrix(spark)
        return m.select(*[F.concat_ws(", ", c).alias(c) if c in ("extensions", "kinds") else c for c in m.columns])

    ext = f"{base}, s AS (SELECT substr(unnest(string_split(e, ' ')), 2) AS extension, level FROM m)"

    @reg.query("support_levels", f"WITH {ext} SELECT extension, level FROM s")
    def support_levels(spark, d):
        return support.levels_by_extension(spark)

    @reg.query("support_counts", f"WITH {base} SELECT level, count(*) AS n FROM m GROUP BY level")
    def support_counts(spark, d):
        return support.counts(spark)

    @reg.query("support_of_records", f"WITH {ext} SELECT coalesce(level, 'none') AS level, count(*) AS records, count(DISTINCT path) AS files FROM records LEFT JOIN s ON s.extension = records.lang GROUP BY 1")
    def support_of_records(spark, d):
        per = table(spark, d, "records").groupBy("lang", "path").agg(F.count(F.lit(1)).alias("n"))
        j = per.join(F.broadcast(support.levels_by_extension(spark).withColumnRenamed("extension", "lang")), "lang", "left")  # some 40 fixed rows
        by_path = j.groupBy(F.coalesce("level", F.lit("none")).alias("level"), "path").agg(F.sum("n").alias("n"))
        return by_path.groupBy("level").agg(F.sum("n").alias("records"), F.count("path").alias("files"))

    @reg.query("search_lines", f"SELECT path || ':' || line || ' ' || kind || ' ' || name AS line FROM ({Q.search('ledger')})")
    def search_lines(spark, d):
        return ops.search_lines(S.search(table(spark, d, "records"), "ledger"))
