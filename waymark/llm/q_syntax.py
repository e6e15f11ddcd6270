"""Queries: source files that do not parse, and their rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.llm.syntax.files import verdicts
from waymark.registry import Registry, table


LANG_NAMES = {"python": "py", "javascript": "js", "typescript": "ts", "golang": "go", "rust": "rs", "yml": "yaml", "markdown": "md"}
"""Language names by the identifier that records use most (fixed values)."""


def path_languages(records):  # noqa: ANN001, ANN201
    """(path, lang): the language most records of a path name, ties by name; two reductions, no gathered rows."""
    told = F.lower(F.trim("lang"))
    known = F.create_map(*[F.lit(x) for kv in LANG_NAMES.items() for x in kv])
    each = records.select("path", F.coalesce(known[told], told).alias("lang")).filter("path IS NOT NULL AND lang <> ''").groupBy("path", "lang").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("path").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"))


def register(reg: Registry) -> None:
    @reg.query("p3_found")
    def p3_found(spark, d):
        return verdicts(table(spark, d, "source_files")).filter(F.col("reason").isNotNull()).select("path").distinct()

    @reg.query("p3_files")
    def p3_files(spark, d):
        """Every judged file with the first fault found."""
        return verdicts(table(spark, d, "source_files"))

    @reg.query("p3_rates")
    def p3_rates(spark, d):
        """Per repository and language: judged files, invalid ones, their share, and files the quality reports hint at.

        The language is the one the path's records name, the extension where there are none.
        """
        named = table(spark, d, "repo_quality_summaries").select(F.explode("parser_errors").alias("e"))
        hint = named.select(F.regexp_extract("e", r"([^\s:,()'\"]+/[^:,()'\"]*?\.[A-Za-z]+)", 1).alias("path")).select(F.regexp_replace("path", r"^(?:\./+|/+)", "").alias("path")).distinct().withColumn("hinted", F.lit(1))
        v = verdicts(table(spark, d, "source_files")).groupBy("path", "ext").agg(F.max(F.col("reason").isNotNull().cast("int")).alias("bad"))
        v = v.join(hint, "path", "left").join(path_languages(table(spark, d, "records")), "path", "left")
        return v.groupBy(F.substring_index("path", "/", 1).alias("repository"), F.coalesce("lang", "ext").alias("lang")).agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("bad").alias("invalid"),
            F.round(F.avg("bad"), 6).alias("share"),
            F.coalesce(F.sum("hinted"), F.lit(0)).alias("hinted"),
            F.coalesce(F.sum(F.col("hinted") * F.col("bad")), F.lit(0)).alias("hinted_invalid"),
        )
