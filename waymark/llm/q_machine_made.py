"""Queries: machine-made and third-party files."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.llm.machine_made import judge_files
from waymark.registry import Registry, table


def plain_path(c):  # noqa: ANN001, ANN201
    """A listed path without its note, leading ./ and backslashes."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.trim(c), "\\", "/"), r"\s+\([^()]*\)$", ""), r"^(?:\./+|/+)", "")


def register(reg: Registry) -> None:
    @reg.query("p2_found")
    def p2_found(spark, d):
        return judge_files(table(spark, d, "files"), table(spark, d, "source_files")).filter(F.col("reason").isNotNull()).select("path")

    @reg.query("p2_files")
    def p2_files(spark, d):
        """Every distinct path with verdict, newest size, and whether the size and quality reports name it."""
        files = table(spark, d, "files")
        verdict = judge_files(files, table(spark, d, "source_files"))
        newest = files.groupBy("path").agg(F.max_by("size", F.struct("mtime_ns", "size")).alias("size"))
        warned = table(spark, d, "file_size_warnings").groupBy(plain_path(F.col("path")).alias("path")).agg(F.max("size").alias("warned_size"))
        noisy = table(spark, d, "repo_quality_summaries").select(F.explode("slow_noisy_files").alias("p")).select(plain_path(F.col("p")).alias("path")).distinct().withColumn("slow_or_noisy", F.lit(True))
        both = verdict.join(newest, "path", "left").join(warned, "path", "left").join(noisy, "path", "left")
        return both.select("path", "reason", "shown", "suggested", "size", "warned_size", F.coalesce("slow_or_noisy", F.lit(False)).alias("slow_or_noisy"))
