"""Text expressions with the engine's value rules: ASCII case, byte columns, Unicode trim, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
TRUNCATE_AT = 120


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def utrim(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def truncate(c: Column, width: int = TRUNCATE_AT) -> Column:
    """At most ``width`` characters; a longer text keeps width-1 and ends in an ellipsis."""
    return F.when(F.char_length(c) > width, F.concat(F.left(c, F.lit(width - 1)), F.lit("…"))).otherwise(c)


def compact(c: Column) -> Column:
    """Words joined by single spaces."""
    return F.regexp_replace(utrim(c), r"\p{IsWhite_Space}+", " ")


def byte_col(prefix: Column) -> Column:
    """1-based byte column of what follows ``prefix`` on its line."""
    return (F.octet_length(prefix) + 1).cast("int")


def line_array(text: Column) -> Column:
    """Lines without ends: split at LF, one CR dropped from each, no empty last line. Null gives null."""
    parts = F.split(text, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, r"\r$", ""))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of all lines of ``files(path, text)``; null and empty texts have none."""
    return files.select("path", F.posexplode(line_array(F.col("text"))).alias("k", "line")).select("path", (F.col("k") + 1).alias("line_no"), "line")
