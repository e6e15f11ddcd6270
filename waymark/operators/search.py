"""Ranked landmark and path search and their merge.

Filters, scores and the ranking key are column expressions, so a search is one scan with pushed-down filters
and a top-k per task; only ``limit`` rows of each task reach the driver's merge. Null names and paths match
nothing; repeated rows are ranked each; a limit of 0 means 30.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import paths
from waymark.functions.ranks import TEXT_KINDS, kind_rank
from waymark.functions.text import LOWER, UPPER, ascii_lower

DEFAULT_LIMIT = 30
STRONG = 3


@dataclass(frozen=True)
class Options:
    kind: str | None = None
    lang: str | None = None
    path: str | None = None
    source: str | None = None
    limit: int = 0

    def taken(self, default: int = DEFAULT_LIMIT) -> int:
        return self.limit or default


def low(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def word_match(c: Column, word: str) -> Column:
    """One of the words of an ASCII-lower-case text equals ``word``."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", word):
        return F.lit(False)
    return F.array_contains(F.split(c, "[^A-Za-z0-9_]", -1), word)


def camel_match(name: Column, query: str) -> Column:
    abbreviation = F.regexp_replace(name, "[^A-Z0-9]", "")
    return (abbreviation != "") & ascii_lower(abbreviation).startswith(low(query))


def match_rank(query: str, name: Column, kind: Column, text: Column) -> Column:
    """0 exact, 1 without case, 2 prefix, 3 word or camel abbreviation, 4 inside; text kinds 20, 21, 30; else null."""
    q = low(query)
    n, t = ascii_lower(name), ascii_lower(text)
    by_text = F.when(t == q, 20).when(word_match(t, q), 21).when(t.contains(q), 30)
    return F.when(name == query, 0).when(n == q, 1).when(n.startswith(q), 2).when(word_match(n, q) | camel_match(name, query), 3).when(n.contains(q), 4).when(kind.isin(*TEXT_KINDS), by_text)


def record_filters(df: DataFrame, o: Options) -> DataFrame:
    for name in ("kind", "lang", "source"):
        want = getattr(o, name)
        if want is not None:
            df = df.filter(F.col(name) == want)
    return df if o.path is None else df.filter(F.col("path").contains(o.path))


RANK_KEY = ("exact_rank", "path_penalty", "score", "kind_rank", "path_depth", "text_len", "path", "line", "col", "kind", "name", "source", "lang", "text")
RECORD = ("path", "line", "col", "lang", "kind", "name", "text", "source")


def scored(records: DataFrame, query: str, o: Options) -> DataFrame:
    """Matching records with the parts of the ranking key."""
    hit = record_filters(records.select(*RECORD), o).withColumn("score", match_rank(query.strip(), F.col("name"), F.col("kind"), F.col("text")))
    return hit.filter(F.col("score").isNotNull()).select(
        *RECORD,
        "score",
        F.when(F.col("score") <= 1, 0).otherwise(1).alias("exact_rank"),
        paths.search_penalty(F.col("path")).alias("path_penalty"),
        kind_rank(F.col("kind")).alias("kind_rank"),
        paths.path_depth(F.col("path")).alias("path_depth"),
        F.char_length("text").alias("text_len"),
    )


def search(records: DataFrame, query: str, o: Options = Options()) -> DataFrame:
    """The best records: RECORD columns and score."""
    if not query.strip():
        return records.select(*RECORD, F.lit(0).alias("score")).limit(0)
    return scored(records, query, o).orderBy(*RANK_KEY).limit(o.taken()).select(*RECORD, "score")


def file_filters(df: DataFrame, o: Options) -> DataFrame:
    if o.path is not None:
        df = df.filter(F.col("path").contains(o.path))
    if o.lang is not None:
        df = df.filter(F.coalesce(ascii_lower(paths.extension(F.col("path"))), F.lit("")) == low(o.lang.lstrip(".")))
    return df


def search_files(files: DataFrame, query: str, o: Options = Options()) -> DataFrame:
    """The best distinct paths: (path, score); several terms take the best of their ranks."""
    terms = query.split()
    if not terms or o.kind is not None or o.source is not None:
        return files.select("path", F.lit(0).alias("score")).limit(0)
    ranks = [paths.file_match_rank(F.col("path"), t) for t in terms]
    score = F.least(*ranks) if len(ranks) > 1 else ranks[0]
    hit = file_filters(files.select("path").distinct(), o).withColumn("score", score).filter(F.col("score").isNotNull())
    return hit.orderBy("score", paths.path_depth(F.col("path")), ascii_lower(F.col("path")), "path").limit(o.taken())


def search_merged(records: DataFrame, files: DataFrame, query: str, o: Options = Options()) -> DataFrame:
    """Strong records, then files without a strong record, then weak records without a listed file.

    The three parts share the limit. The file limit is what the strong part leaves, applied before paths of
    strong records are taken out, so the file part may stay short. Both searches run once; their at most
    ``limit`` rows each are merged on the driver.
    """
    n = o.taken()
    found = search(records, query, o).select("path", "line", "kind", "name", "score").collect()
    strong = [r for r in found if r["score"] <= STRONG]
    taken = {r["path"] for r in strong}
    room = n - len(strong)
    ranked = search_files(files, query, Options(o.kind, o.lang, o.path, o.source, n)).collect()[:room] if room > 0 else []
    kept = [r for r in ranked if r["path"] not in taken]
    listed = {r["path"] for r in kept}
    weak = [r for r in found if r["score"] > STRONG and r["path"] not in listed][: max(0, room - len(kept))]
    row = lambda part: lambda r: (part, r["path"], r["line"], r["kind"], r["name"], r["score"])
    out = [*map(row("strong"), strong), *(("file", r["path"], None, None, None, r["score"]) for r in kept), *map(row("weak"), weak)]
    return records.sparkSession.createDataFrame(out, "part string, path string, line int, kind string, name string, score int")
