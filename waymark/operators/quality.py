"""Quality gates over the tables: integrity metrics, expectations, comparator matching, gaps, plans, triage.

Duplicate counts are rows minus distinct keys, reduced where rows are read. The greedy one-to-one comparator
match needs order only among rows of one (path, name), so it runs per such key on the few rows that can match
at all; everything else is joins and aggregations.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import paths
from waymark.functions.ranks import KIND_GROUPS
from waymark.functions.text import ascii_lower, utrim
from waymark.operators.numbering import numbered
from waymark.session import cut

LINE_PROXIMITY = 3
MAX_GAPS_PER_CYCLE = 10
SEVERITY = ("critical", "high", "medium", "low")
EVIDENCE = ("expected-symbol", "expected-symbol-pattern", "expected-absent-symbol", "integrity", "quality-threshold", "comparator-only", "record-only", "unsupported-extension")
FIXES = ("parser-query", "fixture", "manifest-expected-symbol", "comparator-triage", "integrity-fix", "performance-triage", "documentation")
TRIAGE_ACTIONS = {
    "open": "triage before promoting",
    "accepted_expected_symbol": "add [[repo.expected_symbol]] or [[repo.expected_symbol_pattern]]",
    "fixture_needed": "add or extend a parser conformance fixture",
    "comparator_false_positive": "record as accepted comparator false positive",
    "unsupported_syntax": "document unsupported syntax or support-level gap",
    "low_value_noise": "leave unpromoted as low-value comparator noise",
    "fixed": "rerun quality gates and keep regression coverage",
}
"""Ranks of severities, evidence sources and fixes, and promotion actions by triage state (fixed values)."""


def language(c: Column) -> Column:
    t = utrim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "unknown").otherwise(ascii_lower(t))


def quality_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\./", "")


def dot_extension(c: Column) -> Column:
    return F.concat(F.lit("."), F.nullif(ascii_lower(paths.extension(c)), F.lit("")))


def empty(*names: str) -> Column:
    return paths.any_of([F.coalesce(F.col(n), F.lit("")) == "" for n in names])


def malformed_record(with_lang: bool = True) -> Column:
    names = ["path", "kind", "name", "source"] + (["lang"] if with_lang else [])
    return empty(*names) | (F.coalesce("line", F.lit(0)) == 0) | (F.coalesce("col", F.lit(0)) == 0)


def malformed_ref() -> Column:
    return empty("from_path", "to_name", "ref_kind", "confidence", "reason", "evidence", "source") | (F.coalesce("from_line", F.lit(0)) == 0) | (F.coalesce("from_col", F.lit(0)) == 0)


def record_metrics(records: DataFrame) -> DataFrame:
    """(language, records, duplicate_locations, malformed, index_dir_paths, comparator_sources) per language.

    A duplicate counts for the language of the later row at a place; places are compared over all languages.
    """
    r = records.select(language(F.col("lang")).alias("language"), quality_path(F.col("path")).alias("p"), "line", "col", malformed_record().alias("bad"), F.col("path").contains(".dev_index").alias("idx"), (F.col("source") == "ctags").alias("cmp"))
    sums = r.groupBy("language").agg(F.count(F.lit(1)).alias("records"), F.count_if("bad").alias("malformed"), F.count_if("idx").alias("index_dir_paths"), F.count_if("cmp").alias("comparator_sources"))
    per = r.groupBy("p", "line", "col", "language").agg(F.count(F.lit(1)).alias("n"))
    first = r.groupBy("p", "line", "col").agg(F.min("language").alias("language")).withColumn("one", F.lit(1))
    dup = per.join(first, ["p", "line", "col", "language"], "left").groupBy("language").agg(F.sum(F.col("n") - F.coalesce("one", F.lit(0))).alias("duplicate_locations"))
    return sums.join(dup, "language").select("language", "records", "duplicate_locations", "malformed", "index_dir_paths", "comparator_sources")


def unsupported_extensions(records: DataFrame) -> DataFrame:
    """Extensions of records whose language is unknown."""
    return records.filter(F.col("lang") == "unknown").select(dot_extension(F.col("path")).alias("extension")).filter(F.col("extension").isNotNull()).groupBy("extension").agg(F.count(F.lit(1)).alias("n"))


def ref_metrics(refs: DataFrame, records: DataFrame) -> DataFrame:
    """One row of totals over all references."""
    key = F.struct(quality_path(F.col("from_path")).alias("p"), "from_line", "from_col", "to_name", "ref_kind")
    counted = refs.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(malformed_ref()).alias("bad"), F.count_if(F.col("from_path").contains(".dev_index")).alias("idx"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return counted.agg(zero(F.sum("n")).alias("refs"), zero(F.sum(F.col("n") - 1)).alias("duplicate_refs"), zero(F.sum("bad")).alias("malformed_refs"), zero(F.sum("idx")).alias("index_dir_paths"))


def refs_by_language(refs: DataFrame, records: DataFrame) -> DataFrame:
    """References per language of their file: that of its first record, else its extension, else unknown."""
    known = records.groupBy(quality_path(F.col("path")).alias("p")).agg(F.min_by(language(F.col("lang")), F.struct("path", "line", "col", "kind", "name", "source", "lang")).alias("known"))
    per = refs.groupBy(quality_path(F.col("from_path")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    lang = F.coalesce("known", F.nullif(ascii_lower(paths.extension(F.col("p"))), F.lit("")), F.lit("unknown"))
    return per.join(known, "p", "left").groupBy(lang.alias("language")).agg(F.sum("n").alias("refs"))


# expectations
def glob_pattern(glob: str) -> str:
    """* and ** match any run, ? one character; a leading **/ may be absent."""
    import re

    body = lambda g: "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in g.replace("**", "*"))
    forms = {body(glob)} | ({body(glob.replace("**/", "", 1))} if "**/" in glob else set())
    return "^(?:" + "|".join(sorted(forms)) + ")$"


def expected_matches(expected: DataFrame, records: DataFrame, contains: bool = False) -> DataFrame:
    """Expected symbols (language, path, kind, name; nulls match anything) with the number of records that match."""
    e = expected.select(*[F.col(c).alias(f"e_{c}") for c in ("language", "path", "kind", "name")]).distinct()
    r = records.select(language(F.col("lang")).alias("lang"), quality_path(F.col("path")).alias("p"), "kind", "name").join(e.select(F.col("e_name").alias("name")).distinct(), "name", "left_semi")
    at = quality_path(F.col("e_path"))
    where = F.col("p").contains(at) if contains else F.col("p") == at
    kind = compatible(F.col("kind"), F.col("e_kind")) if contains else F.col("kind") == F.col("e_kind")
    on = (F.col("name") == F.col("e_name")) & (F.col("e_language").isNull() | (F.col("lang") == language(F.col("e_language")))) & (F.col("e_path").isNull() | where) & (F.col("e_kind").isNull() | kind)
    j = e.join(r, on, "left").groupBy("e_language", "e_path", "e_kind", "e_name").agg(F.count("p").alias("matches"))
    return j.select(*[F.col(f"e_{c}").alias(c) for c in ("language", "path", "kind", "name")], "matches")


def pattern_counts(patterns: list[dict], records: DataFrame) -> DataFrame:
    """(name_regex, min_count, actual) of expected patterns, all counted in one pass."""
    aggs = []
    for k, p in enumerate(patterns):
        on = F.col("name").rlike(p["name_regex"])
        if p.get("language"):
            on &= language(F.col("lang")) == p["language"].strip().lower()
        if p.get("kind"):
            on &= F.col("kind") == p["kind"]
        if p.get("path_glob"):
            on &= F.col("path").rlike(glob_pattern(p["path_glob"]))
        aggs.append(F.count_if(on).alias(f"n{k}"))
    one = records.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(p["name_regex"]).alias("name_regex"), F.lit(p["min_count"]).alias("min_count"), F.col(f"n{k}").alias("actual")) for k, p in enumerate(patterns)]))
    return one.select(rows.alias("x")).select("x.*")


def threshold_failures(thresholds: DataFrame, metrics: DataFrame) -> DataFrame:
    """(language, message) of thresholds that the per-language metrics miss."""
    m = metrics.select("language", "records", "duplicate_locations", "malformed")
    t = thresholds.withColumn("language", language(F.col("language"))).join(m, "language", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    say = lambda what, limit, c: F.concat(F.lit(f"{what}="), F.col(limit).cast("string"), F.lit(" actual="), n(c).cast("string"))
    checks = F.array_compact(
        F.array(
            F.when(n("records") < F.col("min_records"), say("min_records", "min_records", "records")),
            F.when(n("duplicate_locations") > F.col("max_duplicate_locations"), say("max_duplicate_locations", "max_duplicate_locations", "duplicate_locations")),
            F.when(n("malformed") > F.col("max_malformed_records"), say("max_malformed_records", "max_malformed_records", "malformed")),
        )
    )
    return t.select("language", F.explode(checks).alias("message"))


# comparator
def group_of(kind: Column) -> Column:
    k = ascii_lower(utrim(kind))
    out = None
    for group, names in KIND_GROUPS.items():
        out = F.when(k.isin(*names), group) if out is None else out.when(k.isin(*names), group)
    return out


def compatible(a: Column, b: Column) -> Column:
    ga, gb = group_of(a), group_of(b)
    return F.when(ga.isNotNull() & gb.isNotNull(), ga == gb).otherwise(ascii_lower(a) == ascii_lower(b))


def comparator_language(lang: Column, path: Column) -> Column:
    return F.when(lang.isNotNull(), language(lang)).otherwise(F.coalesce(F.nullif(ascii_lower(paths.extension(path)), F.lit("")), F.lit("unknown")))


def comparator_match(records: DataFrame, comparator: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``matched``: comparator rows, in order, take the nearest unused record of the same path and
    name, a compatible kind and at most three lines away; ties go to the first record."""
    group = F.coalesce(group_of(F.col("kind")), F.concat(F.lit("="), ascii_lower(F.col("kind")))).alias("g")
    r = records.select(F.lit(0).alias("side"), quality_path(F.col("path")).alias("path"), "line", "col", "kind", "name", language(F.col("lang")).alias("language"), (~malformed_record(False)).alias("ok"), group)
    c = comparator.select(F.lit(1).alias("side"), quality_path(F.col("path")).alias("path"), "line", F.col("column").alias("col"), "kind", "name", comparator_language(F.col("language"), F.col("path")).alias("language"), (~(empty("path", "kind", "name") | (F.coalesce("line", F.lit(0)) == 0))).alias("ok"), group)
    schema = "side int, path string, line int, col int, kind string, name string, language string, ok boolean, matched boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        target = pa.schema([("side", pa.int32()), ("path", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("language", pa.string()), ("ok", pa.bool_()), ("matched", pa.bool_())])
        key, held = None, []
        for b in batches:
            out = []
            for row in b.to_pylist():
                k = (row["path"], row["name"], row["g"])
                if k != key:
                    out += assign(held)
                    key, held = k, []
                held.append(row)
            yield pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in out], schema=target)
        yield pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in assign(held)], schema=target)

    # rows of one path, name and kind group meet in one task, records first; a group is part of one file. Rows
    # whose key the other side does not have match nothing and stay where they are
    both = r.select("path", "name", "g").distinct().join(c.select("path", "name", "g").distinct(), ["path", "name", "g"]).withColumn("both", F.lit(True))
    every = cut(r.unionByName(c).join(both, ["path", "name", "g"], "left"))
    alone = every.filter("both IS NULL").drop("both", "g").withColumn("matched", F.lit(False))
    rows = every.filter("both").drop("both").select(*r.columns).repartition("path", "name", "g").sortWithinPartitions("path", "name", "g", "side", "line", "col", "kind", "language")
    done = cut(rows.mapInArrow(run, schema).unionByName(alone))
    return done.filter("side = 0").drop("side"), done.filter("side = 1").drop("side")


def assign(rows: list[dict]) -> list[dict]:
    """Greedy matches inside one group of rows, records before comparator rows, each in line order."""
    own = [x for x in rows if x["side"] == 0]
    lines = [x["line"] or 0 for x in own]
    for x in rows:
        x["matched"] = False
    for x in rows:
        if x["side"] == 0 or not x["ok"]:
            continue
        lo = bisect.bisect_left(lines, x["line"] - LINE_PROXIMITY)
        best = None
        for i in range(lo, len(own)):
            if lines[i] > x["line"] + LINE_PROXIMITY:
                break
            if own[i]["ok"] and not own[i]["matched"] and (best is None or abs(lines[i] - x["line"]) < abs(lines[best] - x["line"])):
                best = i
        if best is not None:
            own[best]["matched"] = x["matched"] = True
    return rows


def comparison_metrics(records: DataFrame, comparator: DataFrame) -> DataFrame:
    """Per language: rows of both sides, matched, only on one side, unknown kinds, duplicates, malformed rows."""
    r, c = comparator_match(records, comparator)
    dup = lambda df: df.groupBy("language", "path", "line", "col", "kind", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("m"), F.count_if(~F.col("ok")).alias("bad"))
    a = dup(r).groupBy("language").agg(F.sum("n").alias("records"), F.sum("m").alias("matched"), F.sum(F.col("n") - F.col("m") - F.col("bad")).alias("record_only"), F.sum(F.col("n") - 1).alias("d1"), F.sum("bad").alias("b1"))
    b = dup(c).withColumn("unknown", F.when(group_of(F.col("kind")).isNull(), F.col("n")).otherwise(0)).groupBy("language").agg(F.sum("n").alias("comparator_records"), F.sum(F.col("n") - F.col("m") - F.col("bad")).alias("comparator_only"), F.sum("unknown").alias("unknown_kinds"), F.sum(F.col("n") - 1).alias("d2"), F.sum("bad").alias("b2"))
    z = lambda x: F.coalesce(F.col(x), F.lit(0).cast("bigint"))
    j = a.join(b, "language", "full_outer")
    return j.select("language", *[z(x).alias(x) for x in ("records", "comparator_records", "matched", "record_only", "comparator_only", "unknown_kinds")], (z("d1") + z("d2")).alias("duplicates"), (z("b1") + z("b2")).alias("malformed"))


# gaps, plans, triage
def rank(c: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0)).cast("int") - 1, F.lit(len(order)))


GAP = ("path", "language", "symbol", "kind", "pattern", "evidence_source", "severity", "suggested_fix", "detail")


def gap_rows(df: DataFrame, evidence: str, severity: str, fix: str, detail: Column, language_: Column, path: Column | None = None, symbol: Column | None = None, kind: Column | None = None, pattern: Column | None = None) -> DataFrame:
    n = F.lit(None).cast("string")
    pick = lambda c: n if c is None else c
    return df.select(pick(path).alias("path"), language_.alias("language"), pick(symbol).alias("symbol"), pick(kind).alias("kind"), pick(pattern).alias("pattern"), F.lit(evidence).alias("evidence_source"), F.lit(severity).alias("severity"), F.lit(fix).alias("suggested_fix"), detail.alias("detail"))


def gaps(missing: DataFrame, failing: DataFrame, thresholds: DataFrame, integrity: DataFrame, extensions: DataFrame, comparator_only: DataFrame | None = None, record_only: DataFrame | None = None, found_absent: DataFrame | None = None) -> DataFrame:
    """One open gap per finding with ids in insertion order: producers in turn, each in its own order."""
    unknown = F.lit("unknown")
    parts = [
        gap_rows(missing, "expected-symbol", "high", "parser-query", F.concat(F.lit("Expected symbol missing: "), "name"), F.coalesce("language", unknown), F.col("path"), F.col("name"), F.col("kind")),
        gap_rows(failing, "expected-symbol-pattern", "high", "parser-query", F.concat(F.lit("Expected symbol pattern failing: "), "name_regex"), unknown, pattern=F.col("name_regex")),
        *([] if found_absent is None else [gap_rows(found_absent, "expected-absent-symbol", "high", "parser-query", F.concat(F.lit("Expected-absent symbol found: "), "name"), F.coalesce("language", unknown), F.col("path"), F.col("name"), F.col("kind"))]),
        gap_rows(thresholds, "quality-threshold", "medium", "fixture", F.col("message"), F.col("language")),
        gap_rows(integrity.filter(F.col("n") > 0), "integrity", "critical", "integrity-fix", F.concat("name", F.lit(" count="), F.col("n").cast("string")), unknown, kind=F.col("name")),
        gap_rows(extensions, "unsupported-extension", "low", "documentation", F.concat(F.lit("Unsupported extension "), "extension", F.lit(" seen "), F.col("n").cast("string"), F.lit(" time(s)")), unknown, kind=F.col("extension")),
    ]
    for df, evidence, severity in ((comparator_only, "comparator-only", "medium"), (record_only, "record-only", "low")):
        if df is not None:
            detail = F.concat(F.lit(f"{evidence} symbol "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "kind", F.lit(" "), "name")
            parts.append(gap_rows(df, evidence, severity, "comparator-triage", detail, F.col("language"), F.col("path"), F.col("name"), F.col("kind")))
    every = reduce(DataFrame.unionByName, [p.withColumn("producer", F.lit(k)) for k, p in enumerate(parts)])
    ids = numbered(every, ["producer", "path", "language", "symbol", "kind", "pattern", "detail"])
    return ids.select(F.format_string("GAP-%04d", "n").alias("id"), *GAP, F.lit("open").alias("status"))


def gap_key() -> list[Column]:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.col("language"), F.col("evidence_source"), rank(F.col("severity"), SEVERITY), rank(F.col("suggested_fix"), FIXES), blank("path"), F.coalesce("symbol", "pattern", "detail")]


def grouped(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``position`` in its group and the group's ``size``.

    Rows are numbered over all groups in ranges, and a group's least number is taken off, so a group that holds
    most rows is still spread; nothing is collected per group.
    """
    n = numbered(df, [*by, *order])
    sizes = n.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("n").alias("_first"), F.count(F.lit(1)).alias("size"))
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return n.join(sizes, on).select(*[c for c in n.columns if c != "n"], (F.col("n") - F.col("_first") + 1).alias("position"), "size")


def gap_groups(g: DataFrame) -> DataFrame:
    """Gaps by (language, construct, severity, evidence): one row per gap with its position in the group by id."""
    construct = F.coalesce("kind", "pattern", "symbol", F.lit("general"))
    return grouped(g.select("language", construct.alias("construct"), "severity", "evidence_source", "id"), ["language", "construct", "severity", "evidence_source"], ["id"])


def gap_summary(g: DataFrame) -> DataFrame:
    """Counts by status, severity and evidence in one pass."""
    f = g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in ("status", "severity", "evidence_source")])).alias("x"))
    return f.groupBy("x.by", "x.value").agg(F.count(F.lit(1)).alias("n"))


def cycle_plan(g: DataFrame, requested: int) -> DataFrame:
    """Open gaps with ``selected``: the first actionable ones, at most ten; the rest is deferred."""
    k = min(requested, MAX_GAPS_PER_CYCLE)
    triage = (F.col("suggested_fix") == "comparator-triage") | F.col("evidence_source").isin("comparator-only", "record-only")
    actionable = ~triage & (F.col("suggested_fix") != "documentation")
    open_ = g.filter(F.col("status") == "open")
    key = [rank(F.col("severity"), SEVERITY), rank(F.col("evidence_source"), EVIDENCE), rank(F.col("suggested_fix"), FIXES), "language", F.coalesce("path", F.lit("")), "id"]
    chosen = open_.filter(actionable).orderBy(*key).limit(k).select("id", F.lit(True).alias("_s"))
    later = (F.col("evidence_source") == "unsupported-extension") | (F.col("suggested_fix") == "documentation") | F.col("detail").rlike("architecture|language expansion|unsupported syntax")
    return open_.join(F.broadcast(chosen), "id", "left").select("id", *GAP, F.coalesce("_s", F.lit(False)).alias("selected"), later.alias("needs_later_plan"))


def triage(comparator_only: DataFrame, record_only: DataFrame) -> DataFrame:
    """Open triage items with ids in sorted order."""
    side = lambda df, k, name: df.select(F.lit(k).alias("k"), F.lit(name).alias("source"), "language", "kind", "path", "line", "name")
    items = side(comparator_only, 0, "comparator-only").unionByName(side(record_only, 1, "record-only"))
    n = numbered(items, ["k", "language", "kind", "path", "line", "name"])
    return n.select(F.format_string("TRIAGE-%04d", "n").alias("id"), "source", F.lit("open").alias("state"), "language", "kind", "path", "line", "name", F.lit(TRIAGE_ACTIONS["open"]).alias("promotion"))


def triage_groups(items: DataFrame) -> DataFrame:
    """Items by (source, language, kind, path): one row per item with its position by line, name and id."""
    return grouped(items.select("source", "language", "kind", "path", "line", "name", "id"), ["source", "language", "kind", "path"], ["line", "name", "id"])


def bench_integrity(records: DataFrame, refs: DataFrame) -> DataFrame:
    """Integrity counts of the benchmark report; here a duplicate also needs the same kind and name."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    r = records.groupBy("path", "line", "col", "kind", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(empty("path", "lang", "kind", "name", "source") | (F.coalesce("line", F.lit(0)) == 0)).alias("bad"))
    f = refs.groupBy("from_path", "from_line", "from_col", "to_name", "ref_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(empty("from_path", "to_name", "ref_kind", "confidence", "reason", "evidence", "source") | (F.coalesce("from_line", F.lit(0)) == 0)).alias("bad"))
    a = r.agg(zero(F.sum("n")).alias("records"), zero(F.sum(F.col("n") - 1)).alias("duplicate_records"), zero(F.sum("bad")).alias("malformed_records"))
    b = f.agg(zero(F.sum("n")).alias("refs"), zero(F.sum(F.col("n") - 1)).alias("duplicate_refs"), zero(F.sum("bad")).alias("malformed_refs"))
    return a.select("*", *[b.select(c).scalar().alias(c) for c in b.columns])
