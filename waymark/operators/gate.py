"""The quality gate as a whole: findings with nearby candidates, counters, pass or fail, and the end of a cycle.

Findings are few (one per expectation of a manifest), candidates are the first three records near each. They come
from at most three rows per wanted path, language and kind: a row number up to three is limited where rows are
read, so no key gathers its rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.privacy import redact
from waymark.operators import quality as G

NEAR = 3
SAMPLE = 20
COUNTERS = ("duplicate-records", "duplicate-refs", "malformed-records", "malformed-refs", "dev-index-paths", "ctags-sources")
"""Candidates of a finding, findings of a summary, and the integrity counters of a gate (fixed values)."""
CHANGES = {
    "parser-query": ("parser: Tree-sitter query spec for the affected language", "tests: parser conformance fixture for the missed syntax"),
    "fixture": ("tests: parser or quality conformance fixture",),
    "manifest-expected-symbol": ("manifest: test_repos/MANIFEST.toml expected symbol",),
    "comparator-triage": ("quality: .dev_index/quality/COMPARATOR_TRIAGE.md",),
    "integrity-fix": ("tests: index integrity regression coverage",),
    "performance-triage": ("tests: benchmark or performance regression gate",),
    "documentation": ("docs: parser support or quality-loop documentation",),
}
"""What a suggested fix changes (fixed values)."""
LOCATION = ("path", "line", "col", "kind", "name", "source", "lang")


class GateFailure(AssertionError):
    """A gate or a strict triage that does not pass; the text is the report."""


def first_records(df: DataFrame, by: list[str], n: int = NEAR) -> DataFrame:
    """The first n records of each key in canonical order."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c) for c in LOCATION])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def shown(c: Column) -> Column:
    """Structs of locations as text, at most three in order."""
    one = lambda r: F.format_string("%s:%d:%d %s %s (%s)", r["path"], r["line"], r["col"], r["kind"], r["name"], r["lang"])
    return F.coalesce(F.nullif(F.concat_ws("; ", F.transform(F.slice(F.array_sort(F.array_distinct(c)), 1, NEAR), one)), F.lit("")), F.lit("none"))


def said(c: str) -> Column:
    """An optional value of an expectation as reports print it."""
    return F.when(F.col(c).isNull(), "None").otherwise(F.concat(F.lit('Some("'), F.col(c), F.lit('")')))


def described(repo: str) -> Column:
    return F.concat(F.lit(f"repo={repo} language="), said("language"), F.lit(" path="), said("path"), F.lit(" kind="), said("kind"), F.lit(" name="), F.col("name"))


def near(expected: DataFrame, records: DataFrame) -> DataFrame:
    """``expected`` with ``nearby``: the first records that share its path, language or kind; else the first of all."""
    e = expected.select("language", "path", "kind", "name").distinct()
    own = records.select(*LOCATION, G.quality_path(F.col("path")).alias("p"), G.language(F.col("lang")).alias("l"))
    parts = []
    for key, wanted in (("p", G.quality_path(F.col("path"))), ("l", G.language(F.col("language"))), ("kind", F.col("kind"))):
        source = {"p": "path", "l": "language", "kind": "kind"}[key]
        want = e.filter(F.col(source).isNotNull()).select("language", "path", "kind", "name", wanted.alias("_k"))
        few = first_records(own.withColumn("_k", F.col(key)).join(want.select("_k").distinct(), "_k", "left_semi"), ["_k"]).select("_k", F.struct(*LOCATION).alias("r"))
        parts.append(want.join(few, "_k").select("language", "path", "kind", "name", "r"))
    hits = reduce(DataFrame.unionByName, parts)
    # at most nine candidates of a finding
    each = hits.groupBy("language", "path", "kind", "name").agg(F.collect_list("r").alias("rs"))
    any_ = own.select(F.struct(*LOCATION).alias("r")).orderBy("r").limit(NEAR).agg(F.collect_list("r").alias("any"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("language", "path", "kind", "name")]
    return e.alias("e").join(each.alias("h"), reduce(Column.__and__, same), "left").select("e.*", F.coalesce("rs", any_.scalar()).alias("rs")).select("language", "path", "kind", "name", shown(F.col("rs")).alias("nearby"))


def pattern_near(patterns: list[dict], records: DataFrame) -> DataFrame:
    """(name_regex, nearby): the first records that fit a pattern in all but the name; one top three per pattern."""
    out = None
    for p in patterns:
        on = F.lit(True)
        if p.get("language"):
            on &= G.language(F.col("lang")) == p["language"].strip().lower()
        if p.get("kind"):
            on &= F.col("kind") == p["kind"]
        if p.get("path_glob"):
            on &= F.col("path").rlike(G.glob_pattern(p["path_glob"]))
        top = records.filter(on).select(F.struct(*LOCATION).alias("r")).orderBy("r").limit(NEAR).agg(F.collect_list("r").alias("rs"))
        one = top.select(F.lit(p["name_regex"]).alias("name_regex"), shown(F.col("rs")).alias("nearby"))
        out = one if out is None else out.unionByName(one)
    return out


def languages_checked(records: DataFrame, refs_by_language: DataFrame, *expectations: DataFrame) -> DataFrame:
    """The languages of records, references and all expectations, each once."""
    parts = [records.select(G.language(F.col("lang")).alias("language")).distinct(), refs_by_language.select("language")]
    parts += [e.filter(F.col("language").isNotNull()).select("language") for e in expectations]
    return reduce(DataFrame.unionByName, parts).distinct()


def counters(records: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, n) of the six integrity counters, in COUNTERS order."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    a = G.record_metrics(records).agg(*[zero(F.sum(c)).alias(c) for c in ("duplicate_locations", "malformed", "index_dir_paths", "comparator_sources")])
    b = G.ref_metrics(refs, records)
    pick = lambda df, c: df.select(c).scalar()
    values = (F.col("duplicate_locations"), pick(b, "duplicate_refs"), F.col("malformed"), pick(b, "malformed_refs"), F.col("index_dir_paths") + pick(b, "index_dir_paths"), F.col("comparator_sources"))
    return a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("n")) for n, v in zip(COUNTERS, values, strict=True)])).alias("x")).select("x.*")


@dataclass
class Gate:
    """The findings of a gate, each a table; ``comparator`` holds both one-sided tables if a comparator ran."""

    repo: str
    languages: DataFrame
    missing: DataFrame
    failing: DataFrame
    found_absent: DataFrame
    thresholds: DataFrame
    integrity: DataFrame
    extensions: DataFrame
    checked: dict[str, int] = field(default_factory=dict)
    comparator: tuple[DataFrame, DataFrame] | None = None

    def summary(self) -> DataFrame:
        """(item, checked, failing) of every part that decides; checked is null for counters."""
        parts = [("expected symbols", self.missing), ("expected patterns", self.failing), ("expected absent symbols", self.found_absent), ("thresholds", self.thresholds)]
        rows = [df.agg(F.lit(name).alias("item"), F.lit(self.checked[name]).cast("bigint").alias("checked"), F.count(F.lit(1)).alias("failing")) for name, df in parts]
        rows.append(self.integrity.select(F.col("name").alias("item"), F.lit(None).cast("bigint").alias("checked"), F.col("n").alias("failing")))
        return reduce(DataFrame.unionByName, rows)

    def passes(self) -> bool:
        return self.summary().filter("failing > 0").isEmpty()

    def check(self) -> None:
        """Raise GateFailure unless every part passes."""
        bad = self.summary().filter("failing > 0").orderBy("item").collect()  # at most ten rows
        if bad:
            raise GateFailure(f"quality drift gate failed for {self.repo}: " + ", ".join(f"{r['item']}={r['failing']}" for r in bad))


def evaluate(repo: str, records: DataFrame, refs: DataFrame, expected: DataFrame, absent: DataFrame, patterns: list[dict], thresholds: DataFrame, comparator: DataFrame | None = None) -> Gate:
    """All findings of a repository against its expectations."""
    metrics = G.record_metrics(records)
    hits = G.expected_matches(expected, records)
    gone = near(hits.filter("matches = 0"), records).select("language", "path", "kind", "name", F.concat(F.lit("missing expected symbol "), described(repo), F.lit(" nearby="), F.col("nearby")).alias("text"))
    there = G.expected_matches(absent, records).filter("matches > 0")
    held = matching(there, records).select("language", "path", "kind", "name", F.concat(F.lit("found expected-absent symbol "), described(repo), F.lit(" matches="), F.col("nearby")).alias("text"))
    counted = G.pattern_counts(patterns, records) if patterns else None
    failing = counted.filter("actual < min_count").join(pattern_near(patterns, records), "name_regex") if counted is not None else expected.limit(0).select(F.lit("").alias("name_regex"), F.lit(0).alias("min_count"), F.lit(0).cast("bigint").alias("actual"), F.lit("").alias("nearby"))
    plain = lambda cols: records.sparkSession.createDataFrame([(p["language"],) for p in patterns if p.get("language")], cols)
    languages = languages_checked(records, G.refs_by_language(refs, records), expected, absent, thresholds, plain("language string"))
    sides = None
    if comparator is not None:
        r, c = G.comparator_match(records, comparator)
        one = lambda df: df.filter(F.col("ok") & ~F.col("matched")).select("path", "line", "kind", "name", "language")
        sides = (one(c), one(r))
    checked = {"expected symbols": expected.count(), "expected patterns": len(patterns), "expected absent symbols": absent.count(), "thresholds": thresholds.count()}
    return Gate(repo, languages, gone, failing, held, G.threshold_failures(thresholds, metrics), counters(records, refs), G.unsupported_extensions(records), checked, sides)


def matching(expected: DataFrame, records: DataFrame) -> DataFrame:
    """``expected`` with the first records that match it exactly."""
    e = expected.select(*[F.col(c).alias(f"e_{c}") for c in ("language", "path", "kind", "name")])
    r = records.join(e.select(F.col("e_name").alias("name")).distinct(), "name", "left_semi")
    on = (F.col("name") == F.col("e_name")) & (F.col("e_language").isNull() | (G.language(F.col("lang")) == G.language(F.col("e_language")))) & (F.col("e_path").isNull() | (G.quality_path(F.col("path")) == G.quality_path(F.col("e_path")))) & (F.col("e_kind").isNull() | (F.col("kind") == F.col("e_kind")))
    few = first_records(e.join(r, on), [f"e_{c}" for c in ("language", "path", "kind", "name")])
    each = few.groupBy("e_language", "e_path", "e_kind", "e_name").agg(F.collect_list(F.struct(*LOCATION)).alias("rs"))  # at most three each
    return each.select(*[F.col(f"e_{c}").alias(c) for c in ("language", "path", "kind", "name")], shown(F.col("rs")).alias("nearby"))


# cycles
def change_targets(plan: DataFrame) -> DataFrame:
    """(target): what the selected gaps of a plan change, each once."""
    chosen = plan.filter("selected")
    fixes = F.create_map(*[x for k, v in CHANGES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    every = F.concat(F.coalesce(fixes[F.col("suggested_fix")], F.array().cast("array<string>")), F.array_compact(F.array(F.concat(F.lit("source: "), F.col("path")))))
    return chosen.select(F.explode(every).alias("target")).distinct()


def finalize(plan: DataFrame, current: DataFrame, failed_checks: int = 0) -> DataFrame:
    """(condition): why a cycle stops, from its plan and the current gaps (GAP columns, id and status).

    Everything is counted in one pass over the gaps; a cycle always stops after one run.
    """
    chosen = plan.filter("selected").select("id", F.lit(True).alias("chosen"))
    g = current.join(chosen, "id", "left")
    mine, rest = F.coalesce("chosen", F.lit(False)), F.col("status") != "fixed"
    left = rest & ~mine
    triage = (F.col("suggested_fix") == "comparator-triage") | F.col("evidence_source").isin("comparator-only", "record-only")
    later = (F.col("status") == "open") & ((F.col("evidence_source") == "unsupported-extension") | (F.col("suggested_fix") == "documentation") | F.col("detail").rlike("architecture|language expansion|unsupported syntax"))
    n = g.agg(
        F.count_if(mine & (F.col("status") == "fixed")).alias("fixed"), F.count_if(left).alias("left"), F.count_if(left & (F.col("status") == "unsupported")).alias("unsupported"),
        F.count_if(left & ((F.col("status") == "false-positive") | triage)).alias("noise"), F.count_if(left & later).alias("later"),
    ).withColumn("wanted", chosen.agg(F.count(F.lit(1)).alias("n")).scalar())
    some = F.col("left") > 0
    conditions = F.array_compact(
        F.array(
            F.when(F.col("wanted") == 0, "no_selected_gaps"),
            F.when((F.col("wanted") > 0) & (F.col("fixed") == F.col("wanted")), "selected_gaps_fixed"),
            F.when(some & (F.col("unsupported") == F.col("left")), "remaining_gaps_unsupported"),
            F.when(some & (F.col("noise") == F.col("left")), "remaining_gaps_comparator_false_positive"),
            F.when(some & (F.col("later") == F.col("left")), "remaining_gaps_require_architecture_or_language_expansion"),
            F.when(((F.col("wanted") > 0) & (F.col("fixed") < F.col("wanted"))) | F.lit(failed_checks > 0), "verification_failed_needs_human_review"),
        )
    )
    return n.select(F.explode(conditions).alias("condition"))


# triage
def triage_state(c: Column) -> Column:
    """A state's name, or an error for an unknown one."""
    return F.when(c.isin(*G.TRIAGE_ACTIONS), c).otherwise(F.raise_error(F.concat(F.lit("unknown triage state `"), c, F.lit("`"))).cast("string"))


def promoted(items: DataFrame) -> DataFrame:
    """Triage items with the action that their state asks for."""
    return items.withColumn("promotion", F.create_map(*[F.lit(x) for kv in G.TRIAGE_ACTIONS.items() for x in kv])[F.col("state")])


def check_triage(repo: str, items: DataFrame) -> None:
    """Raise GateFailure if an item is still open."""
    n = items.filter("state = 'open'").count()
    if n:
        raise GateFailure(f"strict comparator triage failed for {repo}: {n} open item(s)")


# exports
def details(repo: str, gate: Gate, gaps: DataFrame) -> DataFrame:
    """One redacted row per finding: (repo, detail_kind, path, line, language, symbol_kind, name, detail)."""
    none, text = F.lit(None), lambda c: redact(c)
    row = lambda df, kind, path=none, line=none, language=none, symbol=none, name=none, detail=none: df.select(
        text(F.lit(repo)).alias("repo"), F.lit(kind).alias("detail_kind"), text(path.cast("string")).alias("path"), line.cast("int").alias("line"), text(language.cast("string")).alias("language"), text(symbol.cast("string")).alias("symbol_kind"), text(name.cast("string")).alias("name"), text(detail.cast("string")).alias("detail")
    )
    c = F.col
    parts = [row(gate.missing, "expected_symbol_missing", name=c("text")), row(gate.failing, "expected_pattern_failing", detail=F.concat(F.lit(f"repo={repo} name_regex="), "name_regex", F.lit(" min_count="), c("min_count").cast("string"), F.lit(" actual="), c("actual").cast("string"), F.lit(" nearby="), "nearby")), row(gate.found_absent, "expected_absent_symbol_found", name=c("text"))]
    for kind, df in zip(("comparator_only", "record_only"), gate.comparator or (), strict=False):
        parts.append(row(df, kind, c("path"), c("line"), c("language"), c("kind"), c("name")))
    parts.append(row(gaps, "gap", c("path"), none, c("language"), c("kind"), c("symbol"), F.concat("id", F.lit(" status="), "status", F.lit(" severity="), "severity")))
    return reduce(DataFrame.unionByName, parts)


def sample(df: DataFrame, column: str, n: int = SAMPLE) -> list[str]:
    """The first redacted values in order."""
    return [r["v"] for r in df.select(redact(F.col(column)).alias("v")).orderBy("v").limit(n).collect()]
