"""Operations over the tables: support levels, benchmark report, doctor checks, scorecard, text rendering, command line."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.privacy import redact
from waymark.operators import context as C
from waymark.operators import search as S
from waymark.plans import support

WARM_PASS_MS, WARM_WARN_MS = 150, 500


def percentage(value: int, total: int) -> int:
    return 0 if not total else value * 100 // total


def average(total: int, count: int) -> float:
    return total / count if count else 0.0


def byte_text(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KiB" if n < 1024 * 1024 else f"{n / 1024 / 1024:.1f} MiB"


def duration_text(seconds: float) -> str:
    return f"{seconds * 1000:.1f} ms" if seconds < 1 else f"{seconds:.2f} s"


def benchmark(t: C.Tables, queries: list[str]) -> dict:
    """Hit rate, results, distinct files of pack and impact, and mean latencies over a list of queries."""
    found, files, seconds = [], {"pack": [], "impact": []}, dict.fromkeys(("search", "refs", "pack", "impact"), 0.0)

    def timed(name: str, run):  # noqa: ANN001, ANN202
        began = time.time()
        got = run()
        seconds[name] += time.time() - began
        return got

    for q in queries:
        found.append(timed("search", lambda: S.search(t.records, q).count()))  # noqa: B023
        timed("refs", lambda: C.refs_of(t, q).count())  # noqa: B023
        for name, make in (("pack", C.pack), ("impact", C.impact)):
            files[name].append(timed(name, lambda: make(t, q).select(F.count_distinct("path")).first()[0]))  # noqa: B023
    hits = sum(n > 0 for n in found)
    out = {"queries": len(queries), "hits": hits, "misses": len(queries) - hits, "hit_rate": percentage(hits, len(queries)), "avg_results": average(sum(found), len(found)), "max_results": max(found, default=0)}
    return out | {f"avg_{k}_files": average(sum(v), len(v)) for k, v in files.items()} | {f"avg_{k}_seconds": average(s, len(queries)) for k, s in seconds.items()} | {"seconds": sum(seconds.values())}


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    detail: str


def ignores_store(rules: str) -> bool:
    """Whether the text of an ignore file lists the store's folder."""
    return any(line.strip() in (".dev_index", ".dev_index/", "/.dev_index/") for line in rules.splitlines())


def forbidden_lines(texts: DataFrame, word: str = "ctags", allowed: str = r"^(?:src/quality/|tests/quality|docs/QUALITY)") -> DataFrame:
    """(path, line, text, reason): lines that name a forbidden tool outside the paths where that is allowed."""
    named = texts.filter(F.col("text").isNotNull() & F.lower("text").contains(word) & ~F.replace("path", F.lit("\\"), F.lit("/")).rlike(allowed))
    each = named.select("path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("k", "text")).filter(F.lower("text").contains(word))
    p = F.col("path")
    reason = F.when(p.startswith("src/"), "reference outside isolated quality modules").when(p.startswith("scripts/") | p.isin("install.sh", "uninstall.sh", "docs/INSTALLERS.md"), "reference in install/release/package surface").when(p.startswith("tests/"), "reference in non-quality test").otherwise("reference outside structural allowlist")
    return each.select("path", (F.col("k") + 1).alias("line"), "text", F.concat(F.lit(f"{word} "), reason).alias("reason"))


def forbidden_artifacts(paths: DataFrame, word: str = "ctags") -> DataFrame:
    """Package entries that are the forbidden tool itself."""
    name = F.lower(F.substring_index("path", "/", -1))
    return paths.filter((name == word) | (name == f"{word}.exe") | name.startswith(f"{word}-")).select("path", F.lit(f"release/package artifact must not include {word}").alias("reason"))


def doctor(tables: dict[str, DataFrame] | None, fresh: bool, schema_ok: bool, forbidden_source: str = "ctags", ignore_text: str | None = None, quality_reports: bool = False) -> list[Check]:
    """Health of a snapshot: present, current schema, fresh, filled, no forbidden source, no index paths; parser
    support, ignore rule of the store, quality reports. Checks of instruction files, licences and installed
    binaries are no data processing and left out."""
    spark = SparkSession.getActiveSession()
    n = {r["level"]: r["n"] for r in support.counts(spark).collect()}  # four rows
    around = [
        Check("parser support", "pass", f"{sum(n.values())} entries ({', '.join(f'{n[k]} {k}' for k in support.LEVELS)})"),
        Check("ignore", "pass" if ignores_store(ignore_text or "") else "warn", ".dev_index/ is ignored locally" if ignores_store(ignore_text or "") else ".dev_index/ is in no ignore file"),
        Check("quality", "pass", "quality reports exist" if quality_reports else "optional quality reports are not present"),
    ]
    if tables is None:
        return [Check("snapshot", "fail", "no snapshot of the current schema"), *around]
    n = {k: v.limit(1).count() for k, v in tables.items()}
    r = tables["records"].agg(F.count_if(F.col("source") == forbidden_source).alias("f"), F.count_if(F.col("path").contains(".dev_index")).alias("i")).first()
    q = tables["refs"].agg(F.count_if(F.col("source") == forbidden_source).alias("f")).first()
    return [
        Check("snapshot", "pass", "present"),
        Check("schema", "pass" if schema_ok else "fail", "schema version"),
        Check("freshness", "pass" if fresh else "fail", "index is fresh" if fresh else "index is stale; files changed since the last build"),
        *[Check(f"{k} filled", "pass" if n[k] or k == "semantic_facts" else "warn", "has rows" if n[k] else "empty") for k in tables],
        Check("forbidden sources", "pass" if r["f"] + q["f"] == 0 else "fail", f"{r['f'] + q['f']} rows"),
        Check("index paths", "pass" if r["i"] == 0 else "fail", f"{r['i']} rows"),
        *around,
    ]


def latency_status(ms: float) -> str:
    return "pass" if ms <= WARM_PASS_MS else "warn" if ms <= WARM_WARN_MS else "fail"


def scorecard(t: C.Tables, query: str, checks: list[Check], recovered: str | None = None) -> list[Check]:
    """Dimensions of a working index: recovery, search, latency, refs, pack, impact, doctor, support claims.

    ``recovered`` is what a rebuild before the run did: None if the index was fresh, ok, or failed. One row in
    a context result means only the definition was found. Instruction files are no data processing and left out.
    """
    query = query.strip() or "build_index"
    S.search(t.records, query).count()
    began = time.time()
    found = S.search(t.records, query).limit(1).collect()
    ms = (time.time() - began) * 1000
    sizes = {name: make(t, query).count() for name, make in (("refs", C.refs_of), ("pack", C.pack), ("impact", C.impact))}
    grade = lambda n: "pass" if n > 1 else "warn" if n else "fail"
    worst = "fail" if any(c.status == "fail" for c in checks) else "warn" if any(c.status == "warn" for c in checks) else "pass"
    levels = {r["level"]: r["n"] for r in support.counts(t.records.sparkSession).collect()}  # four rows
    return [
        Check("recovery", {None: "warn", "ok": "pass"}.get(recovered, "fail"), {None: "index was already fresh", "ok": "one build made the index fresh"}.get(recovered, "index is still stale after one build")),
        Check("search", "pass" if found else "fail", f"{found[0]['path']}:{found[0]['line']} {found[0]['kind']} {found[0]['name']}" if found else "no file:line results"),
        Check("latency", latency_status(ms), f"{ms:.0f} ms"),
        *[Check(name, grade(n), f"{n} rows") for name, n in sizes.items()],
        Check("doctor", worst, f"{len(checks)} checks"),
        Check("support claims", "pass" if all(levels.get(k) for k in support.LEVELS) else "fail", ", ".join(f"{levels.get(k, 0)} {k}" for k in support.LEVELS)),
    ]


def tally(checks: list[Check]) -> dict[str, int]:
    return {s: sum(c.status == s for c in checks) for s in ("pass", "warn", "fail")}


def miss_report(query: str, o: S.Options = S.Options()) -> str:
    """What a search without results looked at and what to try."""
    looked = (["- filenames/paths"] if o.kind is None and o.source is None else []) + ["- indexed symbols/content"]
    return "\n".join([f"No matches for: {query}", "", "Checked:", *looked, "", "Try:", "- build the index again", "- a file name or symbol", "- the term with a path filter", "- refs with a symbol", ""])


def search_lines(found: DataFrame) -> DataFrame:
    """One redacted output line per result, in no order."""
    return found.select(F.concat(redact(F.col("path")), F.lit(":"), F.col("line").cast("string"), F.lit(" "), redact(F.col("kind")), F.lit(" "), redact(F.col("name"))).alias("line"))


def context_lines(rows: DataFrame) -> DataFrame:
    """Redacted output lines of pack or impact rows with their group."""
    head = F.concat(F.lit("- "), redact(F.col("path")), F.lit(":"), F.col("line").cast("string"), F.lit(" "), redact(F.col("kind")), F.lit(" "), redact(F.col("target")))
    return rows.select("grp", F.concat_ws("\n", head, F.concat(F.lit("  reason: "), redact(F.col("reason"))), F.concat(F.lit("  confidence: "), F.col("confidence"))).alias("line"))


COMMANDS = ("refs", "pack", "impact")


def parse_command(args: list[str]) -> tuple[str, str]:
    """(command, query): refs, pack or impact with a term; bare doctor or bench; anything else searches."""
    if len(args) > 1 and args[0] in COMMANDS:
        return args[0], " ".join(args[1:])
    if len(args) == 1 and args[0] in ("doctor", "bench"):
        return args[0], ""
    return "search", " ".join(args)


def run_command(t: C.Tables, files: DataFrame, args: list[str], o: S.Options = S.Options()) -> DataFrame:
    command, query = parse_command(args)
    make = {"refs": C.refs_of, "pack": C.pack, "impact": C.impact}.get(command)
    return make(t, query, o) if make else S.search_merged(t.records, files, query, o)
