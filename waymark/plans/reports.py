"""Reports as text, Markdown, JSON and JSON lines.

Summaries are bounded (one row per language, level, window or dimension, samples of at most SAMPLE ids) and are
rendered on the driver; details are one row per finding and are written by the executors.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import gate as Q
from waymark.operators import quality as G
from waymark.operators import usage as U
from waymark.plans import ops, support
from waymark.sources.files import file_system


def pairs(rows: DataFrame, name: str, n: str) -> str:
    """name=n of a few rows in order of name."""
    got = rows.select(F.col(name).alias("k"), F.col(n).alias("v")).orderBy("k").collect()
    return ", ".join(f"{r['k']}={r['v']}" for r in got) or "none"


def usage_report(events: DataFrame, now: int) -> str:
    """Windows, hit and miss bars, workflow audit and recent misses of a usage log."""
    e = U.distinct_events(events)
    windows = U.window_stats(e, F.lit(now))
    order = {label: k for k, (_, label) in enumerate(U.WINDOWS)}
    table = sorted(windows.collect(), key=lambda r: order[r["label"]])  # four rows
    bars = sorted(U.hit_miss_graph(windows).collect(), key=lambda r: order[r["label"]])
    audit = U.workflow_audit(e).first()
    out = [f"{'Window':<10}{'Searches':<10}{'Hits':<6}{'Misses':<8}{'Hit ratio':<11}Avg results"]
    out += [f"{r['label']:<10}{r['total']:<10}{r['hits']:<6}{r['misses']:<8}{r['hit_ratio'] * 100:.1f}%".ljust(45) + f"{r['avg_results']:.1f}" for r in table]
    out += ["", "Hit/miss graph"] + [f"{r['label']:<5}H {r['hits_bar']} {r['hits']:<4}  M {r['misses_bar']} {r['misses']}" for r in bars]
    out += ["", "Agent workflow audit", f"Recorded events: {audit['total']}", f"Search commands: {audit['search']}", f"Context commands: {audit['refs'] + audit['pack'] + audit['impact']} (refs {audit['refs']}, pack {audit['pack']}, impact {audit['impact']})", f"Filtered or limited commands: {audit['filtered_or_limited']}", f"Misses: {audit['misses']}"]
    misses = [f"- {r['query']}" for r in U.recent_misses(e).collect()]  # ten rows
    return "\n".join([*out, "", "Recent misses", *(misses or ["None"]), ""])


def checks_report(title: str, checks: list[ops.Check]) -> str:
    """Doctor or scorecard: overall result and one line per check."""
    n = ops.tally(checks)
    overall = "issues found" if n["fail"] else "ok with warnings" if n["warn"] else "ok"
    lines = [f"[{c.status}] {c.name}: {c.detail}" for c in checks]
    return "\n".join([title, f"overall: {overall}", f"summary: pass {n['pass']} / warn {n['warn']} / fail {n['fail']}", "", *lines, ""])


def benchmark_report(repo: str, b: dict, integrity: dict[str, int] | None = None) -> str:
    lines = [f"Repo: {repo}", f"- queries: {b['queries']}", f"- hits: {b['hits']} misses: {b['misses']}", f"- hit rate: {b['hit_rate']}%"]
    lines += [f"- avg {k} latency: {ops.duration_text(b[f'avg_{k}_seconds'])}" for k in ("search", "refs", "pack", "impact")]
    lines += [f"- avg results: {b['avg_results']:.1f}", f"- max results: {b['max_results']}", f"- avg pack files: {b['avg_pack_files']:.1f}", f"- avg impact files: {b['avg_impact_files']:.1f}"]
    bad = {k: v for k, v in (integrity or {}).items() if v and k.startswith(("duplicate", "malformed"))}
    return "\n".join([*lines, "- integrity: " + (", ".join(f"{k}={v}" for k, v in sorted(bad.items())) or "ok"), ""])


def gate_report(g: Q.Gate) -> str:
    rows = {r["item"]: r for r in g.summary().collect()}  # ten rows
    lines = [f"Repo: {g.repo}", "- languages checked: " + (", ".join(sorted(r["language"] for r in g.languages.collect())) or "none")]
    verbs = {"expected symbols": "missing", "expected patterns": "failing", "expected absent symbols": "found", "thresholds": "failing"}
    lines += [f"- {k}: {rows[k]['checked']} checked, {rows[k]['failing']} {v}" for k, v in verbs.items()]
    lines.append("- integrity: " + " ".join(f"{k}={rows[k]['failing']}" for k in Q.COUNTERS))
    lines.append(f"- unsupported extensions: {pairs(g.extensions, 'extension', 'n')}")
    lines.append("- comparator: not run" if g.comparator is None else "- comparator symbols: record-only={1} comparator-only={0}".format(*(df.count() for df in g.comparator)))
    for title, df, col in (("Missing expected symbols", g.missing, "text"), ("Failing expected patterns", g.failing, "name_regex"), ("Found expected-absent symbols", g.found_absent, "text"), ("Threshold failures", g.thresholds, "message")):
        some = Q.sample(df, col)
        lines += ["", f"{title}:", *[f"- {x}" for x in some]] if some else []
    return "\n".join([*lines, ""])


def plan_report(cycle: str, plan: DataFrame) -> str:
    chosen = plan.filter("selected").orderBy("id").collect()  # at most ten gaps
    n = plan.agg(F.count_if(~F.col("selected")).alias("n")).first()["n"]
    head = [f"# {cycle}", "", "- model: check -> plan -> act", "- one-cycle limit: true", f"- max gaps: {G.MAX_GAPS_PER_CYCLE}", f"- selected gaps: {len(chosen)}", f"- deferred gaps: {n}", "", "## Selected Batch", ""]
    body = [line for r in chosen for line in (f"- id: {r['id']}", *[f"  {c}: {r[c] if r[c] is not None else 'n/a'}" for c in G.GAP])] or ["- none"]
    targets = sorted(r["target"] for r in Q.change_targets(plan).collect())  # at most two and a path per gap
    later = Q.sample(plan.filter("NOT selected"), "id")
    return "\n".join([*head, *body, "", "## Expected Change Set", "", *([f"- {x}" for x in targets] or ["- none"]), "", f"## Deferred Gap IDs (first {Q.SAMPLE})", "", *([f"- {x}" for x in later] or ["- none"]), ""])


def final_report(cycle: str, conditions: DataFrame, checks: list[tuple[str, str]] = ()) -> str:
    why = ", ".join(sorted(r["condition"] for r in conditions.collect())) or "none"  # at most six rows
    ran = [f"- command: `{c}` status: {s}" for c, s in sorted(checks)] or ["- none recorded"]
    return "\n".join([f"# {cycle} Final Report", "", "- model: check -> plan -> act -> stop", "- one-cycle limit: true", "- automatic next cycle allowed: no", f"- stop conditions: {why}", "", "## Verification", "", *ran, ""])


def triage_report(repo: str, items: DataFrame) -> str:
    n = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "open").alias("open")).first()
    states = [f"- {s}" for s in G.TRIAGE_ACTIONS]
    groups = items.groupBy("source", "language", "kind", "path").agg(F.count(F.lit(1)).alias("n")).orderBy("source", "language", "kind", "path").limit(Q.SAMPLE).collect()
    lines = [f"- {r['source']}: language={r['language']} kind={r['kind']} path={r['path']} count={r['n']}" for r in groups] or ["- none"]
    return "\n".join(["# Comparator Triage", "", f"- repo: {repo}", f"- items: {n['n']}", f"- open: {n['open']}", "", "## States", "", *states, "", f"## Groups (first {Q.SAMPLE})", "", *lines, ""])


def export_summary(g: Q.Gate, records: DataFrame, refs: DataFrame, gaps: DataFrame, plan: DataFrame) -> dict:
    """The bounded part of a quality export."""
    counts = {r["item"]: {"checked": r["checked"], "failing": r["failing"]} for r in g.summary().collect()}
    by = lambda df, k, n: {r["k"]: r["v"] for r in df.select(F.col(k).alias("k"), F.col(n).alias("v")).orderBy("k").collect()}
    summary: dict[str, dict] = {"status": {}, "severity": {}, "evidence_source": {}}
    for r in G.gap_summary(gaps).orderBy("by", "value").collect():
        summary[r["by"]][r["value"]] = r["n"]
    return {
        "generated_at": "deterministic",
        "repo": g.repo,
        "languages_checked": sorted(r["language"] for r in g.languages.collect()),
        "records_by_language": by(G.record_metrics(records), "language", "records"),
        "refs_by_language": by(G.refs_by_language(refs, records), "language", "refs"),
        "findings": counts,
        "missing_sample": Q.sample(g.missing, "text"),
        "unsupported_extensions": by(g.extensions, "extension", "n"),
        "comparator": None if g.comparator is None else dict(zip(("comparator_only", "record_only"), (df.count() for df in g.comparator), strict=True)),
        "gaps": summary | {"open_sample": Q.sample(gaps.filter("status = 'open'"), "id")},
        "plan": {"selected": Q.sample(plan.filter("selected"), "id"), "deferred_sample": Q.sample(plan.filter("NOT selected"), "id")},
        "language_support": [{"name": n, "level": level, "extensions": e.split()} for n, _, e, level, _ in support.MATRIX],
    }


def export_markdown(s: dict) -> str:
    flat = lambda d: ", ".join(f"{k}={v}" for k, v in d.items()) or "none"
    lines = ["# Quality Report", "", f"- generated_at: {s['generated_at']}", f"- repo: {s['repo']}", f"- languages: {', '.join(s['languages_checked']) or 'none'}", f"- records: {flat(s['records_by_language'])}", f"- refs: {flat(s['refs_by_language'])}", "", "## Findings", ""]
    lines += [f"- {k}: {v['failing']}" + ("" if v["checked"] is None else f" of {v['checked']}") for k, v in s["findings"].items()]
    lines += ["", "## Comparator Symbols", "", f"- {flat(s['comparator']) if s['comparator'] else 'not run'}", "", "## Unsupported Extensions", "", f"- {flat(s['unsupported_extensions'])}", "", "## Gap Summary", ""]
    lines += [f"- {k}: {flat(v)}" for k, v in s["gaps"].items() if isinstance(v, dict)] + [f"- open sample: {', '.join(s['gaps']['open_sample']) or 'none'}"]
    lines += ["", "## Cycle Plan", "", f"- selected: {', '.join(s['plan']['selected']) or 'none'}", "", "## Language Support Matrix", "", "| Language | Level | Extensions |", "| --- | --- | --- |"]
    return "\n".join([*lines, *[f"| {x['name']} | {x['level']} | {', '.join(x['extensions'])} |" for x in s["language_support"]], ""])


def write_text(folder: str, name: str, text: str) -> None:
    own, base = file_system(folder)
    own.create_dir(base, recursive=True)
    with own.open_output_stream(f"{base}/{name}") as f:
        f.write(text.encode())


def write_export(folder: str, summary: dict, details: DataFrame) -> None:
    """QUALITY_REPORT.md and .json, and a folder of JSON lines with every detail row, in order."""
    write_text(folder, "QUALITY_REPORT.md", export_markdown(summary))
    write_text(folder, "QUALITY_REPORT.json", json.dumps(summary, indent=2))
    order = ["repo", "detail_kind", "path", "line", "name", "detail"]
    details.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(f"{folder}/QUALITY_REPORT_DETAILS")
