"""One-hop context of a search: references, bounded read sets (pack) and impact groups.

The primaries are at most three rows. They are fetched once and become literals, so the edge tables are read
with pushed-down IN filters and nothing is shuffled but the few rows near the primaries. All producers give
plain candidates; those of a path that cannot differ in group and priority are reduced to their first where they
are read, and only then the path's role is found, once for all producers. Groups are taken in a fixed order with a
shared budget: each group keeps the best row of each path not yet used, up to its own and the remaining limit.
Edge rows tie on their output key when they differ in confidence or reason only; those columns end the key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from waymark.functions import paths, ranks
from waymark.functions.text import ascii_lower
from waymark.operators import search as S

PRIMARY_LIMIT = 3
REFS_LIMIT, PACK_LIMIT, IMPACT_LIMIT = 20, 10, 15
PACK_GROUPS = (("References", 3), ("Dependencies", 3), ("Dependents", 3), ("Tests", 3), ("Config", 2), ("Docs", 2), ("Unresolved", 2))
IMPACT_GROUPS = (("References", 5), ("Dependents", 5), ("Tests", 5), ("Docs", 3), ("Config", 5), ("Unknown", 5))
"""Result limits and group limits in output order (fixed values)."""

ROW = ("grp", "path", "line", "col", "kind", "target", "confidence", "reason", "priority")


@dataclass
class Tables:
    records: DataFrame
    refs: DataFrame
    dependencies: DataFrame
    file_references: DataFrame


@dataclass(frozen=True)
class Primary:
    """The best matches of a query: at most PRIMARY_LIMIT rows, held as values so that they filter scans."""

    query: str
    rows: tuple[Row, ...]

    def direct(self) -> Primary:
        """The definitions among them; all of them if none is."""
        own = tuple(r for r in self.rows if r["kind"] in ranks.DIRECT_KINDS)
        return Primary(self.query, own or self.rows)

    @property
    def names(self) -> list[str]:
        return sorted({self.query, *(r["name"] for r in self.rows)}) if self.rows else []

    @property
    def paths(self) -> list[str]:
        return sorted({r["path"] for r in self.rows})

    @property
    def needles(self) -> list[str]:
        """Names by which a test file can point at a primary."""
        words = {r["stem_word"] for r in self.rows} | {r["name_word"] for r in self.rows} | ({test_word(self.query)} if self.rows else set())
        return sorted(w for w in words if w)

    @property
    def roots(self) -> list[str]:
        return sorted({r["root"] for r in self.rows if r["role"] in ("source", "test") and r["root"]})


def test_word(s: str) -> str:
    return "".join(ch for ch in S.low(s) if ch.isascii() and ch.isalnum())


def primary(t: Tables, query: str, o: S.Options = S.Options()) -> Primary:
    """Run the search for the primaries; three rows come to the driver."""
    p = F.col("path")
    top = S.search(t.records, query, S.Options(o.kind, o.lang, o.path, o.source, PRIMARY_LIMIT))
    extra = {"role": paths.file_role(p), "root": paths.top_dir(p), "stem_word": paths.test_name(paths.stem(p)), "name_word": paths.test_name(F.col("name"))}
    return Primary(query, tuple(top.withColumns(extra).collect()))


def among(col: str, values: list[str]) -> Column:
    return F.coalesce(F.col(col).isin(*values), F.lit(False)) if values else F.lit(False)


def matching_refs(t: Tables, prim: Primary) -> DataFrame:
    """References to the query or a primary's name, without text hits on a primary's own line."""
    own = F.lit(False)
    for r in prim.rows:
        own = own | ((F.col("from_path") == r["path"]) & (F.col("from_line") == r["line"]) & (F.col("to_name") == r["name"]))
    return t.refs.filter(F.col("to_name").isin(*prim.names) if prim.names else F.lit(False)).filter(~((F.col("ref_kind") == "text_reference") & own))


def matching_file_refs(t: Tables, prim: Primary) -> DataFrame:
    """File references to a primary's path, or named by a query that looks like a path; none from a primary."""
    own = prim.direct().paths
    hit = among("target_path", own)
    if prim.rows and ("/" in prim.query or "." in prim.query):
        q = S.low(prim.query)
        hit = hit | F.coalesce(ascii_lower(F.col("target_path")).contains(q), F.lit(False)) | ascii_lower(F.col("source_path")).contains(q) | ascii_lower(F.col("raw_target")).contains(q)
    return t.file_references.filter(hit & ~among("source_path", own))


def refs_of(t: Tables, query: str, o: S.Options = S.Options()) -> DataFrame:
    """Best references of the query: symbol and file rows in output order."""
    prim = primary(t, query, o)
    r, f = matching_refs(t, prim), matching_file_refs(t, prim)
    p = F.col("path")
    sym = r.select(F.lit("symbol").alias("producer"), F.col("from_path").alias("path"), F.col("from_line").alias("line"), F.col("from_col").alias("col"), F.col("ref_kind").alias("kind"), F.col("to_name").alias("target"), "confidence", "reason", "evidence")
    sym = sym.withColumns({"evidence_priority": ranks.ref_evidence_priority(F.col("kind"), F.col("confidence")), "rank": ranks.ref_rank(p, F.col("kind"))})
    told = F.when(F.col("target_path").isNotNull(), F.concat("reference_kind", F.lit(" resolves to "), "target_path")).otherwise(F.concat(F.lit("unresolved "), "reference_kind", F.lit(": "), F.coalesce("unresolved_reason", F.lit("unknown"))))
    fil = f.select(F.lit("file").alias("producer"), F.col("source_path").alias("path"), F.col("source_line").alias("line"), F.col("source_col").alias("col"), F.col("reference_kind").alias("kind"), F.col("raw_target").alias("target"), "confidence", told.alias("reason"), "evidence", ranks.file_ref_evidence_priority(F.col("reference_kind"), F.col("target_path")).alias("evidence_priority"), ranks.file_ref_rank(F.col("source_path"), F.col("reference_kind")).alias("rank"))
    rows = sym.unionByName(fil)
    key = [ranks.confidence_rank(F.col("confidence")), "evidence_priority", "rank", paths.context_penalty(p), "path", "line", "col", "kind", "target", F.desc("producer"), "confidence", "reason", "evidence"]
    return rows.orderBy(*key).limit(o.taken(REFS_LIMIT))


CANDIDATE = ("producer", "path", "kind", "confidence", "line", "col", "tie", "target", "extra")


def _candidate(df: DataFrame, producer: str, path: str, kind: str, confidence: str, line: str, col: str, target: str, extra: str, tie: str = "''") -> DataFrame:
    return df.selectExpr(f"'{producer}' AS producer", f"{path} AS path", f"{kind} AS kind", f"{confidence} AS confidence", f"{line} AS line", f"{col} AS col", f"{tie} AS tie", f"{target} AS target", f"{extra} AS extra")


NONE = "CAST(NULL AS STRING)"


def _edges(df: DataFrame, own: list[str], name: str, src: str, line: str, col: str, kind: str, raw: str) -> list[DataFrame]:
    """Edges to the primaries, and unresolved edges of the primaries and of the files with edges to them."""
    to = df.filter(among("target_path", own))
    open_ = df.filter("target_path IS NULL AND unresolved_reason IS NOT NULL")
    hit = _candidate(to, name, src, kind, "confidence", line, col, "target_path", NONE)
    mine = _candidate(open_.filter(among(src, own)), f"{name}_own", src, kind, NONE, line, col, raw, "unresolved_reason")
    near = _candidate(open_.join(to.select(src).distinct(), src, "left_semi"), f"{name}_near", src, kind, NONE, line, col, raw, "unresolved_reason")
    return [hit, mine, near]


def first_records(records: DataFrame) -> DataFrame:
    """Each path's first record in storage order."""
    return records.groupBy("path").agg(F.min(F.struct("line", "col", "kind", "name")).alias("r")).select("path", "r.*")


def _mapped(records: DataFrame, prim: Primary) -> list[DataFrame]:
    """First records of paths that may be tests of a primary or settings of its area; the role decides later."""
    n = paths.normal(F.col("path"))
    word = F.regexp_replace(n, "[^a-z0-9]", "")
    named = paths.any_of([word.contains(x) for x in prim.needles]) if prim.needles else F.lit(False)
    area = (~n.contains("/") | n.rlike(r"^(?:\.github/workflows|config|configs|routes|schemas)/") | F.coalesce(paths.top_dir(n).isin(*prim.roots), F.lit(False))) & ~among("path", prim.paths) if prim.roots else F.lit(False)
    first = first_records(records.filter(named | area).select("path", "line", "col", "kind", "name")).withColumns({"named": named, "area": area})
    tests = _candidate(first.filter("named"), "test", "path", "'test_mapping'", NONE, "line", "col", "name", NONE)
    roots = ",".join(prim.roots).replace("\\", "\\\\").replace("'", "\\'")
    config = _candidate(first.filter("area"), "config", "path", "'file_role'", NONE, "line", "col", f"'{roots}'", NONE)
    return [tests, config]


def candidates(t: Tables, prim: Primary) -> DataFrame:
    """Rows of all producers near the (direct) primaries, not yet placed in groups."""
    own = prim.paths
    refs = _candidate(matching_refs(t, prim), "ref", "from_path", "ref_kind", "confidence", "from_line", "from_col", "to_name", NONE)
    deps = _edges(t.dependencies, own, "dep", "from_path", "from_line", "from_col", "dependency_kind", "import_path")
    files = _edges(t.file_references, own, "file", "source_path", "source_line", "source_col", "reference_kind", "raw_target")
    return reduce(DataFrame.unionByName, [refs, *deps, *files, *_mapped(t.records, prim)])


GROUP = f"""CASE producer WHEN 'ref' THEN {ranks.IMPACT_GROUP_FOR_REF} WHEN 'dep' THEN CASE WHEN role = 'test' THEN 'Tests' WHEN fixture THEN 'Unknown' ELSE 'Dependents' END
  WHEN 'file' THEN {ranks.IMPACT_GROUP_FOR_FILE_REF} WHEN 'test' THEN 'Tests' WHEN 'config' THEN 'Config' ELSE 'Unknown' END AS grp"""
KIND = "CASE WHEN producer LIKE 'file%' THEN 'file_' || kind WHEN producer = 'config' THEN 'file_role:' || role ELSE kind END AS kind"
CONFIDENCE = f"""CASE producer WHEN 'ref' THEN {ranks.IMPACT_CONFIDENCE_FOR_REF} WHEN 'dep' THEN CASE grp WHEN 'Tests' THEN 'test-related' WHEN 'Unknown' THEN 'heuristic' ELSE 'dependency' END
  WHEN 'file' THEN {ranks.FILE_REF_CONFIDENCE} WHEN 'test' THEN 'test-related' ELSE 'heuristic' END AS confidence"""
REASON = f"""CASE producer WHEN 'ref' THEN {ranks.IMPACT_REASON_FOR_REF} WHEN 'dep' THEN CASE grp WHEN 'Tests' THEN 'test dependency imports ' WHEN 'Unknown' THEN 'fixture/example dependency imports ' ELSE 'dependency imports ' END || target
  WHEN 'file' THEN kind || ' file reference to ' || target WHEN 'test' THEN 'same-name test convention' WHEN 'config' THEN role || ' applies to source area'
  WHEN 'dep_own' THEN 'unresolved dependency: ' || extra WHEN 'dep_near' THEN 'dependent file has unresolved dependency: ' || extra
  WHEN 'file_own' THEN 'unresolved file reference: ' || extra ELSE 'dependent file has unresolved file reference: ' || extra END AS reason"""
PRIORITY = f"""CAST(CASE WHEN producer = 'ref' THEN {ranks.IMPACT_REF_PRIORITY} WHEN producer = 'dep' THEN CASE WHEN grp = 'Unknown' THEN 20 ELSE 0 END WHEN producer = 'file' THEN {ranks.FILE_REF_PRIORITY} WHEN producer = 'test' THEN 5
  WHEN producer = 'config' THEN CASE WHEN role = 'package_manifest' THEN 0 WHEN role = 'build' AND norm LIKE '.github/%' THEN 4 WHEN role = 'build' THEN 1 WHEN role = 'config' THEN 3 ELSE 9 END
  WHEN producer LIKE '%\\\\_own' THEN 10 ELSE 20 END AS INT) AS priority"""
APPLIES = """NOT producer IN ('test', 'config') OR (producer = 'test' AND role = 'test')
  OR (producer = 'config' AND ((role IN ('package_manifest', 'build') AND (norm NOT LIKE '%/%' OR norm LIKE '.github/workflows/%' OR in_area)) OR (role = 'config' AND (norm RLIKE '^(?:config|configs|routes|schemas)/' OR in_area))))"""
"""Columns of placed rows over producer, kind, confidence, target, extra, role, fixture, norm, in_area and grp."""


def placed(rows: DataFrame, roots: list[str]) -> DataFrame:
    """Candidates with role, fixture flag, group, confidence, reason and priority; rows the role rules out are dropped."""
    n = paths.normal(F.col("path"))
    in_area = F.coalesce(paths.top_dir(n).isin(*roots), F.lit(False)) if roots else F.lit(False)
    rows = rows.withColumns({"role": paths.file_role(F.col("path")), "fixture": paths.is_fixture_path(F.col("path")), "norm": n, "in_area": in_area}).filter(APPLIES)
    number = ["n"] if "n" in rows.columns else []
    return rows.selectExpr("*", GROUP).selectExpr("producer", "grp", "path", "line", "col", KIND, "target", CONFIDENCE, REASON, PRIORITY, f"{ranks.ROLE_PENALTY} AS penalty", "role", "fixture", *number)


def best(rows: DataFrame) -> DataFrame:
    """The first candidate of each (producer, path, kind, confidence), which fix group and priority, and the number ``n`` of all."""
    one = rows.groupBy("producer", "path", "kind", "confidence").agg(F.min(F.struct("line", "col", "tie", "target", "extra")).alias("b"), F.count(F.lit(1)).alias("n"))
    return one.select("producer", "path", "kind", "confidence", "b.*", "n")


def impact_rows(t: Tables, prim: Primary) -> DataFrame:
    """All rows of all impact groups of the (direct) primaries."""
    return placed(candidates(t, prim).repartition("path"), prim.roots).select(*ROW)


def impact_key() -> list[Column | str]:
    return ["priority", "penalty", "path", "line", "col", "kind", "target", "confidence", "reason"]


def pack_key() -> list[Column | str]:
    return ["priority", F.expr(ranks.CONFIDENCE_RANK), "penalty", F.desc("ref_count"), "path", "line", "col", "kind", "target", "confidence", "reason"]


def budgeted(rows: DataFrame, groups: tuple[tuple[str, int], ...], total: int, key: list[Column | str]) -> DataFrame:
    """Take groups in order: best row per unused path, at most the group's limit and what is left of the total.

    First every group keeps, per path, its best row, and of these the ``limit x groups`` best (an upper bound
    of what it can still choose after the paths used before it are skipped); the rest is decided by one fold
    over at most that many rows per group.
    """
    cap = sum(n for _, n in groups)
    out_cols = [c for c in rows.columns if c != "penalty"]
    rows = rows if "penalty" in rows.columns else rows.withColumn("penalty", paths.context_penalty(F.col("path")))
    w1 = Window.partitionBy("grp", "path").orderBy(*key)
    w2 = Window.partitionBy("grp").orderBy(*key)
    short = rows.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") == 1).withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= cap)
    limits = dict(groups)
    place = {g: k for k, (g, _) in enumerate(groups)}
    cols = out_cols

    def fold(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        b = pd.concat(list(batches))
        b["_g"] = b["grp"].map(place)
        used: set[str] = set()
        taken, keep = 0, []
        for g, part in b.sort_values(["_g", "_r"]).groupby("_g", sort=True):
            room = min(limits[groups[int(g)][0]], total - taken)
            for i, p in zip(range(len(part)), part["path"], strict=True):
                if room <= 0:
                    break
                if p not in used:
                    used.add(p)
                    keep.append(part.iloc[i])
                    room -= 1
                    taken += 1
        out = pd.DataFrame(keep, columns=b.columns)[cols]
        yield out.reset_index(drop=True)

    known = short.filter(F.col("grp").isin(*limits))
    return known.select(*cols, "_r").coalesce(1).mapInPandas(fold, short.select(*cols).schema)


def impact(t: Tables, query: str, o: S.Options = S.Options()) -> DataFrame:
    """The bounded impact list; primaries come on top of the limit and their paths are not repeated."""
    prim = primary(t, query, o).direct()
    rows = placed(best(candidates(t, prim).filter(~among("path", prim.paths))), prim.roots).select(*ROW, "penalty")
    return budgeted(rows, IMPACT_GROUPS, o.taken(IMPACT_LIMIT), impact_key())


def pack_dependency_rows(t: Tables, prim: Primary) -> DataFrame:
    """Where the primaries' own edges lead: the target's first record, or line 1."""
    own = prim.paths
    test_paths = [r["path"] for r in prim.rows if r["role"] == "test"]
    mine = lambda df, src: df.filter(among(src, own) & F.col("target_path").isNotNull() & ~among("target_path", own))
    d = mine(t.dependencies, "from_path").selectExpr("target_path", "import_path AS raw", "dependency_kind AS kind", "'dependency' AS confidence", "'primary dependency imported at ' || from_path || ':' || from_line AS reason", "0 AS priority")
    f = mine(t.file_references, "source_path").withColumns({"kind": F.col("reference_kind"), "role": F.when(among("source_path", test_paths), "test").otherwise("")})
    f = f.selectExpr("target_path", "raw_target AS raw", "'file_' || kind AS kind", f"{ranks.FILE_REF_CONFIDENCE} AS confidence", "'primary file ' || kind || ' at ' || source_path || ':' || source_line AS reason", f"{ranks.FILE_REF_PRIORITY} AS priority")
    edges = d.unionByName(f)
    # the targets of at most three files, each of at most MAX_BYTES: they fit into a broadcast
    near = t.records.join(F.broadcast(edges.select(F.col("target_path").alias("path")).distinct()), "path", "left_semi")
    first = first_records(near).select(F.col("path").alias("target_path"), F.col("line").alias("_l"), F.col("col").alias("_c"), F.col("name").alias("_n"))
    j = edges.join(first, "target_path", "left")
    return j.select(F.lit("Dependencies").alias("grp"), F.col("target_path").alias("path"), F.coalesce("_l", F.lit(1)).alias("line"), F.coalesce("_c", F.lit(1)).alias("col"), "kind", F.coalesce("_n", "raw").alias("target"), "confidence", "reason", "priority")


def pack(t: Tables, query: str, o: S.Options = S.Options()) -> DataFrame:
    """The bounded read set: primaries count against the limit."""
    prim = primary(t, query, o).direct()
    near = placed(best(candidates(t, prim).filter(~among("path", prim.paths))), prim.roots)
    near = near.withColumn("ref_count", F.coalesce(F.sum(F.when(F.col("producer") == "ref", F.col("n"))).over(Window.partitionBy("path")), F.lit(0).cast("bigint")))
    docs_like = F.col("role").isin("docs", "generated", "vendor") | F.col("fixture")
    near = near.withColumn("grp", F.when(F.col("grp") == "Unknown", F.when(docs_like, "Docs").otherwise("Unresolved")).otherwise(F.col("grp")))
    far = pack_dependency_rows(t, prim).withColumns({"role": paths.file_role(F.col("path")), "fixture": paths.is_fixture_path(F.col("path"))}).selectExpr(*ROW, "0L AS ref_count", f"{ranks.ROLE_PENALTY} AS penalty")
    rows = near.select(*ROW, "ref_count", "penalty").unionByName(far)
    taken = budgeted(rows, PACK_GROUPS, max(0, o.taken(PACK_LIMIT) - len(prim.rows)), pack_key())
    top = [("Primary", r["path"], r["line"], r["col"], r["kind"], r["name"], "direct", "exact symbol match", 0, 0) for r in prim.rows]
    return taken.sparkSession.createDataFrame(top, taken.schema).unionByName(taken) if top else taken
