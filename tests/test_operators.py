"""Single operators on small inputs: nulls, ties, repeated rows, empty tables, random models."""

import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from waymark.functions import paths
from tests.outlines import FIXTURES
from waymark.operators import caps, extract, file_refs, manifest, quality, resolve, skew, symbols
from waymark.operators import context as C
from waymark.operators import search as S
from waymark.plans import build, ops
from waymark.sources import files as tree
from waymark.sources import store

REC = "path string, line int, col int, lang string, kind string, name string, text string, source string"
REF = "from_path string, from_line int, from_col int, to_name string, to_kind string, ref_kind string, confidence string, reason string, evidence string, source string"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_hot_keys_count_null_rows_and_ignore_other_columns(spark):
    a = spark.createDataFrame([("hot", 1)] * 60 + [(None, 1)] * 39 + [("x", 1)], "k string, key int")
    b = spark.createDataFrame([], "k string")
    got = rows(skew.hot_keys([("a", skew.table_states(a, "k")), ("b", skew.table_states(b, "k"))]), "field", "hot_key")
    assert got == [("a", "hot")]


def test_eager_join_sum_equals_join_then_sum(spark):
    r = random.Random(1)
    left = spark.createDataFrame([(r.choice(["a", "b", None]), r.choice([1, 2, None])) for _ in range(200)], "k string, v int")
    right = spark.createDataFrame([(r.choice(["a", "b", "c", None]),) for _ in range(90)], "k string")
    got = rows(skew.eager_join_sum(left, right, "k", F.col("v")), "key", "n_pairs", "sum_value")
    want = rows(left.join(right, "k").groupBy("k").agg(F.count(F.lit(1)), F.sum("v")), "*")
    assert got == want


def test_key_states_of_empty_table(spark):
    df = spark.createDataFrame([], "k string, f string, line int")
    assert skew.key_states(df, "k", "f", ["line"]).count() == 0


def model_caps(items, per_finer, per_file):
    finer, files, kept = {}, {}, []
    for f, k, n in sorted(items, key=lambda x: (x[0], x[2])):
        if files.get(f, 0) < per_file and finer.get((f, k), 0) < per_finer:
            finer[f, k] = finer.get((f, k), 0) + 1
            files[f] = files.get(f, 0) + 1
            kept.append((f, k, n))
    return sorted(kept, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_coupled_caps_equal_the_sequential_loop(spark, seed):
    r = random.Random(seed)
    items = [(r.choice("ab"), r.choice("xyz"), n) for n in range(60)]
    df = spark.createDataFrame(items, "f string, k string, n int")
    assert rows(caps.coupled_caps(df, "f", "k", 4, 9, ["n"]), "f", "k", "n") == model_caps(items, 4, 9)


@pytest.mark.parametrize("seed", [1, 2])
def test_global_caps_equal_the_sequential_loop(spark, seed):
    r = random.Random(seed)
    items = sorted({(r.choice("abcd"), n, r.choice("xyz")) for n in range(80)})
    df = spark.createDataFrame([(f, n, 1, t, None, "call", "syntax", None, "e", "s") for f, n, t in items], REF)
    by_t, by_f, want = {}, {}, []
    for f, n, t in items:
        if len(want) < 25 and by_t.get(t, 0) < 9 and by_f.get(f, 0) < 8:
            by_t[t], by_f[f] = by_t.get(t, 0) + 1, by_f.get(f, 0) + 1
            want.append((f, n, t))
    assert rows(caps.ref_caps_global(df, 9, 8, 25), "from_path", "from_line", "to_name") == sorted(want, key=str)


def test_keep_first_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None, 2), ("a", None, 1), ("a", "x", 3), ("a", "x", 3)], "p string, t string, n int")
    assert rows(caps.keep_first(df, ["p", "t"], ["n"]), "p", "t", "n") == [("a", "x", 3), ("a", None, 1)]


def test_search_without_matches_and_with_nulls(spark):
    r = spark.createDataFrame([(None, 1, 1, "py", "function", "Load", "t", "s"), ("a.py", 1, 1, "py", None, None, None, None), ("b.py", 2, 1, "py", "function", "load_x", "t", "s")], REC)
    assert [x["name"] for x in S.search(r, "load").collect()] == ["Load", "load_x"]
    assert S.search(r, " ").count() == 0
    assert S.search(r.limit(0), "load").count() == 0


def test_budgeted_take_skips_used_paths(spark):
    data = [("References", "p1", 1), ("References", "p1", 2), ("References", "p2", 3), ("Dependents", "p1", 1), ("Dependents", "p3", 2), ("Tests", "p2", 1), ("Tests", "p4", 9)]
    df = spark.createDataFrame([(g, p, n, 1, "k", "t", "c", "r", 0) for g, p, n in data], "grp string, path string, line int, col int, kind string, target string, confidence string, reason string, priority int")
    got = rows(C.budgeted(df, (("References", 1), ("Dependents", 5), ("Tests", 5)), 3, C.impact_key()), "grp", "path", "line")
    assert got == [("Dependents", "p3", 2), ("References", "p1", 1), ("Tests", "p2", 1)]


def test_context_of_a_missing_term_is_empty(spark):
    t = C.Tables(spark.createDataFrame([], REC), spark.createDataFrame([], REF), spark.createDataFrame([], "from_path string, from_line int, from_col int, import_path string, target_path string, dependency_kind string, lang string, confidence string, unresolved_reason string, evidence string, source string"), spark.createDataFrame([], "source_path string, source_line int, source_col int, raw_target string, target_path string, reference_kind string, lang string, confidence string, unresolved_reason string, evidence string, source string"))
    for make in (C.refs_of, C.impact, C.pack):
        assert make(t, "nothing").count() == 0


def test_line_landmarks(spark):
    f = spark.createDataFrame(
        [
            ("a.css", ".é .btn { }\n@keyframes  spin { }\n--main-x: 1; #id.two"),
            ("b.html", '<div id="x" class="a  b" data-testid="q"><img>\n<!-- <b> -->'),
            ("d.md", "# Title é  \n  - [x] do it \n####### no\n[l](docs/a.md)"),
            ("e.json", '{"a": 1, "b c": 2, "s": "x:"}'),
            ("f.toml", '[t.a]\nk = "v#x" # c\n"q.r"=1'),
            ("g.yaml", 'a: 1\n  - b:\n---\n"#": 2'),
            ("h.py", "# é TODO FIXME\r\n"),
            ("n.py", None),
            ("e.py", ""),
        ],
        "path string, text string",
    )
    got = set(rows(extract.line_landmarks(f), "path", "line", "col", "kind", "name"))
    want = {
        ("a.css", 1, 5, "css_class", ".btn"), ("a.css", 2, 13, "keyframes", "spin"), ("a.css", 3, 1, "css_variable", "--main-x"), ("a.css", 3, 14, "css_id", "#id"), ("a.css", 3, 17, "css_class", ".two"),
        ("b.html", 1, 2, "html_tag", "div"), ("b.html", 1, 10, "html_id", "#x"), ("b.html", 1, 20, "html_class", ".a"), ("b.html", 1, 23, "html_class", ".b"), ("b.html", 1, 26, "data_attribute", "data-testid"), ("b.html", 1, 43, "html_tag", "img"), ("b.html", 2, 7, "html_tag", "b"),
        ("d.md", 1, 3, "section", "Title é"), ("d.md", 2, 9, "checklist", "do it"), ("d.md", 4, 5, "link", "docs/a.md"),
        ("e.json", 1, 3, "key", "a"), ("e.json", 1, 21, "key", "s"), ("f.toml", 1, 2, "table", "t.a"), ("f.toml", 2, 1, "key", "k"), ("f.toml", 3, 1, "key", "q.r"),
        ("g.yaml", 1, 1, "key", "a"), ("g.yaml", 2, 5, "section", "b"), ("h.py", 1, 6, "todo", "TODO"), ("h.py", 1, 11, "fixme", "FIXME"),
    }
    assert got == want


def test_spans_on_a_long_line(spark):
    line = "é " + " ".join(f"w{k}" for k in range(1500))
    got = spark.createDataFrame([(line,)], "line string").select(F.explode(extract.spans(F.col("line"), "[a-z0-9]+")).alias("m")).select("m.*").collect()
    assert all(line.encode()[r["c"] - 1 :].startswith(r["t"].encode()) for r in got) and len(got) == 1500


def test_words_of_a_long_line_do_not_carry_it(spark):
    line = "  " + " ;  ".join(f"word{k}" for k in range(300))
    texts = spark.createDataFrame([("a.js", line)], "path string, text string")
    records = spark.createDataFrame([("b.js", 1, 1, "js", "function", f"word{k}", "", "tree_sitter") for k in range(300)], REC)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = extract.text_references(texts, records)
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert any("evidence#" in m for m in moved) and not any(re.search(r"\bline#", m) for m in moved if "line_no#" in m)
    short = " ".join(line.split())[:119] + "…"
    assert {(r["to_name"], r["from_col"], r["evidence"]) for r in got} == {(f"word{k}", line.index(f"word{k} ") + 1 if k < 299 else line.index("word299") + 1, short) for k in range(300)}


def test_resolver_tiers_suffixes_and_reasons(spark):
    f = spark.createDataFrame([(p,) for p in ("src/a/b.py", "app/x.py", "pkg/__init__.py", "web/u.ts", "web/lib/index.js", "lib/com/x/Z.java", "other/com/x/Z.java", "src/net/mod.rs")], "path string")
    e = [("src/a/m.py", "b", "python_import"), ("src/a/m.py", "x", "python_import"), ("t.py", "os", "python_import"), ("t.py", "pkg", "python_import"), ("web/v.ts", "./lib", "js_import"), ("web/v.ts", "react", "js_import"), ("q.java", "com.x.Z", "java_import"), ("q.java", "java.util.List", "java_import"), ("m.rs", "crate::net::T", "rust_use"), ("c.c", "stdio.h", "c_include")]
    df = spark.createDataFrame([(a, 1, 1, i, k, "x", "ev", "t") for a, i, k in e], "from_path string, from_line int, from_col int, import_path string, dependency_kind string, lang string, evidence string, source string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows(resolve.resolve(df, f), "from_path", "import_path", "target_path", "unresolved_reason")}
    assert got == {
        ("src/a/m.py", "b"): ("src/a/b.py", None), ("src/a/m.py", "x"): ("app/x.py", None), ("t.py", "os"): (None, "external_package"), ("t.py", "pkg"): ("pkg/__init__.py", None), ("web/v.ts", "./lib"): ("web/lib/index.js", None),
        ("web/v.ts", "react"): (None, "external_package"), ("q.java", "com.x.Z"): (None, "ambiguous_match"), ("q.java", "java.util.List"): (None, "external_package"), ("m.rs", "crate::net::T"): ("src/net/mod.rs", None), ("c.c", "stdio.h"): (None, "system_include"),
    }


def test_exploded_candidates_are_not_broadcast(spark, tmp_path):
    e = spark.createDataFrame([("a/m.js", 1, 1, f"./f{k}", "js_import", "js", "", "x") for k in range(20)], "from_path string, from_line int, from_col int, import_path string, dependency_kind string, lang string, evidence string, source string")
    e.write.parquet(f"{tmp_path}/edges")
    spark.createDataFrame([(f"a/f{k}.ts",) for k in range(10)], "path string").write.parquet(f"{tmp_path}/files")
    df = resolve.resolve(spark.read.parquet(f"{tmp_path}/edges"), spark.read.parquet(f"{tmp_path}/files"))
    joins = re.findall(r"(\w+Join) \[mode#", df._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}
    assert rows(df, "import_path", "target_path") == sorted([(f"./f{k}", f"a/f{k}.ts" if k < 10 else None) for k in range(20)], key=str)


def test_file_reference_resolution(spark):
    f = spark.createDataFrame([("h.py", "from .m import x"), ("d.md", "[a](docs/A.md) ![p](x.png) [u](http://x.y)"), ("m.py", ""), ("docs/a.md", "")], "path string, text string")
    got = rows(file_refs.resolve(extract.scan_file_references(f), f), "source_path", "raw_target", "target_path", "reference_kind", "unresolved_reason")
    assert got == [("d.md", "docs/A.md", "docs/a.md", "link", None), ("d.md", "x.png", None, "asset", "target_not_found"), ("h.py", "./m", "m.py", "import", None)]


def test_normal_paths(spark):
    p = spark.createDataFrame([("src/../lib/./a.py", "lib/a.py"), ("../../x", "x"), ("/a//b", "a/b")], "p string, w string")
    assert all(r["g"] == r["w"] for r in p.select("w", paths.normalize_rel(F.col("p")).alias("g")).collect())


TREE = {"a.py": "import b\nclass Alpha:\n    pass\n\nX = Alpha()\n", "b.py": "def beta():\n    return 1\n", "docs/x.md": "# Alpha\nsee [b](../b.py)\n"}


def manifest_of(spark, tree_, at):
    return spark.createDataFrame([(p, at.get(p, 1), len(t), t) for p, t in tree_.items()], "path string, mtime_ns bigint, size bigint, text string")


def test_incremental_equals_full(spark):
    old = build.full(spark, manifest_of(spark, TREE, {}))
    new_tree = TREE | {"b.py": "def beta():\n    return Alpha\n\ndef gamma():\n    return beta()\n"}
    files = manifest_of(spark, new_tree, {"b.py": 2})
    inc, full = build.incremental(spark, old, files), build.full(spark, files)
    for name in store.TABLES:
        assert rows(inc[name].select(*full[name].columns), "*") == rows(full[name], "*"), name


def test_build_from_a_directory(spark, tmp_path):
    root, out = tmp_path / "repo", str(tmp_path / "store")
    for p, t in (TREE | {"skip/z.py": "x = 1\n", "n.log": "x", "keep.log": "x"}).items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / ".gitignore").write_text("skip/\n*.log\n!keep.log\n")
    (root / "bin.py").write_bytes(b"\x00\x01")
    assert build.build_index(spark, str(root), out)["built"]
    tables = store.read_snapshot(spark, out)
    assert {r["path"] for r in tables["files"].collect()} == {*TREE, "keep.log", "bin.py", ".gitignore"}
    assert not build.build_index(spark, str(root), out)["built"]
    t = C.Tables(tables["records"], tables["refs"], tables["dependencies"], tables["file_references"])
    assert C.refs_of(t, "Alpha").count() > 0
    assert ops.tally(ops.doctor(tables, True, True))["fail"] == 0


def test_manifest_diff(spark):
    ddl = "path string, mtime_ns bigint, size bigint"
    a, b = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], ddl), spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], ddl)
    assert rows(manifest.diff(a, b), "path", "state") == [("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "added")]
    assert manifest.is_fresh(a, a) and not manifest.is_fresh(a, b)


def test_walk_sees_hidden_and_empty_files(spark, tmp_path):
    for name, text in {".github/workflows/ci.yml": "a: 1", ".env": "K=1", "_x/y z%20.py": "x = 1", "empty.py": "", ".git/info/exclude": "*.tmp\n", "a.tmp": "t", "d/e/f/g/h/deep.py": "y = 2", "d/.gitignore": "/e/f/no.py\n", "d/e/f/no.py": "", ".dev_index/z": "z", "b.log": "l"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r["path"]: r["text"] for r in tree.read_texts(spark, str(tmp_path), global_rules="*.log").collect()}
    assert got == {".github/workflows/ci.yml": "a: 1", ".env": "K=1", "_x/y z%20.py": "x = 1", "empty.py": "", "d/e/f/g/h/deep.py": "y = 2", "d/.gitignore": "/e/f/no.py\n"}
    assert {r["path"]: r["size"] for r in tree.walk(spark, str(tmp_path), global_rules="*.log").collect()} == {k: len(v) for k, v in got.items()}


def test_ignore_rules_order_and_anchors():
    import re

    rules = tree.ignore_rules("# c\n/build\n*.o\n!keep.o\ndocs/**/tmp/\n")
    hit = lambda p: next((not n for rx, n in reversed(rules) if re.match(rx, p)), False)
    assert [hit(p) for p in ("build/x", "a/build/x", "q.o", "keep.o", "docs/a/b/tmp/x", "docs/tmp")] == [True, False, True, False, True, False]


def greedy(records, comparator):
    used, pairs = set(), []
    for k, (p, ln, n) in enumerate(comparator):
        best = min((i for i, (q, m, o) in enumerate(records) if i not in used and (q, o) == (p, n) and abs(m - ln) <= 3), key=lambda i: (abs(records[i][1] - ln), i), default=None)
        if best is not None:
            used.add(best)
            pairs.append(k)
    return used, set(pairs)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_comparator_match_is_greedy(spark, seed):
    r = random.Random(seed)
    rec = sorted((r.choice("ab"), r.randint(1, 14), r.choice("xy")) for _ in range(25))
    com = sorted((r.choice("ab"), r.randint(1, 14), r.choice("xy")) for _ in range(25))
    a = spark.createDataFrame([(p, ln, k + 1, "py", "function", n, "t", "s") for k, (p, ln, n) in enumerate(rec)], REC)
    b = spark.createDataFrame([(p, ln, k + 1, "func", n, None) for k, (p, ln, n) in enumerate(com)], "path string, line int, column int, kind string, name string, language string")
    left, right = quality.comparator_match(a, b)
    used, pairs = greedy(rec, com)
    assert {x["col"] - 1 for x in left.filter("matched").collect()} == used
    assert {x["col"] - 1 for x in right.filter("matched").collect()} == pairs


def test_symbols_skip_comments_and_strings(spark):
    f = spark.createDataFrame([("a.ts", '// class No {}\nconst s = "function no() {}";\n/* class\n class No2 {} */\nexport class Yes {}\n'), ("b.py", "def f(:\n  pass\nclass Late:\n  pass\n")], "path string, text string")
    got = {(r["path"], r["kind"], r["name"]) for r in symbols.symbols(f).collect()}
    assert got == {("a.ts", "variable", "s"), ("a.ts", "class", "Yes"), ("b.py", "function", "f"), ("b.py", "class", "Late")}


@pytest.mark.parametrize("lang", sorted(FIXTURES))
def test_outlines(spark, lang):
    text, want, refs = FIXTURES[lang]
    f = spark.createDataFrame([(f"a/b.{lang}", text), (f"a/c.{lang}", ""), (f"a/d.{lang}", None), (None, text), (f"a/e.{lang}", text[: len(text) // 2])], "path string, text string")
    got = symbols.parsed(f).filter(f"path = 'a/b.{lang}'").collect()
    at = lambda ref: sorted(f"{r['kind']}:{r['name']}@{r['line']}:{r['col']}" for r in got if r["is_ref"] == ref)
    assert at(False) == sorted(re.split(r" (?=\w+:)", want))
    assert at(True) == sorted(refs.split())
    assert {r["lang"] for r in got} == {lang} and {r["source"] for r in got} == {"tree_sitter"}


def test_syntax_references(spark):
    f = spark.createDataFrame([("a.ts", FIXTURES["ts"][0]), ("b.py", "def f(:\n  pass\nclass Late:\n  pass\n")], "path string, text string")
    got = {(r["ref_kind"], r["to_kind"], r["to_name"], r["confidence"]) for r in symbols.syntax_refs(f).collect()}
    assert got == {("call", "callable", "check", "syntax"), ("export", "export", "make", "syntax")}
    assert {r["source"] for r in symbols.symbols(f).filter("path = 'b.py'").collect()} == {"line_rules"}


def test_gate_plan_and_exports(spark, tmp_path):
    import json

    from waymark.operators import gate
    from waymark.plans import reports

    rec = spark.createDataFrame([("a.py", k, 1, "py", "function", n, n, "tree_sitter") for k, n in ((1, "alpha"), (2, "beta"), (3, "gamma"), (4, "delta"))] + [("b.go", 1, 1, "go", "struct", "Box", "Box", "tree_sitter"), ("x.zz", 1, 1, "unknown", "key", "k", "k", "extras")], REC)
    ref = spark.createDataFrame([("a.py", 1, 1, "beta", None, "call", "syntax", "why", "beta()", "tree_sitter")] * 2, REF)
    ddl = "language string, path string, kind string, name string"
    expected = spark.createDataFrame([("py", None, None, "omega"), (None, None, None, "Lost"), ("go", None, "struct", "Box")], ddl)
    absent = spark.createDataFrame([(None, None, None, "Box")], ddl)
    thr = spark.createDataFrame([("py", 9, None, None)], "language string, min_records int, max_duplicate_locations int, max_malformed_records int")
    com = spark.createDataFrame([("a.py", 2, 1, "func", "beta", None), ("a.py", 9, 1, "func", "new", None)], "path string, line int, column int, kind string, name string, language string")
    g = gate.evaluate("r", rec, ref, expected, absent, [{"name_regex": "^z", "min_count": 1, "language": "py"}], thr, com)
    found = {r["item"]: r["failing"] for r in g.summary().collect()}
    assert found == {"expected symbols": 2, "expected patterns": 1, "expected absent symbols": 1, "thresholds": 1, "duplicate-records": 0, "duplicate-refs": 1, "malformed-records": 0, "malformed-refs": 0, "dev-index-paths": 0, "ctags-sources": 0}
    assert not g.passes()
    with pytest.raises(gate.GateFailure, match="expected symbols=2"):
        g.check()
    texts = [r["text"] for r in g.missing.orderBy("name").collect()]
    assert texts[1].endswith('language=Some("py") path=None kind=None name=omega nearby=a.py:1:1 function alpha (py); a.py:2:1 function beta (py); a.py:3:1 function gamma (py)') and "nearby=a.py:1:1" in texts[0]
    assert {r["language"] for r in g.languages.collect()} == {"py", "go", "unknown"}
    c, r = g.comparator
    gaps = quality.gaps(g.missing, g.failing, g.thresholds, g.integrity, g.extensions, c, r, g.found_absent)
    assert gaps.count() == 2 + 1 + 1 + 1 + 1 + 1 + 1 + 5
    plan = quality.cycle_plan(gaps, 3)
    assert [x["evidence_source"] for x in plan.filter("selected").orderBy("id").collect()] == ["expected-symbol", "expected-symbol", "integrity"]
    ends = lambda df, n=0: {x["condition"] for x in gate.finalize(plan, df, n).collect()}
    assert ends(gaps) == {"verification_failed_needs_human_review"}
    fixed = gaps.join(plan.filter("selected").select("id", F.lit(1).alias("s")), "id", "left").withColumn("status", F.when(F.col("s") == 1, "fixed").otherwise("unsupported")).drop("s")
    assert ends(fixed) == {"selected_gaps_fixed", "remaining_gaps_unsupported"} and "verification_failed_needs_human_review" in ends(fixed, 1)
    assert {x["condition"] for x in gate.finalize(plan.filter("false"), gaps.limit(0)).collect()} == {"no_selected_gaps"}
    assert "tests: index integrity regression coverage" in {x["target"] for x in gate.change_targets(plan).collect()}
    groups = quality.gap_groups(gaps).collect()
    assert len(groups) == gaps.count() and all(1 <= x["position"] <= x["size"] for x in groups) and max(x["size"] for x in groups if x["evidence_source"] == "record-only") == 3
    s = reports.export_summary(g, rec, ref, gaps, plan)
    reports.write_export(str(tmp_path / "q"), s, gate.details("r", g, gaps))
    assert json.loads((tmp_path / "q/QUALITY_REPORT.json").read_text())["gaps"]["severity"]["critical"] == 1 and "| Rust | supported | .rs |" in (tmp_path / "q/QUALITY_REPORT.md").read_text()
    lines = spark.read.json(str(tmp_path / "q/QUALITY_REPORT_DETAILS"))
    assert lines.count() == 4 + 1 + 5 + gaps.count()
    assert "missing" in reports.gate_report(g) and "GAP-0001" in reports.plan_report("QUALITY_CYCLE_01", plan) and "stop conditions: none" in reports.final_report("C", gate.finalize(plan, gaps).limit(0))


def test_triage_states_and_strict_check(spark):
    from waymark.operators import gate
    from waymark.plans import reports

    one = spark.createDataFrame([("a", 1, "function", "x", "py"), ("a", 2, "function", "y", "py")], "path string, line int, kind string, name string, language string")
    items = quality.triage(one, one.limit(1))
    with pytest.raises(gate.GateFailure, match="3 open"):
        gate.check_triage("r", items)
    done = gate.promoted(items.withColumn("state", F.lit("fixed")))
    gate.check_triage("r", done)
    assert {r["promotion"] for r in done.collect()} == {"rerun quality gates and keep regression coverage"}
    assert spark.createDataFrame([("open",)], "s string").select(gate.triage_state(F.col("s"))).first()[0] == "open"
    with pytest.raises(Exception, match="unknown triage state"):
        spark.createDataFrame([("nope",)], "s string").select(gate.triage_state(F.col("s"))).collect()
    assert "open: 3" in reports.triage_report("r", items)
    assert sorted((r["source"], r["position"], r["size"]) for r in quality.triage_groups(items).collect()) == [("comparator-only", 1, 2), ("comparator-only", 2, 2), ("record-only", 1, 1)]


def test_support_and_forbidden_tools(spark):
    from waymark.plans import support

    assert support.matrix(spark).count() == 32 and {r["level"]: r["n"] for r in support.counts(spark).collect()} == {"supported": 14, "experimental": 5, "extras-backed": 6, "blocked": 7}
    assert support.entry(spark, "go").first()["real_repo"].startswith("fixture + committed") and support.dashboard(spark).count("\n| ") == 32 + 4 + 4
    t = spark.createDataFrame([("src/a.rs", "x\nuse Ctags\n"), ("src/quality/b.rs", "ctags"), ("docs/QUALITY.md", "ctags"), ("tests/c.rs", "ctags"), ("d", None)], "path string, text string")
    assert [(r["path"], r["line"]) for r in ops.forbidden_lines(t).orderBy("path").collect()] == [("src/a.rs", 2), ("tests/c.rs", 1)]
    assert [r["path"] for r in ops.forbidden_artifacts(spark.createDataFrame([("bin/ctags",), ("bin/ctags-5",), ("ctagsx",)], "path string")).orderBy("path").collect()] == ["bin/ctags", "bin/ctags-5"]
    assert "filenames" in ops.miss_report("q") and "filenames" not in ops.miss_report("q", S.Options(kind="class"))


def test_usage_report(spark):
    from waymark.plans import reports
    from waymark.streaming import usage_stream as U

    e = spark.createDataFrame([(k, 1_000_000 - k, c, f"q{k}", 1, n, n > 0, False, False, False, False, "r", 1) for k, (c, n) in enumerate([("search", 2), ("pack", 4), ("impact", 6), ("search", 0)])], U.SCHEMA)
    text = reports.usage_report(e, 1_000_000)
    assert "1d        4         3     1       75.0%      3.0" in text and "Context commands: 2 (refs 0, pack 1, impact 1)" in text and text.rstrip().endswith("- q3")


RESOLVED = [
    # kind, from, import, target or None, reason or None
    ("python_import", "app/a.py", "util", "app/util.py", None),
    ("python_import", "app/a.py", "pkg.core", "src/pkg/core.py", None),
    ("python_import", "app/a.py", "pkg", "src/pkg/__init__.py", None),
    ("python_import", "app/a.py", "numpy", None, "external_package"),
    ("python_import", "app/a.py", "pkg.none", None, "target_not_found"),
    ("python_import", "app/a.py", ".", None, "target_not_found"),
    ("js_import", "web/x.ts", "./both", None, "ambiguous_match"),
    ("js_import", "web/x.ts", "../lib/k", "lib/k/index.js", None),
    ("js_import", "web/x.ts", "mypkg/lib/k", "lib/k/index.js", None),
    ("js_import", "web/x.ts", "react", None, "external_package"),
    ("js_import", "web/x.ts", "./gone", None, "target_not_found"),
    ("go_import", "cmd/m.go", "ex.org/m/inner", "inner/one.go", None),
    ("go_import", "cmd/m.go", "ex.org/m/none", None, "target_not_found"),
    ("go_import", "cmd/m.go", "far.org/q/inner", None, "external_package"),
    ("go_import", "cmd/m.go", "fmt", None, "external_package"),
    ("java_import", "x/A.java", "a.b.Box", "src/main/java/a/b/Box.java", None),
    ("java_import", "x/A.java", "c.Far", "deep/c/Far.java", None),
    ("java_import", "x/A.java", "a.b.*", "src/main/java/a/b/Box.java", None),
    ("java_import", "x/A.java", "java.util.List", None, "external_package"),
    ("java_import", "x/A.java", "a.b.None", None, "target_not_found"),
    ("kotlin_import", "x/A.kt", "k.Thing", "src/main/kotlin/k/Thing.kt", None),
    ("scala_import", "x/A.scala", "scala.math", None, "external_package"),
    ("cs_import", "x/A.cs", "My.Tools", "src/My/Tools.cs", None),
    ("cs_import", "x/A.cs", "static System.Math", None, "external_package"),
    ("c_include", "c/m.c", "own.h", "c/own.h", None),
    ("c_include", "c/m.c", "far.h", "inc/far.h", None),
    ("c_include", "c/m.c", "stdio.h", None, "system_include"),
    ("c_include", "c/m.c", "none.h", None, "target_not_found"),
    ("php_include", "p/a.php", "b.php", "p/b.php", None),
    ("php_include", "p/a.php", "rooted.php", "rooted.php", None),
    ("swift_import", "s/A.swift", "Core", "s/mod/Core.swift", None),
    ("swift_import", "s/A.swift", "Foundation", None, "external_package"),
    ("dart_import", "d/a.dart", "package:mine/x.dart", "lib/x.dart", None),
    ("dart_import", "d/a.dart", "package:other/x.dart", None, "external_package"),
    ("dart_import", "d/a.dart", "dart:io", None, "external_package"),
    ("dart_import", "d/a.dart", "./b.dart", "d/b.dart", None),
    ("dart_import", "d/a.dart", "b.dart", None, "target_not_found"),
    ("rust_module", "src/main.rs", "util", "src/util.rs", None),
    ("rust_module", "src/main.rs", "deep", "src/deep/mod.rs", None),
    ("rust_use", "src/deep/mod.rs", "crate::util::f", "src/util.rs", None),
    ("rust_use", "src/deep/mod.rs", "super::util::f", "src/util.rs", None),
    ("rust_use", "src/deep/mod.rs", "self::leaf::f", "src/deep/leaf.rs", None),
    ("rust_use", "src/deep/mod.rs", "std::fmt", None, "external_package"),
    ("ruby_require", "r/a.rb", "./b", "r/b.rb", None),
    ("ruby_require", "r/a.rb", "json", None, "external_package"),
    ("shell_source", "sh/a.sh", "lib.sh", "sh/lib.sh", None),
    ("shell_source", "sh/a.sh", "/etc/x", None, "absolute_path"),
    ("nix_import", "n/a.nix", "./b.nix", "n/b.nix", None),
    ("odd_import", "n/a.zig", "b", None, "unsupported_language"),
]


def test_resolvers_of_all_languages(spark):
    have = {t for _, _, _, t, _ in RESOLVED if t} | {"web/both.ts", "web/both.js", *(f for _, f, *_ in RESOLVED)}
    files = spark.createDataFrame([(p,) for p in sorted(have)] * 2, "path string")
    edges = spark.createDataFrame([(f, k, 1, imp, kind, "l", "e", "s") for k, (kind, f, imp, _, _) in enumerate(RESOLVED)], "from_path string, from_line int, from_col int, import_path string, dependency_kind string, lang string, evidence string, source string")
    got = {(r["dependency_kind"], r["from_path"], r["import_path"]): (r["target_path"], r["unresolved_reason"], r["confidence"]) for r in resolve.resolve(edges, files, go_module="ex.org/m", js_package="mypkg", dart_package="mine").collect()}
    for kind, f, imp, target, reason in RESOLVED:
        assert got[kind, f, imp] == (target, reason, "resolved" if target else "ambiguous" if reason == "ambiguous_match" else "unresolved"), (kind, imp)


def test_command_grammar():
    assert ops.parse_command(["refs", "x", "y"]) == ("refs", "x y")
    assert ops.parse_command(["doctor"]) == ("doctor", "")
    assert ops.parse_command(["refs"]) == ("search", "refs")


def test_benchmark_manifest_and_comparator_input(spark, tmp_path):
    m = store.benchmark_manifest('[[repo]]\nname = "r"\nqueries = ["a", "a", "b"]\n[[repo.expected_symbol]]\nname = "X"\n[[repo.quality_threshold]]\nlanguage = "py"\nmin_records = 3\n')
    assert m[0]["queries"] == ["a", "b"] and store.expectations(spark, m)["expected_symbol"].count() == 1
    p = tmp_path / "c.jsonl"
    p.write_text('{"_type": "tag", "path": "./a.py", "name": "x", "kind": "f"}\n{"_type": "ptag"}\n')
    assert rows(store.comparator_records(spark, str(p)), "path", "line", "name") == [("a.py", 0, "x")]


def test_usage_stream(spark, tmp_path):
    from waymark.streaming import usage_stream as U

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(k % 5, 1_700_000_000 + k % 5, "search", "q", 1, 1, True, False, False, False, False, "r", 1) for k in range(10)], U.SCHEMA).write.parquet(src)
    q = U.append_distinct(U.read_events(spark, src), out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 5


def test_parent_relative_imports_against_brute_force(spark, tmp_path):
    import itertools
    import posixpath

    from waymark.plans import extract_queries
    from waymark.registry import Registry

    exts = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "json"]
    files = ["a/b/x.ts", "a/y.ts", "a/z.js", "a/z.ts", "c/index.js", "top.json", "a/b/c/w.css"]
    edges = list(itertools.product(["a/b/m.ts", "a/n.js", "root.ts"], ["./x", "../y", "../z", "../../c", "../../top", "../b/x.ts", "../b/../y", "../none", "./../y", "react", ".", ".."]))
    spark.createDataFrame(edges, "from_path string, import_path string").write.parquet(f"{tmp_path}/dependencies.parquet")
    spark.createDataFrame([(p,) for p in files], "path string").write.parquet(f"{tmp_path}/files.parquet")

    def target(src, imp):
        base = posixpath.normpath("/" + posixpath.join(posixpath.dirname(src), imp)).lstrip("/")
        keys = [base] if "." in imp.rsplit("/", 1)[-1].lstrip(".") else [base, *[f"{base}.{e}" for e in exts], *[f"{base}/index.{e}" for e in exts]]
        got = [k for k in keys if k in files]
        return (got[0] if len(got) == 1 else None, "resolved" if len(got) == 1 else "ambiguous" if got else "unresolved")

    want = sorted(((s, i, *target(s, i)) for s, i in edges if i.startswith(("./", "../"))), key=str)
    reg = Registry()
    extract_queries.register(reg)
    got = reg.builders["resolve_relative_imports"](spark, str(tmp_path))
    assert rows(got, "from_path", "import_path", "target_path", "confidence") == want
    assert {"resolved", "ambiguous", "unresolved"} == {w[3] for w in want if w[1].startswith("../")}
