"""Training-data operators against brute force, exact libraries, held-out lines and small edge cases."""

import random
from collections import Counter

import pytest

pytest.importorskip("waymark.llm")
from waymark.llm import bpe, credentials, langid, leakage, machine_made  # noqa: E402
from waymark.llm.frequency import frequencies  # noqa: E402
from waymark.llm.queries import LLM  # noqa: E402
from waymark.llm.syntax import chunks, grammar  # noqa: E402
from waymark.llm.syntax.files import judged, verdicts  # noqa: E402
from tests.oracle import DATA, difference  # noqa: E402

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM.sql))
def test_equals_sql(spark, name):
    assert difference(spark, name, LLM.builders[name], LLM.sql[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(LLM.builders) - set(LLM.sql)))
def test_runs(spark, name):
    assert LLM.builders[name](spark, FOLDER).count() >= 0


# frequencies
def test_frequencies_against_a_counter(spark):
    r = random.Random(5)
    rows = [(r.choice(["p", "q", None]), r.randint(1, 5), 1, r.choice(["a", "b", "", None]), "k", "extra") for _ in range(300)]
    df = spark.createDataFrame(rows, "path string, line int, col int, name string, kind string, term string")
    places = {(t, p, ln, c) for p, ln, c, t, _, _ in rows if t is not None}
    got = {x["term"]: x["occurrences"] for x in frequencies(df, ["name"]).collect()}
    assert got == Counter(t for t, *_ in places)
    assert frequencies(df.limit(0), ["name", "kind"]).count() == 0


# tokens
def test_bpe_equals_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(open(bpe.default_vocabulary(), "rb").read())
    exact = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "aaaa" * 500, "<|endoftext|> it's  x\n\n", "日本語 ÀÉ ﬁ 👩‍👧 \u200b", "the the the", *[chr(random.Random(k).randint(32, 0x2FFF)) * (k % 7) for k in range(200)]]
    enc = bpe.PairIndexEncoder(ranks)
    flat, off = enc.encode(texts)
    assert all(flat[off[k] : off[k + 1]].tolist() == exact.encode_ordinary(t) for k, t in enumerate(texts))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi")], "doc_id bigint, text string")
    assert {r["doc_id"]: len(r["ids"]) for r in bpe.encode_texts(df, "doc_id", "text").collect()} == {1: 0, 2: 0, 3: 1}


# leakage
def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta eta theta 12 34 Mira Tovel".split()
    items = [(k, " ".join(r.choice(words) for _ in range(40))) for k in range(6)]
    docs = [(100 + k, " ".join(r.choice(words) for _ in range(9)) + " <br/> " + " ".join(items[k % 6][1].upper().split()[5 : 5 + n]) + "&nbsp;end") for k, n in enumerate([11, 12, 13, 30, 0, 20])] + [(200, None), (201, "")]
    win = lambda t: {tuple(w[i : i + 12]) for w in [leakage.norm_words(t)] for i in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, s in items if win(t) & win(s)}
    for b in (leakage.MAX_BITS, 64):
        got = leakage.verbatim(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), max_bits=b)
        assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want


def test_renamed_template_is_found(spark):
    item = "Today the miller Tovel carried 15 apples to Mira and told old Tovel again what he saw"
    doc = "Today the miller Sandro carried 99 apples to Ilse and told old Sandro again what he saw"
    bad = doc.replace("old Sandro", "old Berta")
    docs = spark.createDataFrame([(1, doc), (2, bad)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert leakage.verbatim(docs, items).count() == 0
    got = {x["doc_id"]: x["templates"] for x in leakage.template_matches(docs, items).collect()}
    assert got[1] > got.get(2, 0)


def test_every_item_of_a_renamed_passage_is_reported(spark):
    first = "Today the miller {} carried {} apples to {} and told old {} again what he saw"
    second = "Every autumn the weaver {} sold {} ribbons beside the harbour while young {} counted coins nearby"
    items = [(7, first.format("Tovel", 15, "Mira", "Tovel")), (8, second.format("Runa", 4, "Pim")), (9, first.format("Hanno", 3, "Lisbet", "Hanno")), (10, None)]
    docs = [(1, first.format("Sandro", 99, "Ilse", "Sandro") + ". " + second.format("Karla", 6, "Jost")), (2, second.format("Karla", 6, "Jost")), (3, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for bits in (leakage.MAX_BITS, 256):
        got = leakage.template_matches(df, spark.createDataFrame(items, "item_id bigint, text string"), max_bits=bits).collect()
        assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(1, 7), (1, 8), (1, 9), (2, 8)]
        assert all(x["templates"] > 0 for x in got)


def test_recall_of_renamed_items(spark):
    """Items asked again with other names, numbers and units, in other texts: at least nine of ten are found, no other pair."""
    r = random.Random(9)
    plain = "the old miller carried stones across bridge and market where ferryman paid for nimble harbor every winter while scribe wrote down what young weaver had told about ribbons near misty valley".split()
    name = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(3)).capitalize()
    frames = [[r.choice(plain) if r.random() < 0.75 else r.choice("ndu") + str(r.randint(0, 3)) for _ in range(40)] for _ in range(30)]

    def fill(frame: list[str]) -> str:
        slots = {s: name() if s[0] == "n" else str(r.randint(10, 999)) if s[0] == "d" else r.choice(["days", "weeks", "hours", "metres"]) for s in sorted({x for x in frame if x[1:].isdigit()})}
        return " ".join(slots.get(x, x) for x in frame)

    items = [(k, fill(f)) for k, f in enumerate(frames)]
    docs = [(100 + k, f"We liked it. Then {fill(f)} and so on.") for k, f in enumerate(frames)]
    got = {(x["doc_id"], x["item_id"]) for x in leakage.template_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    right = {(100 + k, k) for k in range(30)}
    assert len(got & right) >= 27 and not got - right
    assert leakage.verbatim(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items[:0], "item_id bigint, text string")).count() == 0


# languages
def test_language_labels_and_stretches():
    lab = langid.Labeller(langid.load_weights())
    en, de = "The kettle works exactly as described and feels solid.", "Das Kabel könnte ruhig ein bisschen länger sein."
    (a, _, _), (b, _, rows), none, blank = lab.documents([en, f"{en} {de}", None, "?! 12"])
    assert a == "en" and set(langid.whole_sentence_languages(b, rows)) == {"en", "de"} and none[0] is None and blank[0] is None
    assert [x[1] for x in langid.stretches(rows)] == ["en", "de"]
    assert [langid.label_code(x) for x in (" EN", "en_GB", "deu", "zxx", "", None, "Français")] == ["en", "en", "de", None, None, None, "fr"]


def test_short_second_language_sentences_count():
    lab = langid.Labeller(langid.load_weights())
    host = "The kettle works exactly as described and feels solid."
    cases = [("Дякую.", "uk"), ("Спасибо.", "ru"), ("Dziękuję.", "pl"), ("Sehr gut.", "de"), ("Très bon.", "fr"), ("良い。", "ja"), ("最高。", "ja")]
    got = [c in langid.whole_sentence_languages(m, rows) for (_, c), (m, _, rows) in zip(cases, lab.documents([f"{host} {s}" for s, _ in cases]), strict=True)]
    assert sum(got) >= 3


def test_long_and_repeated_sentences(monkeypatch):
    lab = langid.Labeller(langid.load_weights())
    en = "the kettle works exactly as described and feels solid in the hand "
    (a, p, rows), (b, q, _), (c, r, _) = lab.documents([en * 400, en.strip(), "x" * 30_000 + "!"])
    assert (a, b) == ("en", "en") and len(rows) == 1 and p > 0.9 and q > 0.9 and c is not None
    assert all(len(x) <= langid.LONGEST for x in langid.runs(b"ab " * 9000)) and b"".join(langid.runs(b"ab " * 9000)) == b"ab " * 9000
    texts = [f"{en} {k % 3}. Das Kabel ist etwas kurz." for k in range(30)] + [None, "", "12"]
    once = lab.documents(texts)
    monkeypatch.setattr(langid, "REMEMBERED", 0)
    monkeypatch.setattr(langid, "BATCH_POSITIONS", 50)
    for x, y in zip(once, [langid.Labeller(lab.net.p).documents([t])[0] for t in texts], strict=True):
        assert x[0] == y[0] and (x[1] is None or abs(x[1] - y[1]) < 1e-5) and [s[1] for s in x[2]] == [s[1] for s in y[2]]


# credentials
def test_crf_on_held_out_lines():
    from waymark.llm.train_credentials import labelled, lines

    finder = credentials.Finder(credentials.Crf.load(credentials.WEIGHTS))
    own = [labelled(m) for m in lines(600, 4242)]
    wrong = sum(bool(s) != any(m) for (_, m), s in zip(own, finder.spans([t for t, _ in own]), strict=True))
    assert wrong <= 6


def test_redaction_keeps_the_rest():
    finder = credentials.Finder(credentials.Crf.load(credentials.WEIGHTS))
    text = 'password = "Mira_tovel5512!"  # keep'
    (spans, none, empty) = finder.spans([text, None, ""])
    assert credentials.redacted(text, spans) == 'password = "[REDACTED]"  # keep' and none == [] and empty == []
    joined = 'const apiKey = "sk_live_A1b2C3d4E5f6" + "G7h8I9j0K1l2";'
    assert "A1b2C3" not in credentials.redacted(joined, finder.spans([joined])[0]) and "G7h8" not in credentials.redacted(joined, finder.spans([joined])[0])


# machine-made files
@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("r/src/a.go", "// Code generated by x. DO NOT EDIT.\npackage a\n", "generated"),
        ("r/src/a.py", 'NOTE = "do not edit"\n', None),
        ("r/vendor/x/a.py", "# (c) the r authors\nx = 1\n", "hand"),
        ("r/src/a.js", "var a=1,b=22;" * 200, "minified"),
        ("r/src/a.py", "T = [\n" + "    1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12,\n" * 20 + "]\n", "bulk data"),
        ("r/lib/a.py", "# imported from the q distribution at tag v1\nx = 1\n", None),
    ],
)
def test_text_evidence(path, text, want):
    got = machine_made.text_reason(path, text, machine_made.automaton())
    assert got == want or (want is None and got == "third party")


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("r/src/a.js", "export const T = [\n" + '    ["brapo", 0.16131, 864],\n' * 20 + "];\n", "bulk data"),
        ("r/src/a.py", "T = [\n" + '    ("New York", -1.5e-3, None),\n' * 20 + "]\n", "bulk data"),
        ("r/src/a.ts", "export const T = [\n" + '    { id: 12, name: "brapo" },\n' * 20 + "];\n", "bulk data"),
        ("r/src/a.py", "T = [" + "1, 22, 333, " * 50 + "]\n", "bulk data"),
        ("r/src/a.go", "package a\n\nvar T = []int{" + "1, 22, 333, " * 20_000 + "}\n", "bulk data"),
        ("r/src/a.py", "T = (\n" + "    'deadbeef',\n" * 30 + ")\n", "bulk data"),
        ("r/src/a.py", "A = [(1, 2), (3, 4)]\n", None),
        ("r/src/a.py", "M = [\n" + ''.join(f'    "the {w} could not be read",\n' for w in "file row key name page list tree node edge path".split() * 3) + "]\n", None),
        ("r/src/a.py", "x = f(a, 1) + g(b, 2)\n" * 5 + "y = h(x)\n" * 40, None),
        ("r/src/a.css", "".join(f".box{k} {{ margin: 1px; padding: 2px; width: 3px }}\n" for k in range(15)), None),
    ],
)
def test_tables_of_any_shape_are_bulk_data(path, text, want):
    assert machine_made.text_reason(path, text, machine_made.automaton()) == want


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("r/src/a.java", "/*\n * Code generated by X. DO NOT EDIT.\n */\npackage a;\n", "generated"),
        ("r/src/a.js", "\n/**\n   This file was generated.\n*/\nlet a = 1;\n", "generated"),
        ("r/src/a.html", "<!doctype html>\n<!--\n  Automatically generated\n-->\n<p>\n", "generated"),
        ("r/src/a.py", '#!/usr/bin/env python\n"""Tables.\n\nDo not edit.\n"""\nx = 1\n', "generated"),
        ("r/src/a.py", '"Automatically generated."\nx = 1\n', "generated"),
        ("r/src/a.rs", "  // @generated\nfn f() {}\n", "generated"),
        ("r/src/a.go", "/* Unmodified copy of q */\npackage a\n", "third party"),
        ("r/dist/a.js", "/*\n   Edited by hand.\n */\nlet a = 1;\n", "hand"),
        ("r/src/a.js", "let a = 1;\n/*\n   do not edit\n */\n", None),
        ("r/src/a.js", "/* a */ let b = 'do not edit';\n", None),
        ("r/src/a.py", 'x = 1\n"""\n do not edit\n"""\n', None),
        ("r/src/a.js", "let a = 1;\n// do not edit\n", "generated"),
    ],
)
def test_notices_in_headers(path, text, want):
    assert machine_made.text_reason(path, text, machine_made.automaton()) == want


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("r/src/a.py", "# offsets copied from the header table\nx = 1\n", None),
        ("r/src/a.py", "# totals generated from the ledger are cached\nx = 1\n", None),
        ("r/src/a.go", "// written by the protoc compiler\n// Code generated by protoc. DO NOT EDIT.\npackage a\n", "generated"),
        ("r/src/a.py", "# Copyright the r authors. Written by the x team.\n# Code generated by q.\n", "generated"),
        ("r/src/a.py", "# writes files that say DO NOT EDIT; this one is edited by hand.\nx = 1\n", "hand"),
        ("r/src/a.py", "x = 1\n# do not modify the list while it is read\n", None),
        ("r/src/a.py", "x = 1\n# Generated from the ledger.\n", None),
        ("r/src/a.py", "# Generated from api.proto\nx = 1\n", "generated"),
        ("r/src/a.py", "# This file was copied from the q project\n", "third party"),
        ("r/src/a.py", "# It must not be edited by hand\n", "generated"),
        ("r/src/a.py", "# No longer generated by x.\n", "hand"),
        ("r/src/a.js", "\n".join(f"// line {k}" for k in range(300)) + "\n/*! q 1.2.3 */\nlet a = 1\n", "third party"),
    ],
)
def test_notices_are_told_from_remarks(path, text, want):
    assert machine_made.text_reason(path, text, machine_made.automaton()) == want


def test_texts_of_one_path_are_settled_by_a_stated_order(spark):
    src = spark.createDataFrame([("r/a.py", "# Code generated by x.\n"), ("r/a.py", "# Edited by hand.\n"), ("r/b.py", "x = 1\n"), ("r/b.py", "# Vendored from q.\n"), ("r/b.py", "# @generated\n")], "path string, text string")
    files = spark.createDataFrame([("r/a.py", 1), ("r/b.py", 2), ("vendor/c.py", 3), ("r/Gen/d.py", 4)], "path string, shown int")
    assert {x["path"]: x["reason"] for x in machine_made.judge_files(files, src).collect()} == {"r/a.py": None, "r/b.py": "third party", "vendor/c.py": None, "r/Gen/d.py": "generated"}


def test_table_tokens_are_linear():
    assert not machine_made.bulk("deadbeef" * 20_000 + "!" + " g" * 200_000 + "h" * 200_000 + "\\" * 50_000 + '"' * 50_001)


def test_paths_decide_without_text(spark):
    files = spark.createDataFrame([("r/vendor/a.js",), ("r/vendor/a.js",), ("r/a.js",), ("r/package-lock.json",), (None,)], "path string")
    src = spark.createDataFrame([("r/vendor/a.js", None), ("r/a.js", "")], "path string, text string")
    assert {x["path"]: x["reason"] for x in machine_made.judge_files(files, src).collect()} == {"r/vendor/a.js": "third party", "r/a.js": None, "r/package-lock.json": "lock file"}


# syntax
GOOD = {
    "py": ["", "x = 1\nif x:\n    y = '''\na = (\n'''\nelse:\n    pass\n", "@d\ndef f():\n    return (1,\n2)\n"],
    "js": ["", "const a = `x${b ? `y${c}` : '}'}`; export default class A { #p = /[/]\\/}/g; get x() { return this.#p } }", "for (const [k, v] of m) { l: while (1) { break l } }\n(async () => { await x?.y })()"],
    "ts": ["export interface A<T> extends B { readonly x?: T[]; f(a: string): void }\ntype U = A<string> | (() => void);\nfunction g<T extends U>(x: T, ...y: any[]): x is T { return (x as any)!.z }\nenum E { A = 1, B }"],
    "go": ["package a\nimport (\n\t\"b\"\n)\ntype T struct {\n\tA int `json:\"a\"`\n}\nfunc (t *T) F(x map[string][]int) (int, error) {\n\tfor i, v := range x[\"a\"] {\n\t\tif y := v; y > i {\n\t\t\treturn T{A: 1}.A, nil\n\t\t}\n\t}\n\treturn 0, nil\n}\n"],
    "rs": ["use a::{b, c::*};\n#[derive(Debug)]\npub struct S<'a, T: X + 'a> { x: &'a [T] }\nimpl<'a, T: X> S<'a, T> { fn f(&self) -> Option<Vec<T>> { let v = self.x.iter().map(|y| y + 1).collect::<Vec<_>>(); match v { _ if v.len() > 1 => None, [a, .., b] => { Some(vec![]) } _ => return None, } } }\n"],
    "java": ["package a.b;\nimport java.util.*;\npublic class A<T extends B> implements C {\n  private final Map<String, List<T>> m = new HashMap<>();\n  @Override public int f(int... x) throws E { for (var y : x) { if (y instanceof Integer i && i > 0) return (int) y; } return m.values().stream().map(v -> v.size()).mapToInt(Integer::intValue).sum(); }\n  enum D { X, Y; }\n}\n"],
    "json": ['{"a": [1, 2.5e3, null, "x\\u00e9"]}'],
    "toml": ["", 'a = 1\n[b.c]\nd = """x\n"""\n'],
    "yaml": ["", "a: 1\nb:\n- x\n- y: {z: [1, 2]}\nc: |\n  t: u\n", "K=1\nL=2\n"],
}
BAD = {
    "py": ["def f(:\n", "x = 'a\n", "if x:\n", "return 1\n", "<<<<<<< HEAD\nx = 1\n"],
    "js": ["return 1", "let x = ;", "const a: number = 1", "f(", "if (a {", "@@ -1 +1 @@"],
    "ts": ["interface A { x", "let = = 1", ">>>>>>> theirs"],
    "go": ["", "func f() {}", "package a\nfunc f( {\n}\n", "package a\nvar x = \n"],
    "rs": ["fn f( { }", "let x = 1;", "fn f() { a b }"],
    "java": ["class A { int f() { return } ", "int x = 1;", "class A { void f() { a b c; } }"],
    "json": ["", "{a: 1}", '{"a": 1,}', "// x\n{}", "NaN"],
    "toml": ["a = ", "[x", "a == 1"],
    "yaml": ["a: b: c", "a: [1, 2", "- a\nb: c", "a: 'x", "a: 1\n\tb: 2"],
}


@pytest.mark.parametrize("ext", sorted(GOOD))
def test_grammars(ext):
    assert [t for t in GOOD[ext] if grammar.parse(t, ext)] == []
    assert [t for t in BAD[ext] if not grammar.parse(t, ext) and not (ext in chunks.SPECS and chunks.fault(chunks.summary(t, ext, ["code"])))] == []


PARTS = {
    "py": ['"', "'", '"""', "'''", "\\\n", "\n", "(", ")", "[", "]", "{", "}", "# ", "x ", 'f"{a}" ', "\\", "\r\n"],
    "js": ['"', "'", "`", "${", "{", "}", "(", ")", "\\\n", "\n", "\n", "/*", "*/", "//", "a ", "\\", "\\\r\n", '= /[/]"/;\n'],
    "go": ['"', "'", "`", "/*", "*/", "//", "\n", "\n", "(", ")", "{", "}", "a ", "\\"],
    "rs": ['"', "'a'", "/*", "*/", "//", "\n", "\n", 'r#"', '"#', 'r"', "{", "}", "(", ")", "a ", "\\", "\\\n"],
    "java": ['"', "'", '"""', "/*", "*/", "//", "\n", "\n", "{", "}", "a ", "\\"],
    "json": ['"', "{", "}", "[", "]", "\n", ",", "\\"],
    "toml": ['"', "'", '"""', "'''", "#", "\n", "\n", "[", "]", "a ", "\\"],
}


@pytest.mark.parametrize("ext", sorted(chunks.SPECS))
def test_chunk_summaries_combine_to_the_whole(ext):
    """Cuts behind any lines, reduced in any grouping, and the cuts of pieces() with their fewer start states."""
    r = random.Random(ext)
    texts = GOOD[ext] + BAD[ext] + ["".join(r.choice(PARTS[ext if ext != "ts" else "js"]) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for text in texts:
        want = chunks.fault(chunks.summary(text, ext, ["code"]))
        ends = [k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text) and r.random() < 0.6]
        parts = [chunks.summary(text[i:j], ext) for i, j in zip([0, *ends], [*ends, len(text)], strict=True)]
        left = chunks.fold(parts)
        while len(parts) > 1:
            k = r.randrange(len(parts) - 1)
            parts[k : k + 2] = [chunks.combine(parts[k], parts[k + 1])]
        got = [chunks.fault(x) for x in (left, parts[0], chunks.whole(text, ext, r.randint(1, 30)))]
        assert [g is None for g in got] == [want is None] * 3, text


DEEP = 20_000


@pytest.mark.parametrize(
    ("ext", "text", "valid"),
    [
        ("json", "[" * DEEP + "1" + "]" * DEEP, True),
        ("json", "[" * DEEP + "1," + "]" * DEEP, False),
        ("js", "(" * DEEP + "1 1" + ")" * DEEP + ";", False),
        ("js", "(" * DEEP + "1" + ")" * DEEP + ";", True),
        ("ts", "if (a) ; else " * DEEP + ";", True),
        ("go", "package a\nvar x = " + "(" * DEEP + "1 1" + ")" * DEEP + "\n", False),
        ("rs", "fn f() { let x = " + "(" * DEEP + "1" + ")" * DEEP + "; }", True),
        ("java", "class A { int x = " + "(" * DEEP + "1 1" + ")" * DEEP + "; }", False),
        ("toml", "a = " + "[" * DEEP + "1 1" + "]" * DEEP, False),
        ("yaml", "a: " + "[" * DEEP + "]" * DEEP, True),
        ("py", "x = " + "+".join(["1"] * DEEP), True),
        ("py", "x = " + "+".join(["1"] * DEEP) + "\ny = 1 1", False),
        ("py", "x = " + "(" * DEEP + "1" + ")" * DEEP, False),
    ],
)
def test_deep_texts_are_read(ext, text, valid):
    assert (judged("r/a." + ext, ext, text)[3] is None) == valid


def test_remembered_shapes_do_not_hide_faults():
    for good, bad in (("while (a >= b) { a -= 1; }", "while (a = > b) { a -= 1; }"), ("x = [1, 2, 3];", "x = [1, 2, 3"), ("f(a => 1);", "f(a = > 1);"), ("return_ = 1;", "return = 1;")):
        assert grammar.parse(good * 3, "js") is None and grammar.parse(bad, "js") and grammar.parse(good + bad, "js")
    for text in ("let a = 1, 2;", "f((a = 1, 2) => a);", "x = {a: 1, 2: };", "enum E { A = 1, 2 }", "let x = [1, 2, , 3 4];"):
        assert grammar.parse(text, "ts")


def test_large_files_go_through_chunks(spark):
    rows = [("r/a.py", "x = (\n" + "1,\n" * 200 + ")\n"), ("r/b.py", "x = (\n" + "1,\n" * 200), ("r/c.js", "/*\n" + "(\n" * 100 + "*/ let a = 1;\n"), ("r/d.js", "let a = 1;\n" * 50 + "let = ;\n"), ("r/e.txt", "((("), ("r/f.py", None), (None, "x")]
    got = {x["path"]: x["reason"] is None for x in verdicts(spark.createDataFrame(rows, "path string, text string"), 64, 100).collect()}
    assert got == {"r/a.py": True, "r/b.py": False, "r/c.js": True, "r/d.js": False}


def test_texts_of_one_large_path_are_judged_each(spark):
    good, bad = "x = (\n" + "1,\n" * 900 + ")\n", "y = [\n" + "2,\n" * 900
    rows = [("r/a.py", good), ("r/a.py", bad), ("r/a.py", good + "z = 1\n"), ("r/a.py", good)]
    got = verdicts(spark.createDataFrame(rows, "path string, text string"), 64, 100).collect()
    assert sorted(x["reason"] is None for x in got) == [False, True, True, True]


CONTINUED = {
    "py": ["x = 'a" + "\\\n" * 60 + "b'\ny = \"" + "c \\\n" * 40 + "\"\n", "x = 'a\\\r\nb'\n" + "y = 1\n" * 20, "# c\\\\\\\n" * 20 + "x = (\n"],
    "js": ["let a = 'x" + "\\\n" * 60 + "y';\n", "let a = 1;\n/[\"(]/.test(a);\n" * 20, "let a = `x${[1].map(\n(b) => `${b}\n`\n).join(`\n`)\n}`;\n" * 8, "let a = `x${\n{b: `}`}.b\n}`;\n" * 8],
    "ts": ["let a: string = 'x" + "\\\n" * 60 + "y';\n"],
}


def test_verdicts_do_not_depend_on_the_chunk_size(spark):
    texts = [(ext, t) for some in (GOOD, BAD, CONTINUED) for ext in some for t in some[ext]]
    texts += [(ext, "\n" * 70 + t) for ext, t in texts]
    df = spark.createDataFrame([(f"r/f{k}.{ext}", t) for k, (ext, t) in enumerate(texts)], "path string, text string")
    small, large = ({x["path"]: x["reason"] is None for x in verdicts(df, c, c).collect()} for c in (64, 1 << 20))
    assert small == large and len(small) == len(texts)
    want = [t for ext, some in CONTINUED.items() for t in some if not grammar.parse(t, ext)]
    assert len(want) == 7 and all(small[f"r/f{k}.{ext}"] for k, (ext, t) in enumerate(texts) if t in want)


REGEXES = ["function f(s) { return /[\"']/.test(s); }\n", "const f = s => /[(]/.test(s);\n", "const t = typeof /[{]/;\n", "switch (x) { case /['`]/: break }\n", "const u = 'a' + /[\"]/.source;\n"]


@pytest.mark.parametrize("text", REGEXES)
def test_regexes_behind_words_and_operators(text):
    assert chunks.fault(chunks.summary(text, "js", ["code"])) is None
    assert [judged("r/a." + ext, ext, text)[3] for ext in ("js", "ts")] == [None, None]
    assert judged("r/a.js", "js", text + "f(")[3]


def test_summary_faults_need_the_grammar():
    valid = "let a = `x${[1].map((b) => `${`${b}(`}`)}`;\n"
    assert judged("r/a.js", "js", valid)[3] is None and judged("r/a.py", "py", 'x = f"{a["("]}"\n')[3] is None
