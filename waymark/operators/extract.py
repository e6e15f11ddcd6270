"""Landmarks and references read off the lines of source files, as column expressions.

Every extractor is an expression over one line that yields an array of (col, kind, name); a file's lines are
exploded once and the arrays of all extractors that apply to the file's language are concatenated, so a text
is read once however many landmark kinds it holds. Columns are 1-based byte offsets. Patterns are unrolled
and possessive, so long lines neither backtrack nor recurse deeply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import paths
from waymark.functions.paths import let
from waymark.functions.ranks import STOPLIST
from waymark.functions.text import ascii_lower, compact, lines, truncate, utrim

MARK = "array<struct<col:int,kind:string,name:string>>"
DQ = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"?+'
SQ = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'?+"
IDENT = "[A-Za-z0-9_-]"


BLOCK = 256


def spans(c: Column, pattern: str) -> Column:
    """array<struct<t:string,c:int>>: all matches of a pattern and their byte columns.

    The pieces are bound once and their lengths are summed by blocks, so a line with n matches costs about
    n x BLOCK additions, not n squared.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    raw = F.struct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)).alias("f"), F.transform(F.split(c, pattern, -1), lambda g: F.octet_length(g)).alias("g"))

    def placed(s: Column) -> Column:
        lens = F.zip_with(F.transform(s["f"], lambda t: F.octet_length(t)), F.slice(s["g"], F.lit(1), F.size(s["f"])), lambda a, b: a + b)
        return let(F.struct(s["f"].alias("f"), s["g"].alias("g"), lens.alias("n")), blocked)

    def blocked(s: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(s["f"]) / BLOCK).cast("int")), lambda b: total(F.slice(s["n"], b * BLOCK + 1, F.lit(BLOCK))))
        return let(F.struct(s["f"].alias("f"), s["g"].alias("g"), s["n"].alias("n"), sums.alias("b")), lambda q: F.transform(q["f"], lambda t, k: F.struct(t.alias("t"), start(q, k).alias("c"))))

    def start(q: Column, k: Column) -> Column:
        b = F.floor(k / BLOCK).cast("int")
        return total(F.slice(q["b"], F.lit(1), b)) + total(F.slice(q["n"], b * BLOCK + 1, k - b * BLOCK)) + F.get(q["g"], k) + 1

    return F.when(F.size(raw["f"]) > 0, let(raw, placed)).otherwise(F.array().cast("array<struct<t:string,c:int>>"))


def before_last(t: Column, sub: Column) -> Column:
    """What stands before the last occurrence of ``sub``."""
    return F.substring(t, F.lit(1), F.char_length(t) - F.instr(F.reverse(t), F.reverse(sub)) + 1 - F.char_length(sub))


def mark(col: Column, kind: Column | str, name: Column) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(col.cast("int").alias("col"), k.alias("kind"), name.alias("name"))


def none() -> Column:
    return F.array().cast(MARK)


def maybe(condition: Column, m: Column) -> Column:
    return F.when(condition, F.array(m)).otherwise(none())


def todos(line: Column) -> Column:
    one = lambda w: maybe(line.contains(w), mark(F.octet_length(F.substring_index(line, w, 1)) + 1, w.lower(), F.lit(w)))
    return F.concat(one("TODO"), one("FIXME"))


CSS_TOKEN = r"[.#][A-Za-z_-][A-Za-z0-9_-]*|--[A-Za-z0-9_-]+"


def css(line: Column) -> Column:
    kind = lambda t: F.when(t.startswith("."), "css_class").when(t.startswith("#"), "css_id").otherwise("css_variable")
    tokens = F.transform(spans(line, CSS_TOKEN), lambda m: mark(m["c"], kind(m["t"]), m["t"]))
    before = F.regexp_extract(line, r"^(.*?@keyframes\s*)[A-Za-z0-9_-]", 1)
    name = F.regexp_extract(line, r"^.*?@keyframes\s*([A-Za-z0-9_-]+)", 1)
    return F.concat(tokens, maybe(name != "", mark(F.octet_length(before) + 1, "keyframes", name)))


TAG = r"<(?!/|!--)[^>]*>?"


def classes(value: Column, at: Column, kind: str) -> Column:
    return F.transform(spans(value, r"\S+"), lambda m: mark(at + m["c"] - 1, kind, F.concat(F.lit("."), m["t"])))


def html(line: Column) -> Column:
    """Tags, ids, classes, data-testid and className of the tags that open on the line."""

    def of_tag(m: Column) -> Column:
        attrs = F.regexp_replace(F.substring(m["t"], 2, 1 << 30), ">$", "")
        base = m["c"] + 1  # column of the first byte of attrs
        name = F.regexp_extract(attrs, rf"^({IDENT}+)", 1)
        tag = maybe(name.rlike("^[a-z]"), mark(base, "html_tag", name))

        def valued(attr: str, make: Callable[[Column, Column], Column]) -> Column:
            look = rf"(?<!{IDENT}){attr}(?!{IDENT})(?=([^=]*+=\s*+)(\"[^\"]*+\"|'[^']*+'))"
            at, gap, val = spans(attrs, f"(?:{look})"), F.regexp_extract_all(attrs, F.lit(look), F.lit(1)), F.regexp_extract_all(attrs, F.lit(look), F.lit(2))
            rows = F.transform(at, lambda a, k: make(base + a["c"] - 1 + len(attr) + F.octet_length(F.get(gap, k)) + 1, F.substring(F.get(val, k), F.lit(2), F.char_length(F.get(val, k)) - 2)))
            return F.flatten(rows)

        data = F.transform(spans(attrs, rf"(?<!{IDENT})data-testid(?!{IDENT})"), lambda a: mark(base + a["c"] - 1, "data_attribute", F.lit("data-testid")))
        ids = valued("id", lambda col, v: maybe(v != "", mark(col, "html_id", F.concat(F.lit("#"), v))))
        return F.concat(tag, ids, valued("class", lambda col, v: classes(v, col, "html_class")), valued("className", lambda col, v: classes(v, col, "jsx_class")), data)

    return F.flatten(F.transform(spans(line, TAG), of_tag))


def jsx(line: Column) -> Column:
    return F.transform(spans(line, r"<[A-Z][A-Za-z0-9_-]*"), lambda m: mark(m["c"] + 1, "component_usage", F.substring(m["t"], 2, 1 << 30)))


LINK = r"\[[^\]]*\]\([^)]+\)"


def link_target(t: Column) -> Column:
    return F.regexp_extract(t, r"^\[[^\]]*\]\(([^)]+)\)$", 1)


def markdown(line: Column) -> Column:
    head = F.regexp_extract(line, r"^(\s*#{1,6}\s+)\S", 1)
    title = F.regexp_extract(line, r"^\s*#{1,6}\s+(\S.*?)\s*$", 1)
    box = F.regexp_extract(line, r"^(\s*- \[[ xX]\] )", 1)
    item = utrim(F.regexp_extract(line, r"^\s*- \[[ xX]\] (.*)$", 1))
    links = F.transform(spans(line, LINK), lambda m: mark(m["c"] + F.octet_length(m["t"]) - F.octet_length(link_target(m["t"])) - 1, "link", link_target(m["t"])))
    return F.concat(maybe(title != "", mark(F.octet_length(head) + 1, "section", title)), maybe((box != "") & (item != ""), mark(F.octet_length(box) + 1, "checklist", item)), links)


def config_key(raw: Column) -> Column:
    """Unquoted key of letters, digits and _-.$@: with at least one letter or digit; else null."""
    k = utrim(raw)
    bare = utrim(F.regexp_replace(k, r"""^(?:"(.*)"|'(.*)')$""", "$1$2"))
    return F.when(~k.rlike(r"^[#?]") & bare.rlike(r"^[A-Za-z0-9_\-.$@:]+$") & bare.rlike("[A-Za-z0-9]"), bare)


def json_keys(line: Column) -> Column:
    quoted = spans(line, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?')
    keys = F.filter(quoted, lambda m: m["t"].endswith(":"))
    named = F.transform(keys, lambda m: mark(m["c"] + 1, "key", config_key(F.regexp_extract(m["t"], r'^"(.*)"\s*:$', 1))))
    return F.filter(named, lambda m: m["name"].isNotNull())


def uncommented(line: Column) -> Column:
    """The line up to the first # outside quotes."""
    return F.regexp_extract(line, rf"^((?:[^\"'#\\]++|\\.|\\$|{DQ}|{SQ})*+)", 1)


def before_unquoted(c: Column, sign: str) -> Column:
    """What stands before the first ``sign`` outside quotes; null if there is none."""
    pattern = rf"^((?:[^\"'{sign}\\]++|\\.|{DQ}|{SQ})*+){sign}"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def lead(c: Column) -> Column:
    """Bytes of leading white space."""
    return F.octet_length(F.regexp_extract(c, r"^(\s*)", 1))


def toml(line: Column) -> Column:
    body = uncommented(line)
    t = F.regexp_extract(body, r"^\s*(.*)$", 1)
    inner = F.when(t.startswith("[["), F.regexp_extract(t, r"^\[\[(.*?)\]\]", 1)).when(t.startswith("["), F.regexp_extract(t, r"^\[(.*?)\]", 1))
    table = config_key(inner)
    opener = F.when(t.startswith("[["), 2).otherwise(1)
    before = before_unquoted(body, "=")
    key = config_key(before)
    is_table = t.startswith("[") & table.isNotNull()
    return F.when(is_table, F.array(mark(lead(body) + opener + lead(inner) + 1, "table", table))).otherwise(maybe(key.isNotNull(), mark(lead(before) + 1, "key", key)))


def yaml(line: Column) -> Column:
    body = uncommented(line)
    t = F.regexp_extract(body, r"^\s*(.*)$", 1)
    dash = F.regexp_extract(t, r"^(- \s*)", 1)
    c = F.when(dash != "", F.substring(t, F.char_length(dash) + 1, F.char_length(t))).otherwise(t)
    before = before_unquoted(c, ":")
    key = config_key(before)
    value = utrim(F.substring(c, F.char_length(before) + 2, F.char_length(c)))
    at = lead(body) + F.octet_length(dash) + lead(before) + 1
    return maybe(key.isNotNull() & (c != "") & ~c.isin("---", "..."), mark(at, F.when(value == "", "section").otherwise("key"), key))


def path_lang(path: Column) -> Column:
    """Text behind the last dot of the path, or unknown."""
    return F.when(path.contains("."), F.substring_index(path, ".", -1)).otherwise("unknown")


def line_landmarks(files: DataFrame) -> DataFrame:
    """Records of the line scanners over ``files(path, text)``: TODO, style, markup, document and config landmarks."""
    ln, lang = F.col("line"), F.col("lang")
    found = F.concat(
        todos(ln),
        F.when(lang == "css", css(ln)).when(lang == "html", html(ln)).when(lang == "json", json_keys(ln)).when(lang.isin("tsx", "jsx"), F.concat(html(ln), jsx(ln)))
        .when(lang.isin("md", "markdown"), markdown(ln)).when(lang == "toml", toml(ln)).when(lang.isin("yaml", "yml"), yaml(ln)).otherwise(none()),
    )
    rows = lines(files).withColumn("lang", path_lang(F.col("path"))).select("path", "line_no", "lang", "line", F.explode(found).alias("m"))
    return rows.select("path", F.col("line_no").alias("line"), "m.col", "lang", "m.kind", "m.name", utrim(F.col("line")).alias("text"), F.lit("extras").alias("source"))


def identifier_spans(files: DataFrame) -> DataFrame:
    """(path, line_no, col, name): maximal runs of ASCII letters, digits and _ that start with no digit."""
    s = lines(files).select("path", "line_no", F.explode(spans(F.col("line"), "[A-Za-z0-9_]+")).alias("m"))
    return s.select("path", "line_no", F.col("m.c").alias("col"), F.col("m.t").alias("name")).filter(F.col("name").rlike("^[A-Za-z_]"))


# references
REF_COLUMNS = ("from_path", "from_line", "from_col", "to_name", "to_kind", "ref_kind", "confidence", "reason", "evidence", "source")
DEFAULTS = {"text": ("heuristic", "broad_text_fallback"), "imports": ("syntax", "line_import_syntax"), "extras": ("syntax", "structured_format_reference"), "tree_sitter": ("syntax", "tree_sitter_reference_capture"), "dependency_graph": ("dependency", "dependency_graph_edge")}
"""Confidence and reason of a reference by its source (fixed values)."""


def stoplisted(c: Column) -> Column:
    return ascii_lower(c).isin(*STOPLIST)


def is_name(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$") & ~stoplisted(c)


def as_refs(df: DataFrame, kind: Column, to_kind: Column, evidence: Column, source: str) -> DataFrame:
    """Rows (path, line_no, col, name) as references with the source's confidence; blank and stop-listed names go."""
    confidence, reason = DEFAULTS[source]
    why = F.when(kind == "test_reference", "test_text_reference").otherwise(reason) if source == "text" else F.lit(reason)
    return df.filter((utrim(F.col("name")) != "") & ~stoplisted(F.col("name"))).select(
        F.col("path").alias("from_path"), F.col("line_no").alias("from_line"), F.col("col").alias("from_col"), F.col("name").alias("to_name"), to_kind.alias("to_kind"), kind.alias("ref_kind"),
        F.lit(confidence).alias("confidence"), why.alias("reason"), truncate(compact(evidence)).alias("evidence"), F.lit(source).alias("source"),
    )


def import_names(line: Column, lang: Column) -> Column:
    """(col, kind, name) of the names a line imports, for Python, Rust and JavaScript."""

    def listed(text: Column, base: Column, pick: Callable[[Column], Column]) -> Column:
        parts = F.transform(spans(text, "[^,]+"), lambda m: mark(base + m["c"] + lead(m["t"]), "import", pick(utrim(m["t"]))))
        return F.filter(parts, lambda m: is_name(m["name"]))

    first = lambda t: F.regexp_extract(t, r"^(\S*)", 1)
    dotted = lambda t: F.substring_index(first(t), ".", -1)
    head = F.regexp_extract(line, r"^(\s*from .*? import |\s*import )", 1)
    py = F.when(head != "", listed(F.substring(line, F.char_length(head) + 1, F.char_length(line)), F.octet_length(head), dotted)).otherwise(none())

    mod = F.regexp_extract(line, r"^\s*mod ([A-Za-z0-9_-]+)", 1)
    use = F.regexp_extract(line, r"^\s*use ((?:crate|super)::.*)$", 1)
    body = utrim(F.regexp_replace(use, ";+$", ""))
    at = lead(line) + 4
    inner = F.regexp_extract(body, r"\{([^}]*)", 1)
    before = F.regexp_extract(body, r"^(.*?\{)", 1)
    taken = lambda t: F.regexp_extract(t, rf"^({IDENT}*)", 1)
    leaf = F.substring_index(body, "::", -1)
    rs = (
        F.when(mod != "", F.array(mark(at + 1, "import", mod)))
        .when(body.contains("{"), F.filter(F.transform(spans(inner, "[^,]+"), lambda m: mark(at + F.octet_length(before) + m["c"] + lead(m["t"]), "import", taken(utrim(m["t"])))), lambda m: m["name"] != ""))
        .when(body.contains("::") & is_name(leaf), F.array(mark(at + F.octet_length(body) - F.octet_length(leaf) + 1, "import", leaf)))
        .otherwise(none())
    )

    spec = F.regexp_extract(line, r"^\s*((?:import |export ).*?) from ", 1)
    js_inner = F.regexp_extract(spec, r"\{([^}]*)", 1)
    js_before = F.regexp_extract(spec, r"^(.*?\{)", 1)
    default = utrim(F.substring_index(utrim(F.regexp_replace(spec, "^(?:import|export)+", "")), ",", 1))
    js = (
        F.when(spec == "", none())
        .when(spec.contains("{"), listed(js_inner, lead(line) + F.octet_length(js_before), first))
        .otherwise(maybe(is_name(default), mark(F.octet_length(F.substring(line, F.lit(1), F.instr(line, default) - 1)) + 1, "import", default)))
    )
    return F.when(lang == "py", py).when(lang == "rs", rs).when(lang.isin("ts", "tsx", "js", "jsx"), js).otherwise(none())


def line_imports(files: DataFrame) -> DataFrame:
    rows = lines(files).withColumn("lang", path_lang(F.col("path"))).select("path", "line_no", "line", F.explode(import_names(F.col("line"), F.col("lang"))).alias("m"))
    r = rows.select("path", "line_no", "line", "m.col", "m.name")
    return as_refs(r, F.lit("import"), F.lit(None).cast("string"), F.regexp_replace(utrim(F.col("line")), ";+$", ""), "imports")


def structured_refs(files: DataFrame) -> DataFrame:
    """Markdown links, style usages (classes and variables) and markup usages."""
    ln, lang = F.col("line"), F.col("lang")
    links = F.transform(spans(ln, LINK), lambda m: F.struct((m["c"] + F.octet_length(m["t"]) - F.octet_length(link_target(m["t"])) - 1).cast("int").alias("col"), F.lit("link").alias("kind"), link_target(m["t"]).alias("name"), m["t"].alias("evidence"), F.lit("markdown_link").alias("ref")))
    styled = F.transform(F.filter(spans(ln, r"\.[A-Za-z_-][A-Za-z0-9_-]*|--[A-Za-z0-9_-]+"), lambda m: m["t"] != ""), lambda m: F.struct(m["c"].cast("int").alias("col"), F.when(m["t"].startswith("."), "css_class").otherwise("css_variable").alias("kind"), m["t"].alias("name"), m["t"].alias("evidence"), F.lit("css_usage").alias("ref")))
    used = F.transform(F.filter(html(ln), lambda m: m["kind"] != "html_tag"), lambda m: F.struct(m["col"].alias("col"), F.when(m["kind"].isin("html_class", "jsx_class"), "css_class").otherwise(m["kind"]).alias("kind"), m["name"].alias("name"), m["name"].alias("evidence"), F.lit("html_usage").alias("ref")))
    empty = F.array().cast("array<struct<col:int,kind:string,name:string,evidence:string,ref:string>>")
    found = F.when(lang.isin("md", "markdown"), links).when(lang == "css", styled).when(lang.isin("html", "tsx", "jsx"), used).otherwise(empty)
    r = lines(files).withColumn("lang", path_lang(F.col("path"))).select("path", "line_no", F.explode(found).alias("m")).select("path", "line_no", "m.*")
    return as_refs(r, F.col("ref"), F.col("kind"), F.col("evidence"), "extras")


def reference_targets(records: DataFrame) -> DataFrame:
    """(name, to_kind) that text can refer to: identifiers of three or more characters, not stop-listed; the first record gives the kind."""
    ok = records.filter(F.col("name").rlike(r"^[A-Za-z_][A-Za-z0-9_]{2,}$") & ~stoplisted(F.col("name")))
    return ok.groupBy("name").agg(F.min_by("kind", F.struct("path", "line", "col", "kind")).alias("to_kind"))


def text_references(files: DataFrame, records: DataFrame) -> DataFrame:
    """Identifiers in texts that name a record, except at the record's own place.

    Identifiers are joined with the distinct target names by name; Spark broadcasts the names while their size
    is under its threshold and shuffles both sides otherwise, with skew handling for frequent words. A word
    takes its line's evidence along, not the line: a minified line has a hundred thousand words.
    """
    shown = lines(files).select("path", "line_no", "line", truncate(compact(F.col("line"))).alias("evidence"))
    words = shown.select("path", "line_no", "evidence", F.explode(spans(F.col("line"), "[A-Za-z0-9_]+")).alias("m")).select("path", "line_no", "evidence", F.col("m.c").alias("col"), F.col("m.t").alias("name"))
    words = words.filter(F.col("name").rlike(r"^[A-Za-z_][A-Za-z0-9_]{2,}$"))
    own = records.select("path", F.col("line").alias("line_no"), "col", "name").distinct()
    hit = words.join(reference_targets(records), "name").join(own, ["path", "line_no", "col", "name"], "left_anti")
    kind = F.when(paths.refs_test_path(F.col("path")), "test_reference").otherwise("text_reference")
    return as_refs(hit, kind, F.col("to_kind"), F.col("evidence"), "text")


def enrich(refs: DataFrame, records: DataFrame) -> DataFrame:
    """Imports, exports, calls and type references that name a parsed definition become exact_local."""
    from waymark.functions.ranks import LOCAL_SYMBOL_KINDS

    local = records.filter(F.col("kind").isin(*LOCAL_SYMBOL_KINDS) & (F.col("source") == "tree_sitter")).select(F.col("name").alias("to_name"), F.lit(True).alias("_local")).distinct()
    r = refs.join(local, "to_name", "left")
    exact = F.col("ref_kind").isin("import", "export", "call", "type_reference") & F.coalesce("_local", F.lit(False))
    return r.select(*[F.when(exact, "exact_local").otherwise(F.col(c)).alias(c) if c == "confidence" else F.when(exact, "local_symbol_match").otherwise(F.col(c)).alias(c) if c == "reason" else F.col(c) for c in REF_COLUMNS])


def refs_from_dependencies(deps: DataFrame, records: DataFrame) -> DataFrame:
    """Module references of dependency edges: to the resolved file, or to the unresolved module."""
    from waymark.functions.ranks import LOCAL_SYMBOL_KINDS

    known = records.filter(F.col("kind").isin(*LOCAL_SYMBOL_KINDS) & (F.col("source") == "tree_sitter")).select(F.col("path").alias("target_path"), F.lit(True).alias("_known")).distinct()
    d = deps.join(known, "target_path", "left")
    to = F.col("target_path").isNotNull()
    reason = F.when(to & F.col("_known"), "dependency_graph_resolved_file").when(to, "dependency_graph_resolved_path").otherwise(F.coalesce("unresolved_reason", F.lit("dependency_unresolved")))
    return d.select(
        "from_path", "from_line", "from_col", F.coalesce("target_path", "import_path").alias("to_name"), F.when(to, "file").otherwise("module").alias("to_kind"), F.lit("module_dependency").alias("ref_kind"),
        F.when(to, "dependency").otherwise("unresolved").alias("confidence"), reason.alias("reason"), truncate(compact(F.col("evidence"))).alias("evidence"), F.lit("dependency_graph").alias("source"),
    )


def scan_file_references(files: DataFrame) -> DataFrame:
    """File reference candidates of JavaScript, Python, Markdown, HTML, CSS and config texts, not yet resolved."""
    from waymark.operators import file_refs as R

    src = F.col("path")
    rows = lines(files).withColumn("lang", R.scan_lang(src))
    ln = F.col("line")
    t = "array<struct<raw:string,col:int,kind:string>>"

    def grouped(pattern: str, group: int, kind: Callable[[Column, Column], Column], keep: Callable[[Column], Column]) -> Column:
        """Captured targets; the match must end right behind the target's closing part, so its column follows."""
        full = spans(ln, pattern)
        raws = F.regexp_extract_all(ln, F.lit(f"({pattern})"), F.lit(group + 1))
        out = F.transform(full, lambda m, k: F.struct(utrim(F.get(raws, k)).alias("raw"), (m["c"] + F.octet_length(before_last(m["t"], F.get(raws, k)))).cast("int").alias("col"), kind(m["t"], utrim(F.get(raws, k))).alias("kind")))
        return F.filter(out, lambda m: keep(m["raw"]))

    local = lambda r: (r.startswith("./") | r.startswith("../") | r.startswith("/")) & ~R.is_template(r)
    const = lambda k: lambda _m, _r: F.lit(k)
    js = F.concat(
        grouped(r"""\bimport\s+(?:[^"'`;\n]*?\s+from\s*)?["'`]([^"'`]+)["'`]""", 1, const("import"), local),
        grouped(r"""\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}\n]*\})\s+from\s*["'`]([^"'`]+)["'`]""", 1, const("export"), local),
        grouped(r"""\bimport\s*\(\s*["'`]([^"'`]+)["'`]\s*\)""", 1, const("import"), local),
    )
    mod = F.regexp_extract(ln, r"^\s*from\s+([.]+[A-Za-z_][A-Za-z0-9_.]*)\s+import\s+", 1)
    dots, name = F.regexp_extract(ln, r"^\s*from\s+([.]+)\s+import\s+[A-Za-z_]", 1), F.regexp_extract(ln, r"^\s*from\s+[.]+\s+import\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    module_path = lambda m: F.concat(F.when(F.length(F.regexp_extract(m, r"^(\.*)", 1)) <= 1, F.lit("./")).otherwise(F.repeat(F.lit("../"), F.length(F.regexp_extract(m, r"^(\.*)", 1)) - 1)), F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/")))
    at = lambda w: F.octet_length(F.regexp_extract(ln, w, 1)) + 1
    py = F.when(mod != "", F.array(F.struct(module_path(mod).alias("raw"), at(r"^(\s*from\s+)[.]").cast("int").alias("col"), F.lit("import").alias("kind")))).when(
        name != "", F.array(F.struct(module_path(F.concat(dots, name)).alias("raw"), at(r"^(\s*from\s+[.]+\s+import\s+)[A-Za-z_]").cast("int").alias("col"), F.lit("import").alias("kind")))
    ).otherwise(F.array().cast(t))
    md = grouped(r"!?\[[^\]\n]*\]\(([^)\s]+)(?:\s+[^)]*)?\)", 1, lambda m, r: F.when(m.startswith("!") | R.is_asset(r), "asset").otherwise("link"), R.is_path_like)
    low = ascii_lower(ln)
    attr = lambda m: ascii_lower(F.regexp_extract(m, r"^(\w+)", 1))
    css_like = lambda r: R.ext_low(r).isin("css", "scss", "sass")
    markup = grouped(r"""(?:(?i)(?:href|src|poster|action)\s*=\s*["']([^"']+)["'])""", 1, lambda m, r: F.when((attr(m) == "src") & low.contains("<script"), "script").when((attr(m) == "href") & (low.contains("stylesheet") | css_like(r)), "stylesheet").when(attr(m).isin("src", "poster") | R.is_asset(r), "asset").otherwise("link"), R.is_path_like)
    sets = spans(ln, r"""(?i:srcset)\s*=\s*["'][^"']+["']""")
    inner = lambda m: F.regexp_extract(m["t"], r"""=\s*["']([^"']+)["']""", 1)
    srcset = F.flatten(F.transform(sets, lambda m: F.transform(spans(inner(m), "[^,]+"), lambda p: F.struct(F.regexp_extract(p["t"], r"^\s*(\S*)", 1).alias("raw"), (m["c"] + F.octet_length(before_last(m["t"], inner(m))) + p["c"] - 1 + lead(p["t"])).cast("int").alias("col"), F.lit("asset").alias("kind")))))
    markup = F.concat(markup, F.filter(srcset, lambda m: R.is_path_like(m["raw"])))
    styles = F.concat(grouped(r"""@import\s+(?:url\(\s*)?["']?([^"')\s;]+)""", 1, const("stylesheet"), R.is_path_like), grouped(r"""url\(\s*["']?([^"')]+)["']?\s*\)""", 1, const("asset"), R.is_path_like))
    project = grouped(r"""(?i:\b(?:include|update|remove|project|hintpath))\s*=\s*["']([^"']+)["']""", 1, lambda _m, r: R.config_kind(F.lit("project.csproj"), r), R.is_path_like)
    words = "path file files dir dirs main module types typings bin browser style styles script scripts source sources include includes exclude extends schema template templates fixture fixtures config entry entrypoint root rootdir outdir workflow workflows"
    keyed = rf"""^(.*?["']?[A-Za-z0-9_.-]*?(?i:{'|'.join(words.split())})["']?\s*[:=]\s*)(.+)"""
    head, values = F.regexp_extract(ln, keyed, 1), F.regexp_extract(ln, keyed, 2)
    quoted = F.transform(spans(values, """"[^"]+"|'[^']+'"""), lambda m: F.struct(utrim(F.substring(m["t"], F.lit(2), F.char_length(m["t"]) - 2)).alias("raw"), (F.octet_length(head) + m["c"] + 1).cast("int").alias("col"), R.config_kind(src, utrim(F.substring(m["t"], F.lit(2), F.char_length(m["t"]) - 2))).alias("kind")))
    conf = F.filter(quoted, lambda m: R.is_path_like(m["raw"]))
    lang = F.col("lang")
    found = (
        F.when(lang.isin("js", "jsx", "ts", "tsx", "mjs", "cjs"), js).when(lang == "py", py).when(lang == "md", md).when(lang == "html", markup).when(lang.isin("css", "scss", "sass"), styles)
        .when(lang.isin("json", "toml", "yaml", "yml"), conf).when(R.is_project_file(src), project).when(R.is_build_file(src), conf).otherwise(F.array().cast(t))
    )
    r = rows.select("path", "line_no", "line", F.explode(found).alias("m"))
    return r.filter(~R.is_external(F.col("m.raw"))).select(F.col("path").alias("source_path"), F.col("line_no").alias("source_line"), F.col("m.col").alias("source_col"), F.col("m.raw").alias("raw_target"), F.col("m.kind").alias("reference_kind"), utrim(F.col("line")).alias("evidence"))
