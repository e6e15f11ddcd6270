"""Parsed symbols and references of source texts.

Python is parsed with the standard library's grammar, seventeen other language ids by the token grammars of
``outline``. The extractor of a language id is looked up by extension, so another one can be put in its place.
A Python text that does not parse goes through line patterns; its rows carry the source ``line_rules`` and are
never promoted to parsed ones. Columns are 1-based byte offsets, texts the trimmed line cut at 120.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.outline import LANGUAGES, REFERENCE_KINDS, REFERENCE_TARGETS, outline

SCHEMA = "path string, line int, col int, lang string, kind string, name string, text string, source string, is_ref boolean"

PARSED, GUESSED = "tree_sitter", "line_rules"
"""Sources of rows of a parser (the label snapshots use for it) and of line patterns."""
PY_FALLBACK = [("class", re.compile(r"^\s*class\s+([A-Za-z_]\w*)")), ("function", re.compile(r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)")), ("import", re.compile(r"^\s*from\s+([\w.]+)\s+import\b")), ("import", re.compile(r"^\s*import\s+([\w.]+)"))]
"""Patterns of definitions in Python texts that do not parse; the first that matches a line gives its record."""
QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#.*$")

Row = tuple[int, int, str, str, bool]
"""line, byte column, kind, name, is a reference."""


def by_lines(text: str) -> list[Row]:
    out: list[Row] = []
    for n, line in enumerate((ln.rstrip("\r") for ln in text.split("\n")), 1):
        code = QUOTED.sub(lambda m: " " * len(m.group()), line)
        for kind, rx in PY_FALLBACK:
            m = rx.match(code)
            if m:
                out.append((n, len(line[: m.start(1)].encode("utf-8")) + 1, kind, m.group(1), False))
                break
    return out


def by_python(text: str) -> list[Row]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    raw = [ln.encode("utf-8") for ln in text.split("\n")]
    out: list[Row] = []

    def name_at(node: ast.AST, name: str, word: bytes) -> tuple[int, int]:
        line = node.lineno
        at = raw[line - 1].find(name.encode(), raw[line - 1].find(word, node.col_offset) + len(word))
        return line, at + 1

    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            out.append((*name_at(node, node.name, b"class"), "class", node.name, False))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((*name_at(node, node.name, b"def"), "function", node.name, False))
        elif isinstance(node, ast.Import):
            out += [(a.lineno, a.col_offset + 1, "import", a.name, False) for a in node.names if a.asname is None]
        elif isinstance(node, ast.ImportFrom):
            at = raw[node.lineno - 1].find((node.module or "").encode(), node.col_offset + 4)
            if not node.level and at >= 0:
                out.append((node.lineno, at + 1, "import", node.module, False))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            out += [(t.lineno, t.col_offset + 1, "variable", t.id, False) for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)]
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.append((f.lineno, f.col_offset + 1, "call", f.id, True))
            elif isinstance(f, ast.Attribute):
                out.append((f.end_lineno, f.end_col_offset - len(f.attr.encode()) + 1, "call", f.attr, True))
    return out


def python(text: str) -> list[Row]:
    return by_python(text)


def outlined(lang: str) -> Callable[[str], list[Row]]:
    def run(text: str) -> list[Row]:
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        out, plain = [], text.isascii()
        for at, kind, name, ref in outline(text, lang):
            line = bisect_right(starts, at)
            own = starts[line - 1]
            out.append((line, (at - own if plain else len(text[own:at].encode("utf-8"))) + 1, kind, name, ref))
        return out

    return run


EXTRACTORS: dict[str, Callable[[str], list[Row]]] = {"py": python} | {e: outlined(lang) for e, lang in LANGUAGES.items() if e != "py"}
LANG_IDS = dict(LANGUAGES)
"""Language id of records by extension."""


def parsed(files: DataFrame) -> DataFrame:
    """Records and references of ``files(path, text)``; SCHEMA. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ext = path.rpartition("/")[2].rpartition(".")[2].lower() if path and "." in path else ""
                make, source = EXTRACTORS.get(ext), PARSED
                if not text or make is None:
                    continue
                try:
                    found = make(text)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    found, source = (by_lines(text) if ext == "py" else []), GUESSED
                lines = text.split("\n")
                for line, col, kind, name, ref in sorted(set(found)):
                    shown = lines[line - 1].strip() if line <= len(lines) else ""
                    rows.append((path, line, col, LANG_IDS.get(ext, ext), kind, name, shown if len(shown) <= 120 else shown[:119] + "…", source, ref))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "line", "col", "lang", "kind", "name", "text", "source", "is_ref"])

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def symbols(files: DataFrame) -> DataFrame:
    return parsed(files).filter(~F.col("is_ref")).drop("is_ref")


def syntax_refs(files: DataFrame) -> DataFrame:
    """Calls and exports of parsed texts, with the kind of what they point at."""
    from waymark.operators.extract import as_refs

    r = parsed(files).filter("is_ref").select("path", F.col("line").alias("line_no"), "col", F.trim(F.translate("name", "\"'`", "")).alias("name"), "text", "kind")
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("kind")]
    return as_refs(r, F.coalesce(pairs(REFERENCE_KINDS), F.col("kind")), pairs(REFERENCE_TARGETS), F.col("text"), PARSED)
