"""Generated, minified, copied and bulk-data files, by a multi-pattern automaton over comments and path rules.

Evidence in the text goes before the path. One automaton of notices (generated, third party, hand-written) in
several languages reads every comment line of a file's header, however long, in block comments and docstrings
too and at any indentation; firm notices also count in comment lines that stand alone at the margin behind it. A
notice inside a string literal is code, not a notice. Text statistics tell minified code, tables of literals and runs of numbered stubs. Only where the
text shows nothing, or there is none, rules on directories, lock files and suffixes decide.

Defined results: a path without text, or with a null or empty one, is judged by its path; a null path is no
file; rescanned paths count once; whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTICES = {
    "generated": (
        "code generated by", "automatically created", "automatically generated", "automatically produced", "autogenerated", "auto-generated", "auto generated", "@generated",
        "changes will be lost", "changes will be overwritten", "edits will be lost", "edits will be overwritten", "file will be overwritten", "buffer-read-only: t", "machine written on",
        "edit the schema instead", "not be edited by hand", "not be edited manually", "never edited by hand", "not be written by hand", "never written by hand",
        "this file is generated", "this file was generated", "file is machine generated", "file is machine-generated",
        "nicht von hand aendern", "nicht von hand andern", "automatisch erzeugt", "automatisch generiert", "fichier genere", "genere automatiquement",
        "generado automaticamente", "generato automaticamente", "gerado automaticamente", "automatisch gegenereerd", "automatiskt genererad",
        "файл сгенерирован", "файл згенеровано", "plik wygenerowano", "自動生成",
    ),
    "edit": (
        "do not edit", "do not modify", "don't edit", "nicht bearbeiten", "ne pas modifier", "no editar", "non modificare", "nao editar", "niet bewerken", "nie edytowac", "не редактировать",
    ),
    "generated?": (
        "generated by ", "generated from ", "was produced by", "machine generated", "machine-generated", "machine made",
        "genere par", "generado por", "generato da", "wygenerowano", "сгенерирован", "згенеровано",
    ),
    "third party": (
        "copied unchanged", "vendored from", "local patches are not allowed", "distribution at tag", "imported from upstream", "taken unchanged from",
        "third-party library", "third party library", "bundled copy of", "unmodified copy", "mirror of the upstream", "upstream copy",
    ),
    "third party?": ("copied from", "taken unchanged", "see upstream"),
    "hand": (
        "edited by hand", "written by hand", "hand-written", "handwritten", "hand written", "von hand geschrieben", "not generated", "not autogenerated", "not auto-generated",
        "no longer generated", "hand-maintained", "maintained manually",
    ),
    "hand?": ("maintained by", "our own", "written by the", "please send patches", "before changing", "reworked the"),
}
"""Notices, lower case and without accents (fixed values). Of matches that overlap the longest counts.

``edit`` stands for a generated file only at the end of a clause or before "by hand" and the like. A kind with a
question mark counts in the header only: generated and third party where the comment, or its sentence about this
file, begins with it, hand where nothing else in the text says otherwise.
"""
CLAUSE_END = re.compile(r"\s*(?:$|[.!,;:)\-\u2013\u2014*]|(?:it|this|this file|the file|by hand|manually|directly|me|dieses? datei)\b)")
SUBJECT = re.compile(
    r"(?:^|[.;:!]\s)\W*(?:(?:this|the)?\s*(?:file|code|module|source|script|table|content|header|copy)s?\s*(?:(?:is|was|are|were|has been|have been)\s*)?)?"
    r"(?:(?:diese datei (?:wurde|ist)|ce fichier (?:est|a ete)|este archivo (?:fue|es)|questo file (?:e|e stato)|этот файл|цей файл|ten plik)\s*)?$"
)
TOOL = re.compile(r"\b(?:compiler|generator|codegen|tool|script|preprocessor)\b")

COMMENT = re.compile(r"^(?://+!?|#+!?|/\*+!?|\*+|--|<!--|;+|%+|rem\b)\s?(.*)$", re.IGNORECASE)
COPYRIGHT = re.compile(r"(?:\(c\)|copyright|©)\s+(?:\d{4}\S*\s+)?(?:by\s+)?(?:the\s+)?([\w.\-]+)\s+(project|authors|contributors|team|library|developers)\b(.*)")
OPENERS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))
PREFIXED = re.compile(r"[rbuRBU]{1,2}(?=\"\"\"|''')")
PASSED = re.compile(r"<\?(?:php|xml)\b|<!doctype\b|[\"']use strict[\"'];?$", re.IGNORECASE)
ONE_LINE = re.compile(r"""^[rbuRBU]{0,2}(?:["'])(.*)["']$""")
BANNER = re.compile(r"^\s*/\*!\s*[\w.@/\-]+\s+v?\d+\.\d+")
NUMBER = re.compile(r"\d+")
TABLE = re.compile(
    r"(?P<text>[rbuLf]?(?:\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?))"
    r"|(?P<value>(?<![\w.])(?:[+-]?\.?\d[\w.]*(?:(?<=[eE])[+-]\d+)?|[\da-fA-F]++\b|(?:true|false|null|nil|none|undefined|nan)\b))"
    r"|[^\S\n]+|(?:=>|[,;:()\[\]{}])+",
    re.IGNORECASE,
)
KEY = re.compile(r"\b[^\W\d]\w*+(?=[^\S\n]*+(?::|=>))")
BLANK = re.compile(r"\s")
WORD = re.compile(r"[^\W\d]\w*")
LOCK_TEXT = re.compile(r"\"(?:lockfileVersion|integrity)\"\s*:|^# This file is automatically @generated by|\[\[package\]\]|^(?:content-hash|metadata\.files)", re.MULTILINE)

VENDORED_DIRS = frozenset("vendor vendors vendored node_modules third_party third-party thirdparty 3rdparty external externals bower_components jspm_packages site-packages pods carthage".split())
GENERATED_DIRS = frozenset("gen generated dist build target out __generated__ autogen".split())
LOCK_NAMES = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml cargo.lock poetry.lock pipfile.lock composer.lock gemfile.lock go.sum mix.lock pubspec.lock uv.lock bun.lockb flake.lock".split())
SUFFIXES = (
    (r"[.\-](?:min|bundle|compiled|packed|prod)\.(?:js|css|mjs|cjs)$|[.\-]bundle\.\w+$|\.compiled\.\w+$|\.(?:js|css)\.map$", "minified"),
    (r"\.(?:generated|gen|g|pb|pb\.gw|designer|freezed|autogen)\.\w+$|_pb2(?:_grpc)?\.pyi?$|grpc\.java$|_generated\.\w+$|\.pb\.\w+$", "generated"),
    (r"\.data\.\w+$", "bulk data"),
    (r"[.\-_]lock\.(?:json|ya?ml|toml)$|\.lock$", "lock file"),
)
"""Path rules (fixed values)."""
VERDICTS = ("hand", "third party", "generated", "minified", "bulk data", "lock file")


def fold(s: str) -> str:
    s = s.lower()
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, phrases in NOTICES.items():
        for p in phrases:
            a.add_word(p, (kind, len(p)))
    a.make_automaton()
    return a


def path_reason(path: Column) -> Column:
    """What the path suggests: third party, generated, minified, bulk data, lock file, or null. The repository's name is no evidence."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    dirs = F.split(F.regexp_extract(low, r"^[^/]*/(.*)/[^/]*$", 1), "/")
    among = lambda names: F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in sorted(names)]))
    out = F.when(name.isin(*sorted(LOCK_NAMES)), "lock file").when(among(VENDORED_DIRS), "third party")
    for rx, kind in SUFFIXES:
        out = out.when(name.rlike(rx), kind)
    return out.when(among(GENERATED_DIRS), "generated")


def header(lines: list[str], ext: str) -> tuple[list[str], int]:
    """(comment texts of the leading header, number of its lines), with block comments, docstrings and any indentation."""
    out: list[str] = []
    close = ""
    for k, line in enumerate(lines):
        body = line.lstrip("\ufeff \t\f")
        if not close:
            if not body.strip() or PASSED.match(body.strip()):
                continue
            start = PREFIXED.sub("", body, count=1) if ext in ("py", "pyi") else body
            for o, c in OPENERS:
                if start.startswith(o) and (o[0] not in "\"'" or ext in ("py", "pyi")):
                    close, body = c, start[len(o) :]
                    break
            else:
                m = COMMENT.match(body)
                m = m or (ext in ("py", "pyi") and ONE_LINE.match(body.rstrip()))
                if not m:
                    return out, k
                out.append(m.group(1))
                continue
        text, end, rest = body.partition(close)
        out.append(text.strip(" \t*!#"))
        if end:
            close = ""
            if rest.strip(" \t;") and not COMMENT.match(rest.strip()):
                return out, k + 1
    return out, len(lines)


def said(body: str, repository: str, auto, in_header: bool) -> set[str]:
    """The kinds of notices in a comment line, lower case and without accents."""
    kinds = set()
    for end, (kind, n) in auto.iter_long(body):
        before, behind = body[: end + 1 - n], body[end + 1 :]
        if kind == "edit":
            if CLAUSE_END.match(behind):
                kinds.add("generated")
        elif kind == "hand?":
            if in_header and not (body.startswith("written by the", end + 1 - n) and TOOL.search(behind)):
                kinds.add(kind)
        elif kind[-1] != "?" or (in_header and SUBJECT.search(before)):
            kinds.add(kind)
    c = COPYRIGHT.search(body)
    if c:
        if c.group(1) == repository.lower():
            kinds.add("hand?")
        elif c.group(2) in ("project", "library"):
            kinds.add("third party")
    return kinds


def notice(head: list[str], rest: list[str], repository: str, auto) -> str | None:
    """What the notices say: hand, third party, generated or None.

    Notices count in every comment line of the leading header, firm ones also behind it in stand-alone comments
    at the margin. A line that says the file is written by hand outweighs what the same line says of generated
    files; a notice of generated or copied text in another line outweighs it in turn, and every mere credit.
    """
    seen: set[str] = set()
    margin = [m.group(1) for line in rest if (m := COMMENT.match(line))]
    for k, body in enumerate(map(fold, head + margin)):
        kinds = said(body, repository, auto, k < len(head))
        seen |= {"hand"} if "hand" in kinds else kinds
    for kind, means in (("third party", "third party"), ("generated", "generated"), ("hand", "hand"), ("hand?", "hand"), ("third party?", "third party"), ("generated?", "generated")):
        if kind in seen:
            return means
    return None


def minified(text: str, lines: list[str], ext: str) -> bool:
    if ext not in ("js", "mjs", "cjs", "ts", "css", "html", "json"):
        return False
    dense = [ln for ln in lines if len(ln) >= 400]
    long = sum(map(len, dense))
    if not long or long < 0.5 * len(text):
        return False
    spaces = sum(ln.count(" ") + ln.count("\t") for ln in dense)
    return ext != "json" and spaces < 0.12 * long


def bulk(text: str, keyed: bool = True) -> bool:
    """Nearly all of the text is a table: literals, alone or in bracketed records, with brackets and separators.

    The share counts by characters or by lines, so neither long nor few rows are lost. Strings with blanks count
    where numbers are at least as many, as in records; a list of messages is not data. A bare key counts where it
    recurs, as in records; the keys of one settings object do not.
    """
    if len(text) < 300:
        return False
    rest, own = TABLE.sub(" ", text), len("".join(text.split()))
    lines, least = text.split("\n"), 0.8 * sum(bool(ln.strip()) for ln in text.split("\n"))

    def left(rest: str, keys: list[str]) -> tuple[str, int]:
        counts: dict[str, int] = {}
        for k in keys:
            counts[k] = counts.get(k, 0) + 1
        often = {k for k, n in counts.items() if n >= 5}
        rest = WORD.sub(lambda m: "" if m.group() in often else m.group(), rest) if often else rest
        return rest, len("".join(rest.split()))

    most, code = left(rest, KEY.findall(text) if keyed else [])  # keys in strings too: never more code than below
    if own - code < 0.8 * own and sum(not r.strip() and bool(ln.strip()) for r, ln in zip(most.split("\n"), lines, strict=True)) < least:
        return False
    kinds = [(m.lastgroup, m.group()) for m in TABLE.finditer(text) if m.lastgroup]
    prose = sum(kind == "text" and BLANK.search(v) is not None for kind, v in kinds)
    if prose > sum(kind == "value" for kind, _ in kinds):
        rest = TABLE.sub(lambda m: m.group() if m.lastgroup == "text" and BLANK.search(m.group()) else " ", text)
    rest, code = left(rest, KEY.findall(TABLE.sub(lambda m: " " if m.lastgroup else m.group(), text)) if keyed else [])
    if own - code >= 0.8 * own:
        return bool(kinds) and len(text) - code >= 300
    rows = [ln for r, ln in zip(rest.split("\n"), lines, strict=True) if not r.strip() and any(m.lastgroup for m in TABLE.finditer(ln))]
    return len(rows) >= least and sum(map(len, rows)) >= 300


def stubs(lines: list[str]) -> bool:
    """A run of definitions that differ in their numbers only."""
    own = [NUMBER.sub("0", ln.strip()) for ln in lines if ln.strip() and ln.strip() not in ("{", "}")]
    if len(own) < 20:
        return False
    counts: dict[str, int] = {}
    for s in own:
        counts[s] = counts.get(s, 0) + 1
    twice = sum(n for s, n in counts.items() if n >= 10 and len(s) > 12)
    return twice >= 0.8 * len(own)


def text_reason(path: str, text: str, auto) -> str | None:
    """What the text shows: hand, third party, generated, minified, bulk data, lock file, or None."""
    lines = text.splitlines()
    ext = path.rpartition(".")[2].lower()
    head, n = header(lines, ext)
    noted = notice(head, lines[n:], path.split("/", 1)[0], auto)
    if noted == "hand":
        return noted
    if ext in ("json", "yaml", "yml", "toml", "lock") and LOCK_TEXT.search(text):
        return "lock file"
    if minified(text, lines, ext):
        return "minified"
    if noted:
        return noted
    if ext not in ("json", "yaml", "yml", "toml", "md", "txt", "csv") and bulk(text, ext != "css"):
        return "bulk data"
    if ext not in ("json", "yaml", "yml", "toml", "md", "txt", "csv", "css") and stubs(lines):
        return "generated"
    if any(BANNER.match(ln) for ln in lines[:n]) and ext in ("js", "css", "ts"):
        return "third party"
    return None


def judge_texts(source: DataFrame) -> DataFrame:
    """(path, shown) of every row of ``source(path, text)``: what the text shows, null if nothing. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in batches:
            paths, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            shown = [text_reason(p, t, auto) if p and t else None for p, t in zip(paths, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shown, pa.string())], names=["path", "shown"])

    return source.select("path", "text").mapInArrow(run, "path string, shown string")


def judge_files(files: DataFrame, source: DataFrame) -> DataFrame:
    """(path, shown, suggested, reason): one row per distinct path of ``files``; reason null is hand-written.

    Only paths and verdicts are shuffled, never texts. Of several texts of one path the first verdict in the
    order of VERDICTS counts: a path with a text written by hand is no machine-made file.
    """
    rank = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("shown"))
    shown = judge_texts(source.filter(F.col("path").isNotNull())).groupBy("path").agg(F.min_by("shown", F.when(rank > 0, rank)).alias("shown"))
    both = files.filter(F.col("path").isNotNull()).select("path").distinct().join(shown, "path", "left").withColumn("suggested", path_reason(F.col("path")))
    reason = F.when(F.col("shown") == "hand", F.lit(None)).otherwise(F.coalesce("shown", "suggested"))
    return both.select("path", "shown", "suggested", reason.alias("reason"))
