"""Source files that do not parse, at any size.

Every text is cut into runs of whole lines of about CHUNK characters; each gets its lexer-state map and bracket
summary, and the summaries are combined to the file's. Those of a text of at most SPREAD characters are
combined where it is read, without a shuffle; the parts of a longer one are spread over the cluster, combined
in blocks of BLOCK neighbours where they are summarised, and the blocks' summaries (a few hundred bytes each)
then per text. The combination is exact, so neither size changes a verdict. The statements between the
summaries' brackets are then parsed by the file's grammar; a fault of the summary is final only where the
grammar agrees, as a map of lexer states knows no nested quotes of f-strings. Kept texts are bounded (files too
large are stored without text), so the statements of one file are parsed in one task.

Defined results: files with a null path or text, and other extensions, are never judged; the extension counts
as written in lower case; an empty Python, JavaScript, TypeScript, Rust, Java, TOML or YAML file is valid, an
empty Go or JSON file is not; repeated paths are judged each, by their own texts, and reported once; a text
nested deeper than 200,000 brackets or so, which no compiler reads, is invalid.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.syntax import chunks, grammar

CHUNK = 1 << 16
SPREAD = 1 << 20
BLOCK = 16
VERDICT = "path string, ext string, line int, reason string"


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def judged(path: str, ext: str, text: str, chunk: int = CHUNK) -> tuple[str, str, int | None, str | None]:
    return confirmed(path, ext, text, chunks.fault(chunks.whole(text, ext, chunk)) if ext in chunks.SPECS else None)


def confirmed(path: str, ext: str, text: str, bad: str | None) -> tuple[str, str, int | None, str | None]:
    """The verdict of the grammar on a text whose summary says ``bad``, which names the reason where both agree."""
    got = grammar.parse(text, ext)
    return (path, ext, got[0], bad or got[1]) if got else (path, ext, None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["path", "ext", "line", "reason"])


def _parse(judge):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gc.disable()  # tokens form no cycles
            try:
                rows = [judge(*row) for row in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            finally:
                gc.enable()
            yield _batch(rows)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of parts, neighbours combined: rows come sorted by text and part."""
    held: tuple | None = None  # (path, id, first part, next part, summary)

    def row(h: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[0]]), pa.array([h[1]]), pa.array([h[2]], pa.int32()), pa.array([json.dumps(h[4])])], names=["path", "id", "k", "summary"])

    for b in batches:
        for path, key, ext, k, part, starts in zip(*[c.to_pylist() for c in b.columns], strict=True):
            own = chunks.summary(part, ext, starts)
            if held and held[:2] == (path, key) and held[3] == k:
                held = (path, key, held[2], k + 1, chunks.combine(held[4], own))
            else:
                if held:
                    yield row(held)
                held = (path, key, k, k + 1, own)
    if held:
        yield row(held)


def verdicts(source: DataFrame, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """(path, ext, line, reason) of every file with text and a judged extension; reason null is valid."""
    own = source.select("path", extension(F.col("path")).alias("ext"), "text").filter(F.col("text").isNotNull() & F.col("ext").isin(*grammar.EXTENSIONS))
    long = (F.length("text") > spread) & F.col("ext").isin(*chunks.SPECS)
    small = own.filter(~long).mapInArrow(_parse(lambda p, e, t: judged(p, e, t, chunk)), VERDICT)
    large = own.filter(long).withColumn("id", F.md5("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, i, e, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                parts = chunks.pieces(t, chunk, e)
                n = len(parts)
                cols = [pa.array([p] * n), pa.array([i] * n), pa.array([e] * n), pa.array(range(n), pa.int32()), pa.array([x for x, _ in parts]), pa.array([s for _, s in parts], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "id", "ext", "k", "part", "starts"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [chunks.fault(chunks.fold([json.loads(m) for m in maps])) for maps in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["path", "id", "fault"])

    parts = large.select("path", "id", "ext", "text").dropDuplicates(["path", "id"]).mapInArrow(cut, "path string, id string, ext string, k int, part string, starts array<string>")
    blocks = parts.repartition("path", "id", F.floor(F.col("k") / BLOCK)).sortWithinPartitions("path", "id", "k").mapInArrow(_blocks, "path string, id string, k int, summary string")
    per_text = blocks.groupBy("path", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "summary"))), lambda x: x["summary"]).alias("maps"))
    lexed = per_text.mapInArrow(reduce, "path string, id string, fault string")
    return small.unionByName(large.join(lexed, ["path", "id"]).select("path", "ext", "text", "fault").mapInArrow(_parse(confirmed), VERDICT))
