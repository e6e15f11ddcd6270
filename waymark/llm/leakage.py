"""Evaluation texts inside a corpus, by template canonicalisation.

Words are runs of letters and digits after decoding HTML entities, dropping tags, lower-casing and removing
accents. Each word becomes a template token: numbers, names and units give way to typed placeholders, other
words stay. Every run of WINDOW template tokens of a document is hashed and joined by hash with the windows
of the evaluation items. What stands behind the placeholders, the slots, then decides on the pair:

* slots with equal words: the document repeats the item word for word (``verbatim``);
* slots that rename consistently (equal slots stay equal, different ones stay different): the document repeats
  a re-parameterised form of the item (``template_matches``); both windows then number their slots alike.

Names are words the evaluation items write with a capital inside a sentence. The verbatim join uses only this
lexicon, so a document in capitals or without accents gets the same template as the item; the template join
also takes capitalised words inside a sentence of the document for names.

The documents are read once, whatever the number of items. The lexicon and the items' window hashes go to the
executors as bit filters of at most MAX_BITS bits each (16 MB): a word that the first takes for a name by
chance is one on both sides, and the slots decide; a window that the second lets pass by chance finds nothing
in the join. Items that share a window form a class (a fingerprint of the set), so the join has one row per
window, and only the documents' classes are spread to items.

Defined results: null, empty or short texts have no windows; repeated documents are reported each; items that
share a passage are all reported; a text with fewer than WINDOW words leaks nothing; empty tables give no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 12
MAX_BITS = 1 << 27

UNITS = frozenset(
    "mm cm m km g kg mg t l ml s min h kb mb gb inch inches foot feet yard yards mile miles metre metres meter meters"
    " kilometre kilometres kilometer kilometers gram grams kilogram kilograms litre litres liter liters second seconds"
    " minute minutes hour hours day days week weeks month months year years winter winters coin coins euro euros dollar"
    " dollars pound pounds percent jahre jahren tage tagen wochen monate monaten stunden minuten sekunden meter taler"
    " jours semaines mois annees ans heures minutes secondes hivers pieces metres dias semanas meses anos horas minutos"
    " segundos inviernos monedas metros".split()
)
"""Unit words after normalisation (fixed values)."""

TAG = re.compile(r"<[^<>]*>")
WORD = re.compile(r"[^\W_]+")
END = re.compile(r"[.!?:\n。！？]")


def strip_accents(text: str) -> str:
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def visible(text: str) -> str:
    """Entities decoded, tags dropped."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    return text


def norm_words(text: str | None) -> list[str]:
    return WORD.findall(strip_accents(visible(text).lower())) if text else []


def cased_words(text: str | None) -> list[tuple[str, bool]]:
    """(normalised word, written with a capital inside a sentence)."""
    if not text:
        return []
    out, raw, last = [], strip_accents(visible(text)), 0
    first = True
    for m in WORD.finditer(raw):
        first = first or END.search(raw, last, m.start()) is not None
        w = m.group()
        out.extend((x, not first and w[0].isupper() and w[1:].islower()) for x in WORD.findall(strip_accents(w.lower())))
        first, last = False, m.end()
    return out


class Bits:
    """A bit filter of hashes: two bits each."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64, copy=False)
        return h & np.uint64(size - 1), (h >> np.uint64(29)) * np.uint64(0x9E3779B1) >> np.uint64(5) & np.uint64(size - 1)

    def one(self, h: int) -> bool:
        last = len(self.words) * 64 - 1
        b = (((h >> 29) * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF) >> 5) & last
        return all(int(self.words[k >> 6]) >> (k & 63) & 1 for k in (h & last, b))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes, len(self.words) * 64)
        six, low = np.uint64(6), np.uint64(63)
        return ((self.words[a >> six] >> (a & low)) & (self.words[b >> six] >> (b & low)) & np.uint64(1)).astype(bool)


def collected(df: DataFrame, size: int, hashes) -> Bits:  # noqa: ANN001
    """The filter of all hashes that ``hashes`` (batch of pandas rows -> array) gives: set words are merged per task, then by bit_or."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros(size // 64, np.uint64)
        for b in batches:
            for p in Bits.places(hashes(b), size):
                np.bitwise_or.at(words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        on = np.flatnonzero(words)
        yield pd.DataFrame({"at": on.astype(np.int64), "bits": words[on].view(np.int64)})

    rows = df.mapInPandas(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most size / 64 rows
    words = np.zeros(size // 64, np.uint64)
    words[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return Bits(words)


def word_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w)


class Templates:
    """Turns words into template windows."""

    def __init__(self, names: Bits, window: int = WINDOW) -> None:
        self.names, self.window = names, window
        self.tokens: dict[str, tuple[int, str]] = {}
        self.power = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(window)], np.uint64)

    def token(self, word: str, name: bool) -> tuple[int, str]:
        """(hash of the template token, slot type or '')."""
        if name:
            return TYPED["n"], "n"
        got = self.tokens.get(word)
        if got is None:
            h = word_hash(word)
            kind = "d" if word.isdigit() else "u" if word in UNITS else "n" if self.names.one(h) else ""
            if len(self.tokens) > 1 << 18:
                self.tokens.clear()
            got = self.tokens[word] = (TYPED.get(kind, h), kind)
        return got

    def windows(self, words: list[str], flags: list[bool] | None = None) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """Hash of each window's template, and the token of each word."""
        if len(words) < self.window:
            return np.zeros(0, np.int64), []
        toks = [self.token(w, bool(flags and flags[k])) for k, w in enumerate(words)]
        h = np.array([t[0] for t in toks], np.uint64)
        n = len(h) - self.window + 1
        acc = np.zeros(n, np.uint64)
        for j in range(self.window):
            acc += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29))) * self.power[j]
        return acc.view(np.int64), toks

    def row(self, words: list[str], toks: list[tuple[int, str]], at: int, renamed: bool) -> tuple[int, str]:
        """(a second hash of the template, its slots): the words in them, or their numbers by first occurrence."""
        part = list(zip(words[at : at + self.window], toks[at : at + self.window], strict=True))
        second = xxhash.xxh64_intdigest(" ".join(f"<{k}>" if k else w for w, (_, k) in part), 1) - (1 << 63)
        if not renamed:
            return second, " ".join(w for w, (_, k) in part if k)
        seen: dict[str, int] = {}
        return second, ",".join(f"{k}{seen.setdefault(w, len(seen))}" for w, (_, k) in part if k)


TYPED = {k: word_hash("\0" + name) for k, name in (("d", "number"), ("n", "name"), ("u", "unit"))}


def read_words(text: str | None, cased: bool) -> tuple[list[str], list[bool] | None]:
    if not cased:
        return norm_words(text), None
    pairs = cased_words(text)
    return [w for w, _ in pairs], [f for _, f in pairs]


def name_hashes(b: pd.DataFrame) -> np.ndarray:
    return np.array([word_hash(w) for w in {w for t in b["text"] if isinstance(t, str) for w, inner in cased_words(t) if inner and not w.isdigit()}], np.uint64)


def _windows(df: DataFrame, id_col: str, names: Bits, wanted: Bits | None, cased: bool, window: int) -> DataFrame:
    """(id, tmpl, second, slots) of all windows, or of those the filter of wanted templates lets pass."""
    shared = df.sparkSession.sparkContext.broadcast((names, wanted))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T._parse_datatype_string("tmpl long, second long, slots string").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, wanted = shared.value
        make = Templates(names, window)
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b[id_col].tolist(), b["text"].tolist(), strict=True):
                words, flags = read_words(text if isinstance(text, str) else None, cased)
                if len(words) < window:
                    continue
                h, toks = make.windows(words, flags)
                hits = range(len(h)) if wanted is None else np.flatnonzero(wanted.has(h.view(np.uint64))).tolist()
                out.extend((i, int(h[k]), *make.row(words, toks, k, cased)) for k in hits)
            yield pd.DataFrame(out, columns=[id_col, "tmpl", "second", "slots"])

    return df.select(id_col, "text").mapInPandas(run, schema)


def _matches(docs: DataFrame, items: DataFrame, cased: bool, window: int, max_bits: int) -> DataFrame:
    """(doc_id, item_id, windows): pairs sharing windows of equal template and slots, and their number."""
    items = items.select("item_id", "text").filter("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0
    size = min(max_bits, 1 << max(10, (8 * chars).bit_length()))
    names = collected(items, size, name_hashes)
    shared = items.sparkSession.sparkContext.broadcast(names)

    def window_hashes(b: pd.DataFrame) -> np.ndarray:
        make = Templates(shared.value, window)
        return np.concatenate([np.zeros(0, np.uint64), *(make.windows(*read_words(t, cased))[0].view(np.uint64) for t in b["text"])])

    wanted = collected(items, size, window_hashes)
    key = ["tmpl", "second", "slots"]
    ours = _windows(items, "item_id", names, None, cased, window).distinct()
    salted = F.xxhash64("item_id", F.lit("again"))
    classes = ours.groupBy(*key).agg(F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("item_id")), F.bit_xor(salted)).alias("class"))
    members = ours.join(classes, key).select("class", "item_id").distinct()
    theirs = _windows(docs, "doc_id", names, wanted, cased, window).distinct()
    found = theirs.join(classes, key).groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"))
    return found.join(members, "class").groupBy("doc_id", "item_id").agg(F.sum("n").alias("windows"))


def verbatim(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, item_id, windows): documents sharing at least ``window`` consecutive words with an item."""
    return _matches(docs, items, False, window, max_bits)


def template_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, item_id, templates): documents with windows that rename a window of the item consistently.

    ``templates`` counts the distinct windows of the item (template and slot pattern) found in the document,
    word-for-word ones included. Items that share a passage are all reported.
    """
    return _matches(docs, items, True, window, max_bits).withColumnRenamed("windows", "templates")
