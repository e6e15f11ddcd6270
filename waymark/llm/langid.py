"""Languages of documents and of their segments, by a bidirectional recurrent network over bytes.

The network reads one sentence at a time and labels every byte position with a distribution over the
languages; a sentence's distribution is the mean of the log-probabilities at its letters, a document's the
mean of its positions' probabilities. Stretches are
neighbouring sentences of one language; a sentence with few letters joins the stretch before it.

The weights (under 100 KB) are trained in numpy on a bounded sample of labelled documents, see
``train_langid``; they are sent to the executors once.

Defined results: null texts and texts without letters have lang null and confidence null and no stretch;
whole texts are read, whatever their length, a sentence without an end in runs of LONGEST bytes whose letters
are pooled; repeated texts get equal rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.bigru import BiGRU

LANGS = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "sv", "ru", "uk", "ja")
WEIGHTS = Path(__file__).with_name("langid.npz")
MIN_SENTENCE_LETTERS = 5
"""Letters below which a sentence is no evidence of its own (ideographs and kana count three)."""
SURE = 0.75
"""Confidence from which a sentence stands for a second language."""
BATCH_POSITIONS = 1 << 17
LONGEST = 4096
"""Bytes of a sentence read at once; the runs of a longer one are pooled."""
REMEMBERED = 1 << 16

ISO_CODES = frozenset(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu"
    " fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn"
    " ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os"
    " pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw"
    " ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
)
"""ISO 639-1 codes (fixed values)."""
LABEL_NAMES = {
    "en": "eng english englisch anglais ingles inglese engels angielski engelska",
    "de": "deu ger german deutsch allemand aleman tedesco alemao duits niemiecki tyska",
    "fr": "fra fre french francais franzosisch frances francese frans francuski franska",
    "es": "spa spanish espanol castellano spanisch espagnol spagnolo espanhol spaans hiszpanski spanska",
    "it": "ita italian italiano italienisch italien italiaans wloski italienska",
    "pt": "por portuguese portugues portugiesisch portugais portoghese portugees portugalski portugisiska",
    "nl": "nld dut dutch nederlands niederlandisch neerlandais holandes olandese hollands niderlandzki nederlandska",
    "pl": "pol polish polski polnisch polonais polaco polacco pools polska",
    "sv": "swe swedish svenska schwedisch suedois sueco svedese zweeds szwedzki",
    "ru": "rus russian russkiy russkij russisch russe ruso russo rosyjski ryska русский",
    "uk": "ukr ukrainian ukrainska ukrainskyi ukrainisch ukrainien ucraniano ucraino oekraiens ukrainski українська украинскии украінська",
    "ja": "jpn japanese nihongo japanisch japonais japones giapponese japans japonski japanska 日本語 日本語",
}
"""Three-letter codes and names by which labels name the languages, without accents (fixed values)."""
_NAMES = {n: code for code, names in LABEL_NAMES.items() for n in names.split()}

TAG = re.compile(r"<[^<>]*>")
BREAK = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])\s*|\n\s*\n|\s//\s|\s\|\s")
CODE = re.compile(r"\w\([^()\s]*\)|[{}=\\]|\w_\w|::|->|;\s*$|^--\s?\S+$")
"""Signs of program code and signatures, which stand for no language (fixed values)."""
LONG_RUN = re.compile(r"(\w)\1{4,}")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")


def label_code(label: str | None) -> str | None:
    """ISO 639-1 code of the language a label names, or None."""
    if label is None:
        return None
    s = "".join(c for c in unicodedata.normalize("NFKD", label.strip().lower()) if not unicodedata.combining(c))
    if not s:
        return None
    if s in _NAMES:
        return _NAMES[s]
    first = re.split(r"[-_.\s/;,(@]", s, maxsplit=1)[0]
    return _NAMES.get(first) or (first if first in ISO_CODES else None)


def sentences(text: str) -> list[str]:
    """Visible sentences of a text: entities decoded, tags taken out."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    text = LONG_RUN.sub(r"\1\1", text)
    return [" ".join(s.split()).lstrip(">/ ") for s in BREAK.split(text) if s and s.strip(">/ \t\r")]


NO_LETTERS = bytes(c for c in range(256) if not chr(c).isalpha() or c >= 128)


def weight(s: str) -> int:
    """Letters, ideographs and kana three times."""
    if s.isascii():
        return len(s.encode().translate(None, NO_LETTERS))
    return sum(3 if c >= "぀" else 1 for c in s if c.isalpha())


def to_bytes(s: str) -> bytes:
    return unicodedata.normalize("NFKC", s).lower().encode("utf-8")


def runs(raw: bytes) -> list[bytes]:
    """A sentence's bytes in runs of at most LONGEST, cut at blanks where there are any."""
    out, at = [], 0
    while len(raw) - at > LONGEST:
        end = raw.rfind(b" ", at + 1, at + LONGEST) + 1 or at + LONGEST
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


LETTER = np.zeros(256, bool)
LETTER[128:] = True
LETTER[97:123] = True


class Labeller:
    """Labels sentences; those met before are remembered in a bounded table."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.net = BiGRU(params)
        self.known: dict[str, tuple[np.ndarray, str, float, int] | None] = {}

    def pooled(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every row: sums of probabilities and of log-probabilities at its letters, and their number.

        Positions live only as long as their batch of at most BATCH_POSITIONS (or one run of LONGEST bytes).
        """
        probs, logs, count = np.zeros((len(rows), len(LANGS))), np.zeros((len(rows), len(LANGS))), np.zeros(len(rows), np.int64)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            end, longest = at, 0
            while end < len(order) and (end == at or max(longest, len(rows[order[end]])) * (end - at + 1) <= BATCH_POSITIONS):
                longest = max(longest, len(rows[order[end]]))
                end += 1
            part = order[at:end]
            at = end
            n = np.array([len(rows[i]) for i in part])
            x = np.zeros((longest, len(part)), np.uint8)
            for b, i in enumerate(part):
                x[: n[b], b] = np.frombuffer(rows[i], np.uint8)
            lp = self.net.log_probs(x, n)
            on = LETTER[x] & (np.arange(longest)[:, None] < n[None, :])
            lp *= on[:, :, None]
            logs[part] = lp.sum(0, dtype=np.float64)
            np.exp(lp, out=lp)
            lp *= on[:, :, None]
            probs[part] = lp.sum(0, dtype=np.float64)
            count[part] = on.sum(0)
        return probs, logs, count

    def learn(self, some: list[str]) -> None:
        """Label sentences not known yet: (summed probabilities, language, confidence, weight), None without letters."""
        rows, owner = [], []
        weights = [weight(s) for s in some]
        for k, s in enumerate(some):
            if weights[k]:
                own = runs(to_bytes(s))
                rows += own
                owner += [k] * len(own)
        probs, logs, count = self.pooled(rows)
        total = np.zeros((len(some), 2 * len(LANGS) + 1))
        np.add.at(total, owner, np.concatenate([probs, logs, count[:, None]], 1))
        for k, s in enumerate(some):
            n = total[k, -1]
            if not n:
                self.known[s] = None
                continue
            mean = total[k, len(LANGS) : -1] / n
            p = np.exp(mean - mean.max())
            p /= p.sum()
            best = int(p.argmax())
            self.known[s] = (total[k, : len(LANGS)], LANGS[best], float(p[best]), 1 if CODE.search(s) else weights[k])

    def documents(self, texts: list[str | None]) -> list[tuple[str | None, float | None, list[tuple[str, str, float, int]]]]:
        """Per text: language, confidence, and sentences as (sentence, language, confidence, weight)."""
        cut = [sentences(t) if t else [] for t in texts]
        wanted = {s for ss in cut for s in ss}
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [s for s in wanted if s not in self.known]
        for k in range(0, len(new), 4096):
            self.learn(new[k : k + 4096])
        met = [[(s, got) for s in ss if (got := self.known[s]) is not None] for ss in cut]
        starts = np.cumsum([0, *map(len, met)])[:-1][[bool(m) for m in met]]
        if not len(starts):
            return [(None, None, [])] * len(texts)
        totals = np.add.reduceat(np.stack([got[0] for m in met for _, got in m]), starts)
        best, every = totals.argmax(1), totals.sum(1)
        own = iter((LANGS[k], float(row[k] / e)) for k, row, e in zip(best, totals, every, strict=True))
        return [(*next(own), [(s, *got[1:]) for s, got in m]) if m else (None, None, []) for m in met]


def whole_sentence_languages(main: str | None, rows: list[tuple[str, str, float, int]]) -> list[str]:
    """The languages in which a text has at least one whole sentence, the main one first."""
    if main is None:
        return []
    sure = {lang for _, lang, p, w in rows if w >= MIN_SENTENCE_LETTERS and p >= SURE}
    return [main, *sorted(sure - {main})]


def stretches(rows: list[tuple[str, str, float, int]]) -> list[tuple[int, str, float, str]]:
    """(position, language, confidence, text) of runs of sentences in one language."""
    out: list[list] = []
    for s, lang, p, w in rows:
        if out and (lang == out[-1][0] or w < MIN_SENTENCE_LETTERS or p < SURE):
            out[-1][1] += p * w if lang == out[-1][0] else 0.0
            out[-1][2] += w
            out[-1][3].append(s)
        else:
            out.append([lang, p * w, w, [s]])
    return [(k, lang, c / w, " ".join(ss)) for k, (lang, c, w, ss) in enumerate(out)]


def load_weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        return {k: f[k] for k in f.files}


def _run(df: DataFrame, columns: list[str], schema: T.StructType, make) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(load_weights())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lab = Labeller(shared.value)
        for b in batches:
            done = lab.documents([t if isinstance(t, str) else None for t in b["text"].tolist()])
            yield pd.DataFrame(make(b, done), columns=schema.names)

    return df.select(*columns).mapInPandas(run, schema)


def label_documents(df: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, languages) of every document; languages are those of whole sentences."""
    schema = T.StructType().add("doc_id", "long").add("lang", "string").add("confidence", "double").add("languages", T.ArrayType(T.StringType()))
    return _run(df, ["doc_id", "text"], schema, lambda b, done: [(i, m, c, whole_sentence_languages(m, rows)) for i, (m, c, rows) in zip(b["doc_id"], done, strict=True)])


def label_segments(df: DataFrame) -> DataFrame:
    """(doc_id, segment, lang, confidence, text): every stretch of a document in one language."""
    schema = T.StructType().add("doc_id", "long").add("segment", "integer").add("lang", "string").add("confidence", "double").add("text", "string")
    return _run(df, ["doc_id", "text"], schema, lambda b, done: [(i, k, lang, c, s) for i, (_, _, rows) in zip(b["doc_id"], done, strict=True) for k, lang, c, s in stretches(rows)])


def wrong_labels(df: DataFrame, least_letters: int = 25) -> DataFrame:
    """(doc_id, lang): documents whose label is missing, wrong or too few for their whole sentences."""
    schema = T.StructType().add("doc_id", "long").add("lang", "string")

    def make(b: pd.DataFrame, done: list) -> list:
        out = []
        for i, label, text, (main, _, rows) in zip(b["doc_id"], b["lang"], b["text"], done, strict=True):
            if main is None or sum(1 for _ in islice(filter(str.isalpha, text), least_letters)) < least_letters:
                continue
            langs = whole_sentence_languages(main, rows)
            if len(langs) > 1 or label_code(label if isinstance(label, str) else None) != main:
                out.extend((i, lang) for lang in langs)
        return out

    return _run(df, ["doc_id", "lang", "text"], schema, make)
