"""Credentials embedded in source lines, paths and notes, by a linear-chain CRF over lexical tokens.

A line is first joined where a string literal is broken by ``" + "``, then cut into tokens: words, known token
shapes, spaces and single signs. Every token gets its shape (case and digit pattern, length, entropy, known
prefix, placeholder), its neighbours, the class of the key it is assigned to (password, token, key, address,
checksum, ...) and flags (inside the password of an address, behind a PEM header, line reads the value from
elsewhere). The field labels tokens O, B or I; the Viterbi path's spans, mapped back through the joins, are
exactly the characters that are redacted.

The weights are trained on generated lines, see ``train_credentials``; they are sent to the executors once.

Defined results: null and empty texts hold no credential and stay as they are; whole texts are labelled,
whatever their length; repeated rows are labelled alike.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.crf import B, Crf, O

WEIGHTS = Path(__file__).with_name("credentials.json")
MASK = "[REDACTED]"

KNOWN = r"(?:(?:sk|rk)_(?:live|test)_|gh[pousr]_|npm_|pypi-|AKIA|ASIA|AIza|eyJ)[A-Za-z0-9]{8,}"
TOKEN = re.compile(rf"{KNOWN}|(?<=\s-)p(?=\w*\d)|(?:(?!{KNOWN})\w)+|\s+|[^\w\s]")
JOIN = re.compile(r"[\"']\s*\+\s*[\"']")
USERINFO = re.compile(r"(?:^|[\s/'\"(=_\-])[\w.%+\-]+:([^\s/@'\"<>{}$]{4,})@[\w\-]+(?:\.|$)")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\\n|\\r|\s)*([^\s\"'\\…-]+)")
PUBLIC = re.compile(r"-----BEGIN (?:PUBLIC KEY|CERTIFICATE)-----.*|\bssh-(?:ed25519|rsa|dss)\s+\S+|\becdsa-sha2-\S+\s+\S+|\bsha(?:1|224|256|384|512)[-:]\S+")
ELSEWHERE = re.compile(r"(?i)getenv|environ|process\.env|env!|readsecret|get_secret|vault|prompt|getpass|secret_?manager|keyring\.get|\$\{|\{\{|%\(|\$\(|:\s*see the|is read from|\{token\}")

ELSEWHERE_SIGNS = ("env", "secret", "vault", "prompt", "getpass", "keyring", "${", "{{", "%(", "$(", "see the", "read from", "{token}")
"""What a text must hold, in lower case, for ELSEWHERE to match it (fixed values)."""

PASS_WORDS = frozenset("password passwd passwort passwords pwd pw pass passphrase pgpass senha contrasena contraseña passe kennwort haslo wachtwoord pin".split())
TOKEN_WORDS = frozenset("token jwt bearer auth authorization credential credentials login sig signature cookie session otp".split())
KEY_WORDS = frozenset("key apikey secret accountkey accesskey secretkey privatekey pem hmac signing".split())
ADDRESS_WORDS = frozenset("dsn conn connection uri url upstream mirror endpoint database broker webhook server proxy remote".split())
HASH_WORDS = frozenset("sha sha1 sha256 sha512 md5 checksum etag integrity digest commit build hash fingerprint uuid rev revision version public pub cert certificate jwk resolved crc".split())
META_WORDS = frozenset("separator kind field scope column count limit length max tokens stream policy bindings reader hint page ttl expiry rotation budget type size delimiter label header name prefix suffix index id".split())
"""Parts of key names, by what the key holds (fixed values)."""
CONTEXT = frozenset(
    "basic bearer private public key begin end rsa ec openssh pwd uid user still login lautet passwort zugang mysql curl u p root accountkey accountname"
    " sig team hook access staging line first header authorization matched console ssh ed25519 password token env pem key null none true false"
    " your example redacted changeme replace me todo fill in undefined dump connect filename directory".split()
)
"""Words that are features by themselves (fixed values)."""
PLACEHOLDER = re.compile(r"(?i)^(?:your_\w+|x{4,}|redacted\w*|changeme\w*|change_me|replace_?me|todo|placeholder|dummy|example|user|password|host|db|secret|none|null|undefined|true|false|tbd|fixme)$")
TELLING = PASS_WORDS | TOKEN_WORDS | KEY_WORDS | ADDRESS_WORDS | HASH_WORDS | META_WORDS | frozenset("dejar mot de passe max min num".split())
PUBLIC_SIGNS = ("-----BEGIN", "ssh-", "ecdsa-", "sha")
SUBWORD = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-Z]?[a-zà-ÿ]+|\d+")


def key_class(name: str) -> str:
    words = [w.lower() for w in SUBWORD.findall(name)]
    if not words:
        return "none"
    s = set(words)
    if s & HASH_WORDS:
        return "hash"
    kinds = [(w in PASS_WORDS, w in KEY_WORDS, w in TOKEN_WORDS, w in ADDRESS_WORDS) for w in words]
    if "dejar" in s or {"mot", "de", "passe"} <= s:
        return "pass"
    for k, w in enumerate(words):
        if w in META_WORDS and any(any(x) for x in kinds[:k]) and w not in ("id", "header"):
            return "meta"
        if w in ("max", "min", "num"):
            return "meta"
    for at, kind in ((0, "pass"), (1, "key"), (2, "token"), (3, "address")):
        if any(x[at] for x in kinds):
            return kind
    return "other"


KNOWN_TOKEN = re.compile(KNOWN + "$")
PREFIXES = tuple("sk_ rk_ ghp_ gho_ ghu_ ghs_ ghr_ npm_ pypi- AKIA ASIA AIza eyJ".split())
"""How the known token shapes begin (fixed values)."""
DIGIT = re.compile("[0-9]")
HEX = re.compile("[0-9a-f]+|[0-9A-F]+")


def shape(tok: str) -> str:
    c = tok[0]
    if not (c.isalnum() or c == "_"):
        return "sp" if c.isspace() else "." if len(tok) > 1 else c
    low = tok.lower()
    if low in CONTEXT:
        return "v:" + low
    if PLACEHOLDER.match(tok):
        return "hold"
    if tok.startswith(PREFIXES) and KNOWN_TOKEN.match(tok):
        return "jwt" if tok.startswith("eyJ") else "known"
    n = len(tok)
    if tok.isdigit():
        return "num" if n < 8 else "bignum"
    if tok.isascii():
        up, lo, di, un = tok != low, tok != tok.upper(), DIGIT.search(tok) is not None, "_" in tok
    else:
        up, lo, di, un = (any(f(x) for x in tok) for f in (str.isupper, str.islower, str.isdigit, "_".__eq__))
    if di and n >= 8 and HEX.fullmatch(tok):
        return "hex8" if n < 16 else "hex16" if n < 31 else "hex32"
    size = "S" if n < 8 else "M" if n < 16 else "L" if n < 28 else "X"
    if un:
        return "snake" + ("d" if di else "") + ("m" if up and lo else "")
    if di and up and lo:
        return "mix" + size
    if di and lo:
        return "lowd" + size if low.rstrip("0123456789").isalpha() else "lomix" + size
    if di and up:
        return "updig" + size
    if up and lo:
        turns = sum(a.isupper() != b.isupper() for a, b in zip(tok, tok[1:], strict=False))
        return "Cap" if tok[1:].islower() else "wild" + size if turns >= max(4, n // 3) else "camel"
    return "lower" + ("L" if n >= 12 else "") if lo else "UPPER" + ("L" if n >= 12 else "")


def entropy(tok: str) -> str:
    n = len(tok)
    if n < 6:
        return "e-"
    h = -sum([part(tok.count(ch), n) for ch in dict.fromkeys(tok)])
    return f"e{int(h * 2)}"


@lru_cache(1 << 14)
def part(v: int, n: int) -> float:
    return v / n * math.log2(v / n)


def own_features(tok: str) -> list[str]:
    s = shape(tok)
    return [f"s={s}", f"{entropy(tok)}", f"l={min(len(tok), 40) // 4}", f"s={s}&{entropy(tok)}"]


def context_features(c: tuple) -> list[str]:
    s, key, inner, p1, p2, p3, n1, n2, dist, flag, away = c
    return [
        f"k={key}", f"p1={p1}", f"p2={p2}", f"n1={n1}", f"n2={n2}", f"p1={p1}&p2={p2}", f"p1={p1}&p2={p2}&p3={p3}", f"n1={n1}&n2={n2}",
        f"f={flag}", f"a={away}", f"q={inner}", f"d={dist}", f"s={s}&k={key}", f"s={s}&k={key}&q={inner}", f"s={s}&k={key}&d={dist}", f"s={s}&f={flag}",
        f"s={s}&p1={p1}", f"s={s}&p1={p1}&p2={p2}", f"s={s}&n1={n1}", f"s={s}&a={away}", f"k={key}&a={away}", f"k={key}&p1={p1}", f"k={key}&f={flag}", f"s={s}&p1={p1}&n1={n1}",
        f"k={key}&d={dist}&a={away}",
    ]


def joined(text: str) -> tuple[str, list[int] | None]:
    """The text without the joins inside literals, and the original place of each character left."""
    if "+" not in text or not JOIN.search(text):
        return text, None
    keep, at = [], 0
    for m in JOIN.finditer(text):
        keep.extend(range(at, m.start()))
        at = m.end()
    keep.extend(range(at, len(text)))
    return "".join(text[i] for i in keep), keep


class Lexer:
    """Tokens and their context; shapes and key classes are remembered in bounded tables."""

    def __init__(self) -> None:
        self.shapes: dict[str, str] = {}
        self.keys: dict[str, str] = {}

    def shape(self, tok: str) -> str:
        s = self.shapes.get(tok)
        if s is None:
            if len(self.shapes) > 1 << 16:
                self.shapes.clear()
            s = self.shapes[tok] = shape(tok)
        return s

    def key(self, name: str) -> str:
        k = self.keys.get(name)
        if k is None:
            if len(self.keys) > 1 << 15:
                self.keys.clear()
            k = self.keys[name] = key_class(name)
        return k

    def look(self, text: str) -> tuple[list[str], list[int] | None, list[str] | None, str]:
        """Tokens, their starts and flags (None where no flag is set), and whether the value is read from elsewhere."""
        toks, starts, flags = TOKEN.findall(text), None, None
        for rx, name, group, on in ((USERINFO, "userinfo", 1, "@" in text), (PEM, "pem", 1, "PRIVATE" in text), (PUBLIC, "public", 0, any(s in text for s in PUBLIC_SIGNS))):
            for m in rx.finditer(text) if on else ():
                lo, hi = m.span(group)
                starts = starts or token_starts(toks)
                flags = flags or ["-"] * len(toks)
                for i in range(bisect_left(starts, lo), bisect_left(starts, hi)):
                    flags[i] = name
        low = text.lower()
        maybe = not text.isascii() or any([s in low for s in ELSEWHERE_SIGNS])
        return toks, starts, flags, "y" if maybe and ELSEWHERE.search(text) else "n"

    def context(self, toks: list[str], flags: list[str] | None, away: str) -> list[tuple]:
        n = len(toks)
        flags = flags or ["-"] * n
        shapes = [self.shape(t) for t in toks]
        solid = [i for i in range(n) if shapes[i] != "sp"]
        key, name, dist, quote = "none", "", 9, ""
        ctx: list[tuple | None] = [None] * n
        line = ["^", "^", "^", *(shapes[i] for i in solid), "$", "$"]
        for j, i in enumerate(solid):
            t, s = toks[i], shapes[i]
            p3, p2, p1, _, n1, n2 = line[j : j + 6]
            ctx[i] = (s, key, quote, p1, p2, p3, n1, n2, min(dist, 4), flags[i], away)
            dist += 1
            if t in "\"'`":
                quote = "" if quote == t else t if not quote else quote
                if quote and key == "none":
                    dist = min(dist, 4)
            elif t in "=:" and not (t == ":" and n1 in (":", "/")) and not (t == "=" and n1 == "=" and False):
                if name and (flags[i] == "-" or flags[i] == "userinfo") and (not quote or p1 != quote):
                    k = self.key(name)
                    if t == "=" or k != "other" or key in ("none", "other", "meta") or not quote:
                        key, dist = k, 0
                name = ""
            elif t == ";" or (t == "," and not quote):
                key, name, dist = "none", "", 9
            elif t == "-" and name and i and i + 1 < n and toks[i - 1] not in ("-", " ") and shapes[i + 1] != "sp":
                name += "_"
            elif t[0].isalnum() or t[0] == "_":
                name = name + t if name.endswith("_") and i and toks[i - 1] == "-" else t
        near = "^"
        for i in range(n):
            if ctx[i] is None:
                ctx[i] = ("sp", "none", "", near, "", "", "", "", 0, flags[i], away)
            else:
                near = shapes[i]
        return ctx


def token_starts(toks: list[str]) -> list[int]:
    return [0, *accumulate(map(len, toks))][:-1] if toks else []


class Finder:
    """Labels texts. Texts whose tokens are alike in all that the features see are decoded once.

    A token's kind is its shape, entropy and length class and the telling words of its name, or the sign itself.
    Labels are a function of the kinds in a text, its flags and whether it reads the value from elsewhere; they
    are remembered by that signature in bounded tables.
    """

    def __init__(self, crf: Crf) -> None:
        self.crf, self.lexer = crf, Lexer()
        self.kinds: dict[tuple, int] = {}
        self.kind_of: dict[str, int] = {}
        self.labels: dict[tuple, bytes] = {}
        self.own: dict[int, np.ndarray] = {}
        self.around: dict[tuple, np.ndarray] = {}

    def emission(self, tok: str, ctx: tuple) -> np.ndarray:
        k = self.kind_of[tok]
        a = self.own.get(k)
        if a is None:
            a = self.own[k] = self.crf.score(own_features(tok))
        b = self.around.get(ctx)
        if b is None:
            if len(self.around) > 1 << 17:
                self.around.clear()
            b = self.around[ctx] = self.crf.score(context_features(ctx))
        return a + b

    def kind(self, tok: str) -> int:
        if tok[0].isalnum() or tok[0] == "_":
            words = [w.lower() for w in SUBWORD.findall(tok)]
            seen = (self.lexer.shape(tok), entropy(tok), min(len(tok), 40) // 4, bool(words), tok[-1] == "_", *(w for w in words if w in TELLING))
        else:
            seen = (tok == " ", entropy(tok), min(len(tok), 40) // 4) if tok.isspace() else (tok,)
        k = self.kind_of[tok] = self.kinds.setdefault(seen, len(self.kinds))
        return k

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """Character spans of credentials in each text."""
        if len(self.kinds) > 1 << 16 or len(self.labels) > 1 << 16:
            for table in (self.kinds, self.kind_of, self.labels, self.own):
                table.clear()
        elif len(self.kind_of) > 1 << 17:
            self.kind_of.clear()
        known = self.kind_of
        read: dict[str, tuple] = {}
        new: dict[tuple, list[np.ndarray]] = {}
        for text in texts:
            if not text or text in read:
                continue
            toks, starts, flags, away = self.lexer.look(joined(text)[0])
            key = (away, tuple(flags) if flags else None, tuple([known[t] if t in known else self.kind(t) for t in toks]))
            read[text] = (toks, key)
            if key not in self.labels and key not in new:
                new[key] = np.array([self.emission(t, c) for t, c in zip(toks, self.lexer.context(toks, flags, away), strict=True)])
        decoded = {key: lab.astype(np.int8).tobytes() if lab.any() else b"" for key, lab in zip(new, self.crf.viterbi(list(new.values())), strict=True)}
        done: dict[str, list[tuple[int, int]]] = {}
        for text, (toks, key) in read.items():
            labels = decoded[key] if key in decoded else self.labels[key]
            if labels:
                done[text] = self.found(text, toks, np.frombuffer(labels, np.int8))
        self.labels.update({key: lab for key, lab in decoded.items() if len(key[2]) <= 256})
        return [done.get(t, []) for t in texts]

    def found(self, text: str, toks: list[str], labels: np.ndarray) -> list[tuple[int, int]]:
        starts, keep, spans = token_starts(toks), joined(text)[1], []
        for i in np.flatnonzero(labels != O).tolist():
            lo, hi = starts[i], starts[i] + len(toks[i])
            if labels[i] != B and spans and spans[-1][1] == lo:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        if keep is not None:
            spans = [x for lo, hi in spans for x in broken(keep[lo:hi])]
        return [(lo, hi) for lo, hi in spans]


def broken(places: list[int]) -> list[list[int]]:
    """Runs of consecutive places."""
    runs: list[list[int]] = []
    for p in places:
        if runs and runs[-1][1] == p:
            runs[-1][1] = p + 1
        else:
            runs.append([p, p + 1])
    return runs


def redacted(text: str, spans: list[tuple[int, int]], mask: str = MASK) -> str:
    out, at = [], 0
    for lo, hi in spans:
        out += [text[at:lo], mask]
        at = hi
    return "".join([*out, text[at:]])


def with_spans(df: DataFrame, text_col: str, only_found: bool = False) -> DataFrame:
    """All columns of ``df`` and ``cred_spans`` (array of start, end) and ``cred_redacted``; the text column is kept."""
    crf = Crf.load(WEIGHTS)
    shared = df.sparkSession.sparkContext.broadcast((crf.index, crf.w, crf.trans))
    span = T.ArrayType(T.ArrayType(T.IntegerType()))
    schema = T.StructType([*df.schema.fields, T.StructField("cred_spans", span), T.StructField("cred_redacted", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        finder = Finder(Crf(*shared.value))
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            found = finder.spans(texts)
            clean = pa.array([redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
            spans = pa.array([[list(x) for x in s] for s in found], pa.list_(pa.list_(pa.int32())))
            whole = pa.RecordBatch.from_arrays([*b.columns, spans, clean], names=[*b.schema.names, "cred_spans", "cred_redacted"])
            yield whole.filter(pa.array([bool(s) for s in found])) if only_found else whole

    return df.mapInArrow(run, schema)


def found_places(records: DataFrame, warnings: DataFrame) -> DataFrame:
    """(field, path, line, col): the distinct places that hold a credential."""
    rec = with_spans(records.select("path", "line", "col", "text"), "text", True).select(F.lit("records.text").alias("field"), "path", "line", "col")
    zero = F.lit(0)
    fields = F.explode(F.array(*[F.struct(F.lit(f"sensitive_path_warnings.{c}").alias("field"), F.col(c).alias("text")) for c in ("path", "reason")]))
    warn = with_spans(warnings.select("path", fields.alias("x")).select("path", "x.field", "x.text"), "text", True).select("field", "path", zero.alias("line"), zero.alias("col"))
    return rec.unionByName(warn).distinct()
