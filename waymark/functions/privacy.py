"""Redaction of output text and paths that look sensitive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of output redaction (fixed values).
KEY_VALUE = r"""(?iu)\b((?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|private[_-]?key|secret|token)\s*[:=]\s*)("[^"\s]+"|'[^'\s]+'|[^\s"',;]+)"""
AWS_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
HUB_TOKEN = r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b"
JWT = r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"
KEY_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
MASK = "[REDACTED]"


def redact(c: Column) -> Column:
    """Values of secret-looking keys (the key stays), well-known tokens and key headers become [REDACTED]."""
    c = F.regexp_replace(c, KEY_VALUE, "$1" + MASK.replace("[", r"\[").replace("]", r"\]"))
    for pattern in (AWS_KEY, HUB_TOKEN, JWT, KEY_HEADER):
        c = F.regexp_replace(c, pattern, MASK)
    return c
