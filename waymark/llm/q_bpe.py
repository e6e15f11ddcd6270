"""Query: token ids of all documents."""

from __future__ import annotations

from waymark.llm.bpe import encode_texts
from waymark.registry import Registry, table


def register(reg: Registry) -> None:
    @reg.query("p6_ids")
    def p6_ids(spark, d):
        return encode_texts(table(spark, d, "documents"), "doc_id", "text")
