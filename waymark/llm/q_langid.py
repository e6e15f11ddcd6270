"""Queries: languages of documents and of their stretches."""

from __future__ import annotations

from waymark.llm.langid import label_documents, label_segments, wrong_labels
from waymark.registry import Registry, table


def register(reg: Registry) -> None:
    @reg.query("p8_documents")
    def p8_documents(spark, d):
        return label_documents(table(spark, d, "documents"))

    @reg.query("p8_segments")
    def p8_segments(spark, d):
        return label_segments(table(spark, d, "documents"))

    @reg.query("p8_found")
    def p8_found(spark, d):
        return wrong_labels(table(spark, d, "documents"))
