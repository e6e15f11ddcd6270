"""Queries: evaluation passages in documents."""

from __future__ import annotations

from waymark.llm.leakage import template_matches, verbatim
from waymark.registry import Registry, table


def register(reg: Registry) -> None:
    @reg.query("p7_leaks")
    def p7_leaks(spark, d):
        return verbatim(table(spark, d, "documents"), table(spark, d, "eval_items"))

    @reg.query("p7_found")
    def p7_found(spark, d):
        return p7_leaks(spark, d).select("doc_id", "item_id")

    @reg.query("p7_templates")
    def p7_templates(spark, d):
        return template_matches(table(spark, d, "documents"), table(spark, d, "eval_items"))
