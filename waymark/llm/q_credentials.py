"""Queries: credentials in source lines and warnings."""

from __future__ import annotations

from waymark.llm.credentials import found_places, with_spans
from waymark.registry import Registry, table


def register(reg: Registry) -> None:
    @reg.query("p1_found")
    def p1_found(spark, d):
        return found_places(table(spark, d, "records"), table(spark, d, "sensitive_path_warnings"))

    @reg.query("p1_redacted")
    def p1_redacted(spark, d):
        """All records with the credential characters of their text masked."""
        cols = ["path", "line", "col", "lang", "kind", "name"]
        return with_spans(table(spark, d, "records").select(*cols, "text", "source"), "text").selectExpr(*cols, "cred_redacted AS text", "source", "size(cred_spans) AS credentials")

    @reg.query("p1_warnings_redacted")
    def p1_warnings_redacted(spark, d):
        """All warnings with the credential characters of path and reason masked."""
        w = with_spans(table(spark, d, "sensitive_path_warnings").select("path", "reason"), "path")
        w = with_spans(w.selectExpr("cred_redacted AS path", "size(cred_spans) AS in_path", "reason"), "reason")
        return w.selectExpr("path", "cred_redacted AS reason", "in_path", "size(cred_spans) AS in_reason")
