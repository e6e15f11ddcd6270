"""Lookup expressions: kind ranks, confidences, evidence priorities, reference ranks, kind groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.paths import file_role, is_fixture_path, is_operational_role, let

# Tiers of landmark kinds (fixed values).
KIND_TIERS = (
    ("function", "class", "method", "component", "component_def"),
    ("interface", "type", "struct", "enum", "trait"),
    ("const", "constant", "variable", "module", "import", "export"),
    ("target", "make_target"),
    ("css_id", "css_class", "css_variable", "keyframes"),
    ("jsx_class", "component_usage"),
    ("html_id", "html_class", "html_tag", "data_attribute", "id", "key", "table"),
    ("todo", "fixme"),
    ("heading", "markdown_heading", "section"),
    ("checklist", "link"),
)
TEXT_KINDS = ("todo", "fixme", "checklist", "link", "section", "heading", "markdown_heading")
DIRECT_KINDS = tuple("class constant css_class css_id css_variable data_attribute enum function html_class html_id html_tag interface key keyframes method module section struct table trait type variable".split())
LOCAL_SYMBOL_KINDS = tuple("class constant enum function interface method module struct trait type variable".split())
STOPLIST = tuple("test main new run app id name type value".split())
IMPORT_KINDS = ("import", "export", "include", "require", "source")
KIND_GROUPS = {
    "callable": ("function", "func", "f", "method", "m", "constructor"),
    "type": ("class", "c", "struct", "s", "interface", "trait", "enum", "type", "typedef"),
    "module": ("module", "namespace", "package"),
    "value": ("constant", "const", "variable", "var", "field", "property", "member"),
    "module-edge": ("import", "export"),
}
REF_RANKS = ("Production", "Import", "Test", "Docs", "Ui", "Fixture")
IMPACT_GROUPS = ("References", "Dependents", "Tests", "Docs", "Config", "Unknown")


def case(c: Column, table: list[tuple[tuple[str, ...], int]], other: int) -> Column:
    out = None
    for names, v in table:
        out = F.when(c.isin(*names), v) if out is None else out.when(c.isin(*names), v)
    return out.otherwise(other)


def kind_rank(kind: Column) -> Column:
    return case(kind, [(names, k) for k, names in enumerate(KIND_TIERS)], 99)


def confidence_rank(c: Column) -> Column:
    return case(c, [(("direct", "exact_local", "semantic"), 0), (("dependency", "resolved"), 1), (("syntax", "test-related"), 2), (("ambiguous", "heuristic"), 3), (("unresolved",), 4)], 3)


def file_reference_confidence_rank(c: Column) -> Column:
    return case(c, [(("resolved",), 0), (("ambiguous",), 1), (("unresolved",), 2)], 3)


def ref_evidence_priority(kind: Column, confidence: Column) -> Column:
    return (
        F.when(kind.isin("import", "export", "call", "type_reference"), 0)
        .when((kind == "module_dependency") & (confidence != "unresolved"), 1)
        .when(kind.isin("markdown_link", "css_usage", "html_usage"), 3)
        .when(kind == "test_reference", 4)
        .when(kind == "module_dependency", 6)
        .when(kind == "text_reference", 8)
        .otherwise(5)
    )


def file_ref_evidence_priority(kind: Column, target: Column) -> Column:
    resolved = case(kind, [(IMPORT_KINDS, 1), (("script", "stylesheet"), 2), (("asset", "fixture"), 3), (("link",), 4)], 5)
    return F.when(target.isNotNull(), resolved).otherwise(7)


def file_ref_priority(kind: Column) -> Column:
    return case(kind, [(IMPORT_KINDS, 0), (("script", "stylesheet"), 1), (("asset", "fixture"), 2), (("config_path", "package_entry"), 3), (("link",), 4)], 8)


def ref_rank(path: Column, kind: Column) -> Column:
    """Position in REF_RANKS."""
    return (
        F.when(is_fixture_path(path), 5)
        .when(kind == "test_reference", 2)
        .when(kind == "import", 1)
        .when(kind == "markdown_link", 3)
        .when(kind.isin("css_usage", "html_usage"), 4)
        .when(file_role(path) == "test", 2)
        .otherwise(0)
    )


def file_ref_rank(path: Column, kind: Column) -> Column:
    return (
        F.when(is_fixture_path(path) | (kind == "fixture"), 5)
        .when(kind.isin(*IMPORT_KINDS), 1)
        .when(kind == "link", 3)
        .when(kind.isin("asset", "script", "stylesheet"), 4)
        .when(file_role(path) == "test", 2)
        .otherwise(0)
    )


# Decision tables of impact rows as SQL over the columns kind, confidence, role, fixture, grp, target: one text
# each, so a plan is built with a few calls
_IMPORT = ", ".join(f"'{k}'" for k in IMPORT_KINDS)
OPERATIONAL = "role IN ('build', 'package_manifest', 'config')"
IMPACT_GROUP_FOR_REF = f"""CASE WHEN kind = 'test_reference' OR role = 'test' THEN 'Tests'
  WHEN kind = 'module_dependency' THEN CASE WHEN confidence = 'unresolved' THEN 'Unknown' ELSE 'Dependents' END
  WHEN kind = 'markdown_link' OR role = 'docs' THEN 'Docs' WHEN {OPERATIONAL} THEN 'Config'
  WHEN fixture OR role IN ('generated', 'vendor') THEN 'Unknown' ELSE 'References' END"""
IMPACT_CONFIDENCE_FOR_REF = """CASE WHEN confidence = 'semantic' THEN 'semantic' WHEN grp = 'Tests' THEN 'test-related' WHEN grp = 'Dependents' THEN 'dependency'
  WHEN grp = 'References' AND confidence = 'exact_local' THEN 'direct' ELSE 'heuristic' END"""
IMPACT_REASON_FOR_REF = """CASE WHEN grp = 'Tests' THEN 'test references ' WHEN grp = 'Dependents' THEN 'dependency reference to ' WHEN grp = 'Docs' THEN 'docs reference ' WHEN grp = 'Config' THEN 'build/config reference '
  WHEN grp = 'Unknown' AND confidence = 'unresolved' THEN 'unresolved dependency ' WHEN grp = 'Unknown' THEN 'unknown impact from '
  WHEN kind = 'import' THEN 'imports ' WHEN kind = 'call' THEN 'calls ' WHEN kind = 'export' THEN 'exports ' WHEN kind = 'type_reference' THEN 'type reference to ' WHEN kind = 'text_reference' THEN 'references ' ELSE kind || ' to ' END || target"""
IMPACT_REF_PRIORITY = """CASE WHEN grp = 'Tests' THEN CASE WHEN kind = 'test_reference' THEN 0 WHEN kind IN ('call', 'import') THEN 1 ELSE 2 END
  WHEN grp = 'References' THEN CASE kind WHEN 'import' THEN 0 WHEN 'call' THEN 1 WHEN 'type_reference' THEN 2 WHEN 'text_reference' THEN 5 ELSE 8 END
  WHEN grp IN ('Dependents', 'Config') THEN 0 WHEN grp = 'Docs' THEN CASE WHEN kind = 'markdown_link' THEN 0 ELSE 2 END ELSE CASE WHEN fixture THEN 20 ELSE 10 END END"""
IMPACT_GROUP_FOR_FILE_REF = f"""CASE WHEN fixture THEN 'Unknown' WHEN kind = 'fixture' OR role = 'test' THEN 'Tests' WHEN kind IN ({_IMPORT}) THEN 'Dependents'
  WHEN kind = 'link' OR role = 'docs' THEN 'Docs' WHEN kind IN ('config_path', 'package_entry') OR {OPERATIONAL} THEN 'Config' ELSE 'References' END"""
FILE_REF_CONFIDENCE = f"CASE WHEN role = 'test' OR kind = 'fixture' THEN 'test-related' WHEN kind IN ({_IMPORT}) AND confidence = 'resolved' THEN 'dependency' ELSE 'heuristic' END"
FILE_REF_PRIORITY = f"CASE WHEN kind IN ({_IMPORT}) THEN 0 WHEN kind IN ('script', 'stylesheet') THEN 1 WHEN kind IN ('asset', 'fixture') THEN 2 WHEN kind IN ('config_path', 'package_entry') THEN 3 WHEN kind = 'link' THEN 4 ELSE 8 END"
CONFIDENCE_RANK = "CASE WHEN confidence IN ('direct', 'exact_local', 'semantic') THEN 0 WHEN confidence IN ('dependency', 'resolved') THEN 1 WHEN confidence IN ('syntax', 'test-related') THEN 2 WHEN confidence = 'unresolved' THEN 4 ELSE 3 END"
ROLE_PENALTY = f"CASE WHEN role IN ('generated', 'vendor') THEN 30 WHEN fixture THEN 25 WHEN role = 'test' THEN 10 WHEN role = 'docs' THEN 15 WHEN {OPERATIONAL} THEN 20 ELSE 0 END"
"""Groups, confidences, reasons and priorities by their kinds (fixed values)."""


def kind_group(kind: Column) -> Column:
    out = None
    for group, names in KIND_GROUPS.items():
        out = F.when(kind.isin(*names), group) if out is None else out.when(kind.isin(*names), group)
    return out
