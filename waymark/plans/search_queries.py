"""Queries: ranked search, roles, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import paths
from waymark.functions.privacy import redact
from waymark.functions.text import ascii_lower
from waymark.operators import search as S
from waymark.plans import sqltext as Q
from waymark.registry import Registry, table

TERM = "ledger"


def register(reg: Registry) -> None:
    @reg.query("search_rank", Q.search(TERM))
    def search_rank(spark, d):
        return S.search(table(spark, d, "records"), TERM)

    @reg.query("search_filtered", Q.search(TERM, "kind = 'function' AND lang = 'py' AND contains(path, 'src/') AND source = 'tree_sitter'", 12))
    def search_filtered(spark, d):
        return S.search(table(spark, d, "records"), TERM, S.Options(kind="function", lang="py", path="src/", source="tree_sitter", limit=12))

    @reg.query("search_text_kinds", Q.search("guide"))
    def search_text_kinds(spark, d):
        return S.search(table(spark, d, "records"), "guide")

    @reg.query("search_camel", Q.search("HE", limit=40))
    def search_camel(spark, d):
        return S.search(table(spark, d, "records"), "HE", S.Options(limit=40))

    @reg.query("file_search_rank", Q.file_search(TERM))
    def file_search_rank(spark, d):
        return S.search_files(table(spark, d, "files"), TERM)

    @reg.query("file_search_terms", f"SELECT path, score FROM (SELECT path, least({Q.file_rank('config')}, {Q.file_rank('token')}) AS score FROM (SELECT DISTINCT path FROM files WHERE regexp_extract(path, '[^/]*$') LIKE '_%.py')) WHERE score IS NOT NULL ORDER BY score, {Q.depth('path')}, {Q.low('path')}, path LIMIT 30")
    def file_search_terms(spark, d):
        return S.search_files(table(spark, d, "files"), "config token", S.Options(lang=".PY"))

    merged = f"""
      WITH r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN score <= 1 THEN 0 ELSE 1 END, {Q.search_penalty('path')}, score, {Q.KIND_RANK}, {Q.depth('path')}, length(text), path, line, col, kind, name, source, lang, text) AS pos FROM ({Q.search('config')})),
      s AS (SELECT * FROM r WHERE score <= 3), ns AS (SELECT count(*) AS n FROM s),
      f AS (SELECT *, row_number() OVER (ORDER BY score, {Q.depth('path')}, {Q.low('path')}, path) AS fpos FROM ({Q.file_search('config')})),
      k AS (SELECT * FROM f WHERE fpos <= 30 - (SELECT n FROM ns) AND path NOT IN (SELECT path FROM s)), nk AS (SELECT count(*) AS n FROM k),
      w AS (SELECT *, row_number() OVER (ORDER BY pos) AS wpos FROM r WHERE score > 3 AND path NOT IN (SELECT path FROM k))
      SELECT 'strong' AS part, path, line, kind, name, score FROM s
      UNION ALL SELECT 'file', path, NULL, NULL, NULL, score FROM k
      UNION ALL SELECT 'weak', path, line, kind, name, score FROM w WHERE wpos <= 30 - (SELECT n FROM ns) - (SELECT n FROM nk)"""

    @reg.query("search_merged", merged)
    def search_merged(spark, d):
        return S.search_merged(table(spark, d, "records"), table(spark, d, "files"), "config")

    @reg.query(
        "file_roles",
        f"""WITH p AS (SELECT DISTINCT path FROM files), r AS (SELECT path, {Q.role('path')} AS role FROM p)
        SELECT path, role, role IN ('source','test') AS source_role, role IN ('build','package_manifest','config') AS operational,
          {Q.search_penalty('path')} AS search_penalty, {Q.context_penalty('path', 'role')} AS context_penalty, {Q.fixture('path')} AS fixture,
          {Q.depth('path')} AS depth FROM r""",
    )
    def file_roles(spark, d):
        p = F.col("path")
        r = table(spark, d, "files").select("path").distinct().withColumn("role", paths.file_role(p))
        return r.select(
            "path",
            "role",
            paths.is_source_role(F.col("role")).alias("source_role"),
            paths.is_operational_role(F.col("role")).alias("operational"),
            paths.search_penalty(p).alias("search_penalty"),
            paths.context_penalty(p).alias("context_penalty"),
            paths.is_fixture_path(p).alias("fixture"),
            paths.path_depth(p).cast("bigint").alias("depth"),
        )

    sensitive_names = "('.env','.env.local','.env.production','.env.development','.envrc','.netrc','.npmrc','.pypirc','credentials','credentials.json','id_rsa','id_dsa','id_ecdsa','id_ed25519')"
    np = Q.norm("path")

    @reg.query(
        "sensitive_paths",
        f"""SELECT path, reason FROM (SELECT DISTINCT path, CASE WHEN {Q.base(np)} IN {sensitive_names} THEN 'sensitive filename'
          WHEN {Q.ends(Q.base(np), '.pem', '.key', '.p12', '.pfx')} THEN 'private key or certificate-like extension'
          WHEN list_has_any(string_split({np}, '/'), ['secrets','secret','credentials','private_keys']) THEN 'sensitive directory name' END AS reason FROM files) WHERE reason IS NOT NULL""",
    )
    def sensitive_paths(spark, d):
        return table(spark, d, "files").select("path").distinct().withColumn("reason", paths.sensitive_reason(F.col("path"))).filter(F.col("reason").isNotNull())

    key_value = r"""(?i)\b((?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|private[_-]?key|secret|token)\s*[:=]\s*)("[^"\s]+"|''[^''\s]+''|[^\s"'',;]+)"""

    @reg.query(
        "redact_text",
        f"""SELECT path, line, col, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{key_value}', '\\1[REDACTED]', 'g'),
          '\\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\\b', '[REDACTED]', 'g'), '\\bgh[pousr]_[A-Za-z0-9_]{{20,}}\\b', '[REDACTED]', 'g'),
          '\\beyJ[A-Za-z0-9_-]{{10,}}\\.[A-Za-z0-9_-]{{10,}}\\.[A-Za-z0-9_-]{{10,}}\\b', '[REDACTED]', 'g'), '-----BEGIN [A-Z ]*PRIVATE KEY-----', '[REDACTED]', 'g') AS text FROM records""",
    )
    def redact_text(spark, d):
        return table(spark, d, "records").select("path", "line", "col", redact(F.col("text")).alias("text"))

    @reg.query(
        "path_forms",
        f"""SELECT DISTINCT path, {Q.low('path')} AS lowered, nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1), '') AS ext,
          nullif(CASE WHEN contains(regexp_extract(path, '[^/]*$'), '.') THEN regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') ELSE regexp_extract(path, '[^/]*$') END, '') AS stem,
          regexp_replace({Q.low('path')}, '[^a-z0-9]', '', 'g') AS test_name, nullif(split_part(path, '/', 1), '') AS top_dir FROM files""",
    )
    def path_forms(spark, d):
        p = F.col("path")
        return table(spark, d, "files").select("path").distinct().select("path", ascii_lower(p).alias("lowered"), paths.extension(p).alias("ext"), paths.stem(p).alias("stem"), paths.test_name(p).alias("test_name"), paths.top_dir(p).alias("top_dir"))
