"""Queries: usage windows, workflow audit, recent misses."""

from __future__ import annotations

from waymark.operators import usage as U
from waymark.registry import Registry, table

EVENTS = "e AS (SELECT DISTINCT ON (id) * FROM usage_events ORDER BY id, timestamp, command, query)"
STATS = f"""WITH {EVENTS}, n AS (SELECT max(timestamp) AS now FROM e), w(label, days) AS (VALUES ('1d', 1), ('2d', 2), ('5d', 5), ('30d', 30)),
  s AS (SELECT w.label, w.days, count(e.id) AS total, coalesce(sum(CASE WHEN e.hit THEN 1 ELSE 0 END), 0)::BIGINT AS hits, coalesce(sum(e.result_count), 0)::BIGINT AS results
        FROM w CROSS JOIN n LEFT JOIN e ON e.timestamp >= n.now - w.days * 86400 GROUP BY w.label, w.days)"""


def register(reg: Registry) -> None:
    @reg.query(
        "usage_windows",
        STATS + "SELECT label, days, total, hits, total - hits AS misses, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / total END AS hit_ratio, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE results::DOUBLE / total END AS avg_results FROM s",
    )
    def usage_windows(spark, d):
        e = U.distinct_events(table(spark, d, "usage_events"))
        return U.window_stats(e, e.agg({"timestamp": "max"}).scalar())

    @reg.query(
        "usage_graph",
        STATS
        + """, m AS (SELECT max(greatest(hits, total - hits)) AS most FROM s)
        SELECT label, hits, total - hits AS misses, CASE WHEN most = 0 OR hits = 0 THEN '' ELSE repeat('#', least(30, greatest(1, round(hits::DOUBLE / most * 30)))::INTEGER) END AS hits_bar,
          CASE WHEN most = 0 OR total = hits THEN '' ELSE repeat('#', least(30, greatest(1, round((total - hits)::DOUBLE / most * 30)))::INTEGER) END AS misses_bar FROM s, m""",
    )
    def usage_graph(spark, d):
        return U.hit_miss_graph(usage_windows(spark, d))

    @reg.query(
        "usage_audit",
        f"""WITH {EVENTS} SELECT count(*) AS total, count(*) FILTER (coalesce(command, '') NOT IN ('refs', 'pack', 'impact')) AS search, count(*) FILTER (command = 'refs') AS refs,
          count(*) FILTER (command = 'pack') AS pack, count(*) FILTER (command = 'impact') AS impact,
          count(*) FILTER (used_type OR used_lang OR used_path OR used_limit) AS filtered_or_limited, count(*) FILTER (NOT hit) AS misses FROM e""",
    )
    def usage_audit(spark, d):
        return U.workflow_audit(U.distinct_events(table(spark, d, "usage_events")))

    @reg.query("recent_misses", f"WITH {EVENTS} SELECT id, query FROM e WHERE result_count = 0 ORDER BY id DESC, timestamp, query LIMIT 10")
    def recent_misses(spark, d):
        return U.recent_misses(U.distinct_events(table(spark, d, "usage_events")))
