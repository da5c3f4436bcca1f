"""SQL building blocks for the oracle: the sequential greedy scan, written as a recursion over row ranks."""

from __future__ import annotations


def greedy(source: str, order: str, conflict: str) -> str:
    """CTEs ``o`` (ranked rows), ``c`` (earlier conflicting ids per row) and ``kept`` (project_id, id).

    ``conflict`` names the earlier row ``k`` and the later row ``u``. Rank by rank, a row is appended to its
    project's kept list unless that list already holds one of its earlier conflicts.
    """
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {order}) AS rk FROM {source}),
c AS MATERIALIZED (SELECT u.project_id, u.id, list(k.id ORDER BY k.rk) AS earlier FROM o k JOIN o u ON k.project_id=u.project_id AND k.rk<u.rk AND ({conflict}) GROUP BY ALL),
oc AS MATERIALIZED (SELECT o.project_id, o.rk, o.id, coalesce(c.earlier, []) AS earlier FROM o LEFT JOIN c ON c.id=o.id AND c.project_id=o.project_id),
g AS (SELECT DISTINCT project_id, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM o UNION ALL
 SELECT g.project_id, g.rk+1, CASE WHEN list_has_any(g.kept, oc.earlier) THEN g.kept ELSE list_append(g.kept, oc.id) END FROM g JOIN oc ON oc.project_id=g.project_id AND oc.rk=g.rk+1),
kept AS (SELECT project_id, unnest(kept) AS id FROM (SELECT project_id, arg_max(kept, rk) AS kept FROM g GROUP BY project_id))"""


def clusters(source: str, order: str, conflict: str) -> str:
    """Adds ``cl`` (project_id, id, seed): kept rows seed themselves, the others join the first kept conflict."""
    return greedy(source, order, conflict) + """,
cl AS (SELECT project_id, id, id AS seed FROM kept UNION ALL
 SELECT c.project_id, c.id, list_filter(c.earlier, lambda e: list_contains(l.kept, e))[1] FROM c JOIN (SELECT project_id, list(id) AS kept FROM kept GROUP BY project_id) l ON l.project_id=c.project_id
 WHERE NOT list_contains(l.kept, c.id))"""
