"""All queries over the reference's own operators, with the SQL that checks them.

Every query reads whole tables. ``vox`` is the volume derived from ``events``, ``edges`` its region adjacency graph.
"""

from __future__ import annotations

from . import edge_queries, extra_queries, feature_queries, graph_more, graph_queries, grid_queries, lift_queries, more_queries, solver_queries, volume_more, volume_queries, workflow_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (volume_queries, volume_more, edge_queries, feature_queries, graph_queries, graph_more, more_queries, workflow_queries, solver_queries, grid_queries, lift_queries, extra_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
