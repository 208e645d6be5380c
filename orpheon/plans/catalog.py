"""The catalogue of the engine's own queries."""

from __future__ import annotations

from orpheon.plans import align_queries, file_queries, metric_queries, prepare_queries, retrieval_queries, scalar_queries, sequence_queries
from orpheon.plans.registry import Registry

FLAGSHIP = "retrieval_map_mrr"
CATALOG = Registry()
for part in (retrieval_queries.Q, scalar_queries.Q, align_queries.Q, metric_queries.Q, sequence_queries.Q, prepare_queries.Q, file_queries.Q):
    for name, builder in part.builders.items():
        CATALOG.query(name, part.oracles.get(name))(builder)
