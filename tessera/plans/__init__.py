"""The query catalog: one registered query for each operator family."""

from __future__ import annotations

from tessera.plans.registry import Query, registry

#: The query that entry() runs.
FLAGSHIP = "group_count_sum"

__all__ = ["FLAGSHIP", "Query", "registry"]
