"""All registered queries and their SQL."""

from __future__ import annotations

from sparkloom.plans import aggregates, documents, events, folds, governance, graphs, knowledge, logs, memory, merge, messages, orders, retrieval, streams, units, vectors, views  # noqa: F401  each registers its queries
from sparkloom.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
