"""Named queries over the driver's tables and their SQL counterparts."""

from . import queries_edges, queries_plans, queries_signals

QUERIES = queries_signals.QUERIES | queries_edges.QUERIES | queries_plans.QUERIES
ORACLES = queries_signals.ORACLES | queries_edges.ORACLES | queries_plans.ORACLES
