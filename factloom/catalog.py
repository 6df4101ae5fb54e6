"""All queries of the library: importing this module loads every operator."""

from factloom.operators import aggregates, analyzers, batches, classes, composites, documents, domains, extract, filters, graph, impacts, joins, knowledge, listings, lookups, markup, matrices, measures, merge, reports, resolve, scans, search, traces, triage, validation, windows
from factloom.registry import ORACLES, QUERIES
from factloom.sources import roundtrips
from factloom.streaming import approvals, graphs, upkeep

MODULES = (aggregates, analyzers, batches, classes, composites, documents, domains, extract, filters, graph, impacts, joins, knowledge, listings, lookups, markup, matrices, measures, merge, reports, resolve, scans, search, traces, triage, validation, windows, roundtrips, approvals, graphs, upkeep)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
