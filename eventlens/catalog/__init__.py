"""Registered queries, grouped by subject; importing this package fills the registry."""

from eventlens.catalog import io, filters, joins, aggregates, features, scalars, ingest, rules, analytics, views, graph, plans, robust, streams  # noqa: F401, I001
