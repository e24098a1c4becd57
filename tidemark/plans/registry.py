"""Every query of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from tidemark.plans import capital, companies, copies, evidence, gates, graph, kernels, market, panels, portfolios, reading, reports, resampling, revisions, states, statistics, texts, timeline, valuation

FLAGSHIP = "signal_ic_by_date"
MODULES = (market, companies, panels, valuation, texts, statistics, kernels, timeline, evidence, portfolios, copies, gates, graph, reading, reports, resampling, capital, states, revisions)

QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
