"""All queries of the library with the SQL that checks them."""

from __future__ import annotations

from parchmint.functions import canonical, citations, claims, dates, guards, issues, labels
from parchmint.operators import chains, corpus, graph, intervals, links, policies, policy, records, refresh, retrieval, reviews, search, spatial, study, temporal, validate
from parchmint.plans import federation
from parchmint.sources import feeds, html, listings, markup, publishers, sinks
from parchmint.streaming import events, sources

MODULES: list = [retrieval, temporal, records, refresh, validate, spatial, graph, citations, html, markup, listings, events, sources, sinks, federation, corpus, policy, links, canonical, claims, dates, labels, guards, issues, feeds, search, study, intervals, chains, policies, publishers, reviews]
FLAGSHIP = "bm25_passage_topk"


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
