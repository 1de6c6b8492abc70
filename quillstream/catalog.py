"""Every query of the library with the SQL that says what it must return."""

from __future__ import annotations

from quillstream.plans import classifier_queries, event_queries, identity_queries, market_queries, page_queries, projection_queries, record_queries, rule_queries, source_queries, stream_queries, text_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (classifier_queries, identity_queries, text_queries, event_queries, market_queries, page_queries, projection_queries, record_queries, rule_queries, source_queries, stream_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
