"""All registered queries and their SQL: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from weftline.plans import data_queries, log_queries, page_queries, record_queries, stream_queries

QUERIES = page_queries.QUERIES | log_queries.QUERIES | data_queries.QUERIES | record_queries.QUERIES | stream_queries.QUERIES
ORACLES = page_queries.ORACLES | log_queries.ORACLES | data_queries.ORACLES | record_queries.ORACLES | stream_queries.ORACLES
