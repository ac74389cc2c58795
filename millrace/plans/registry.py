"""Every registered query and its SQL."""

from __future__ import annotations

from . import corpus_queries, grading_queries, io_queries, receipt_queries, record_queries, sampling_queries, study_queries, text_queries

_PARTS = (sampling_queries, corpus_queries, grading_queries, text_queries, record_queries, io_queries, study_queries, receipt_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
