"""Every query of the library by name, with the SQL it equals where SQL can express it."""

from __future__ import annotations

from .plans import corpus, curated, evaluation, linked, longitudinal, pages, relational, retrieval, stored, streamed

_PARTS = [longitudinal, relational, linked, corpus, pages, retrieval, evaluation, stored, streamed, curated]

QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL: dict = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
