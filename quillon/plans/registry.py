"""Every registered query and its SQL twin."""

from __future__ import annotations

from quillon.plans import content_queries, editorial_queries, index_queries, landed_queries, media_queries, post_queries, record_queries, scene_queries, sound_queries, source_queries, table_queries, text_queries

MODULES = (text_queries, table_queries, media_queries, source_queries, content_queries, scene_queries, editorial_queries, index_queries, landed_queries, post_queries, sound_queries, record_queries)
QUERIES: dict = {name: f for m in MODULES for name, f in m.Q.items()}
ORACLE_SQL: dict = {name: sql for m in MODULES for name, sql in m.S.items()}
