"""Every registered query with the SQL that it is compared with."""

from __future__ import annotations

from pixelweir.jobs import image_queries, stream_queries

QUERIES = {**image_queries.QUERIES, **stream_queries.QUERIES}
ORACLE_SQL = {**image_queries.ORACLE_SQL, **stream_queries.ORACLE_SQL}
