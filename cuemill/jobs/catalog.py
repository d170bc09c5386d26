"""All registered queries of the media part."""

from . import container_queries, file_queries, fingerprint_queries, packet_queries, stream_queries, table_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
