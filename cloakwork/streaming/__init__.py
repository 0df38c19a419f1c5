"""Documents as they arrive."""

from cloakwork.streaming.arrivals import stream_new_documents, stream_scan, stream_table
from cloakwork.streaming.index import stream_dual_write, stream_to_index, stream_to_routes

__all__ = [
    "stream_dual_write",
    "stream_new_documents",
    "stream_scan",
    "stream_table",
    "stream_to_index",
    "stream_to_routes",
]
