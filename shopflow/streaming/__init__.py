"""Incremental ingest.

The reference has no streaming code (its README mentions stream
processing, but every stage is a batch job).  The one incremental piece
offered here is ingest: new raw event files are cleaned as they arrive and
appended to the cleaned table, so the batch stages can run on fresh data.
"""

from shopflow.streaming.ingest import start_ingest

__all__ = ["start_ingest"]
