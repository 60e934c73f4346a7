"""Structured Streaming entry points.

The reference has no streaming operator (its app recomputes on input change).  The one
incremental job that fits its data flow is the preparation of ``zone_trips`` (Q10) for
survey records that arrive as new files: each micro-batch is located against the static
zone layer (a stream-static broadcast join, no state) and appended to the prepared table.
"""

from odflow.streaming.prepare_stream import zone_trips_stream

__all__ = ["zone_trips_stream"]
