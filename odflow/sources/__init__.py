"""Scans, sinks and the stand-in views over the driver tables."""

from odflow.sources.io import (
    export, load_prepared, read_stop_sequence, read_table, read_zones, write_prepared,
)
from odflow.sources.views import (
    VIEW_SQL, driver_table, oracle_view, panel_od, ride, stop_seq, trip, zone_edge,
)

__all__ = [
    "export", "load_prepared", "read_stop_sequence", "read_table", "read_zones", "write_prepared",
    "VIEW_SQL", "driver_table", "oracle_view", "panel_od", "ride", "stop_seq", "trip", "zone_edge",
]
