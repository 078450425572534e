"""Where the configuration snapshots come from."""

from subdrift.sources.snapshots import Snapshot, normalise, read_table

__all__ = ["Snapshot", "normalise", "read_table"]
