"""Sources and sinks: Arrow IPC streams and columnar snapshots."""

from .arrow_ipc import ArrowIpcSource, export_arrow, read_arrow, remove_arrow
from .predicates import EXACT, PRUNE_ONLY, UNSUPPORTED, classify
from .snapshot import compress, encoding_stats, prune_stats, read_snapshot, read_table, write_snapshot

__all__ = ["EXACT", "PRUNE_ONLY", "UNSUPPORTED", "ArrowIpcSource", "classify", "compress", "encoding_stats", "export_arrow", "prune_stats", "read_arrow", "read_snapshot", "read_table", "remove_arrow", "write_snapshot"]
