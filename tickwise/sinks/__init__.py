"""Table sinks, landing and versioned snapshots."""
from .snapshots import (apply_changes, changes_between, committed_versions, read_snapshot,  # noqa: F401
                        snapshot, sync_index)
from .tables import declare_table, land, overwrite_table  # noqa: F401
