"""Sources and sinks (section S of the survey)."""

from rfmlens.sources.readers import (
    NA_TOKENS, load_meta, preview, read_scored, read_table, read_transactions,
    source_profile, txn, txn_events,
)
from rfmlens.sources.writers import write_meta, write_scored

__all__ = [
    "NA_TOKENS", "load_meta", "preview", "read_scored", "read_table",
    "read_transactions", "source_profile", "txn", "txn_events", "write_meta",
    "write_scored",
]
