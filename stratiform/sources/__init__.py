from stratiform.sources.delimited import read_positional_csv
from stratiform.sources.envelope import (
    list_files,
    parse_envelopes,
    quarantined,
    read_envelopes,
    records,
)
from stratiform.sources.tables import inline_table, read_table

__all__ = [
    "inline_table",
    "list_files",
    "parse_envelopes",
    "quarantined",
    "read_envelopes",
    "read_positional_csv",
    "read_table",
    "records",
]
