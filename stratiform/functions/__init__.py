from stratiform.functions.casting import cast_all_to_string, cell_or_default, mean, typed
from stratiform.functions.dates import date_parts
from stratiform.functions.status import status_to_boolean, status_to_text
from stratiform.functions.text import base_name, row_key, snapshot_time

__all__ = [
    "base_name",
    "cast_all_to_string",
    "cell_or_default",
    "date_parts",
    "mean",
    "row_key",
    "snapshot_time",
    "status_to_boolean",
    "status_to_text",
    "typed",
]
