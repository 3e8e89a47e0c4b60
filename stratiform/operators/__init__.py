from stratiform.operators.aggregates import distinct_values, group_mean
from stratiform.operators.cells import (
    filter_wide,
    merge_cells,
    merge_wide,
    newest_versions,
    wide_first,
    wide_to_cells,
    wide_view,
    wide_where,
)
from stratiform.operators.dedup import latest_per_key, newest_per_key
from stratiform.operators.filters import any_not_null, either, membership_flag, split_by_flag
from stratiform.operators.flatten import flatten, leaf_paths
from stratiform.operators.joins import inner_join, left_enrich, lookup_left_join, shift_year
from stratiform.operators.reshape import project_families, rename_with_prefix, union_all, union_by_name

__all__ = [
    "any_not_null",
    "distinct_values",
    "either",
    "filter_wide",
    "flatten",
    "group_mean",
    "inner_join",
    "latest_per_key",
    "leaf_paths",
    "left_enrich",
    "lookup_left_join",
    "membership_flag",
    "merge_cells",
    "merge_wide",
    "newest_per_key",
    "newest_versions",
    "project_families",
    "rename_with_prefix",
    "shift_year",
    "split_by_flag",
    "union_all",
    "union_by_name",
    "wide_first",
    "wide_to_cells",
    "wide_view",
    "wide_where",
]
