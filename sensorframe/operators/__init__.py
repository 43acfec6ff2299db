from .catalog import (
    catalog,
    dedup_logs,
    drop_logs,
    fingerprint_logs,
    merge_profile,
    profile_logs,
    select_logs,
    union_logs,
)
from .kept import KeptOrder, keep_order, open_order
from .resample import resample
from .rolling import rolling
from .rowindex import with_row_index
from .series import source_series, to_points
from .table import distinct_identifiers, exclude_identifiers, index_table, page, sort_table

__all__ = [
    "KeptOrder",
    "catalog",
    "dedup_logs",
    "distinct_identifiers",
    "drop_logs",
    "exclude_identifiers",
    "fingerprint_logs",
    "index_table",
    "keep_order",
    "merge_profile",
    "open_order",
    "page",
    "profile_logs",
    "resample",
    "rolling",
    "select_logs",
    "sort_table",
    "source_series",
    "to_points",
    "union_logs",
    "with_row_index",
]
