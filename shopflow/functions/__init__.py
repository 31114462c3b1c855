"""Column-level kernels (no actions, no joins)."""

from shopflow.functions.buckets import cut, cut_ordinal, label_frame, keep_all_labels
from shopflow.functions.numeric import (
    safe_ratio, bround, mean_exact, money_sum, nan_to_null, seconds_between, present,
)
from shopflow.functions.text import leaf_name, contains_literal, matches_regex

__all__ = [
    "cut", "cut_ordinal", "label_frame", "keep_all_labels",
    "safe_ratio", "bround", "mean_exact", "money_sum", "nan_to_null",
    "seconds_between", "present",
    "leaf_name", "contains_literal", "matches_regex",
]
