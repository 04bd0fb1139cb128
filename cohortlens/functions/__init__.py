"""Column functions."""

from .scalars import (
    binary_targets,
    class_weight,
    month_index,
    null_safe_sum,
    row_gain,
    safe_ratio,
    sample_key,
    sample_number,
    tenure_scaled,
    variation,
    yyyymm,
)
from .selectors import root_name, select_columns

__all__ = [
    "binary_targets",
    "class_weight",
    "month_index",
    "null_safe_sum",
    "root_name",
    "row_gain",
    "safe_ratio",
    "sample_key",
    "sample_number",
    "select_columns",
    "tenure_scaled",
    "variation",
    "yyyymm",
]
