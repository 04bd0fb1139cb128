"""Choosing columns by name while the plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: prefixes of lagged copies of a feature.
LAG_PREFIX = r"^(lag1_|lag2_)"


def select_columns(df: DataFrame, include: str = "", exclude: str | None = None) -> list[str]:
    """Names that match one pattern and not the other, in schema order."""
    return [
        c
        for c in df.columns
        if re.search(include, c) and not (exclude and re.search(exclude, c))
    ]


def root_name(name: str | Column) -> Column:
    """Feature name without its lag prefix."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(c, LAG_PREFIX, "")

