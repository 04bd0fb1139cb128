"""Filling nulls by rule or by mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Largest absolute value of the whole-number types.
WHOLE = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1}


def _holding(kind: str, value: float) -> str:
    """The column's type, or the smallest wider one that holds the value as well."""
    if kind not in WHOLE:
        return kind
    if value != int(value):
        return "double"
    return next((k for k, most in WHOLE.items() if WHOLE[kind] <= most and abs(value) <= most), "double")


def impute_rules(df: DataFrame, rules: dict[str, float | None]) -> DataFrame:
    """Replace nulls by each column's sentinel; a rule without a value leaves the column alone.

    A rule for a root column also covers its lagged copies, unless they have their own rule. A
    whole-number column that cannot hold its sentinel becomes a wider one.
    """
    fills = {}
    for c in df.columns:
        root = c.removeprefix("lag1_").removeprefix("lag2_")
        value = rules.get(c, rules.get(root))
        if value is not None:
            kind = _holding(df.schema[c].dataType.simpleString(), value)
            exact = F.lit(int(value)) if kind in WHOLE else F.lit(value)
            fills[c] = F.coalesce(F.col(c).cast(kind), exact.cast(kind))
    return df.withColumns(fills) if fills else df


def column_means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Means of the training rows: one row, read to the driver."""
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return row.asDict()


def impute_mean(df: DataFrame, means: dict[str, float | None]) -> DataFrame:
    """Replace nulls by means that were fitted on the training rows."""
    known = {c: F.coalesce(F.col(c), F.lit(float(m))) for c, m in means.items() if m is not None}
    return df.withColumns(known) if known else df
