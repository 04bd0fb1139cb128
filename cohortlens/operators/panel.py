"""The (entity, period) panel: periods, presence, churn label, lags and variations.

A panel holds at most one row per entity and period, so a window over one entity is never
longer than the list of periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalars import (
    LEAVES_NEXT,
    LEAVES_SECOND,
    STAYS,
    month_index,
    variation,
    yyyymm,
)

MAX_PERIODS = 10_000


def months_in(df: DataFrame, period: str, months: list[int]) -> DataFrame:
    """Rows of some months; on a table partitioned by period this prunes partitions."""
    return df.where(F.col(period).isin([int(m) for m in months]))


def in_months(df: DataFrame, date: str, months: list[int]) -> DataFrame:
    """Rows whose date or time lies in some yyyymm months.

    The range from the first to the last month is a plain comparison of the column, so the
    scan skips files and row groups by it.
    """
    wanted = sorted({int(m) for m in months})
    if not wanted:
        return df.where(F.lit(False))
    kind = df.schema[date].dataType
    after = month_number(wanted[-1]) + 1
    start = F.lit(f"{wanted[0] // 100:04d}-{wanted[0] % 100:02d}-01").cast(kind)
    end = F.lit(f"{after // 12:04d}-{after % 12 + 1:02d}-01").cast(kind)
    return df.where((F.col(date) >= start) & (F.col(date) < end) & yyyymm(date).isin(wanted))


def month_split(
    df: DataFrame, period: str, train: list[int], test: list[int]
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; a month may be in both lists."""
    return months_in(df, period, train), months_in(df, period, test)


def duplicate_keys(df: DataFrame, id_col: str, period: str) -> DataFrame:
    """Keys that occur more than once; empty for a valid panel."""
    return df.groupBy(id_col, period).count().where(F.col("count") > 1)


def observed_periods(df: DataFrame, period: str) -> list[int]:
    """The distinct periods, sorted. A period list is a calendar, so its length is checked."""
    rows = df.select(period).distinct().limit(MAX_PERIODS + 1).collect()
    if len(rows) > MAX_PERIODS:
        raise ValueError(f"{period} has more than {MAX_PERIODS} values; is it a period?")
    return sorted(r[0] for r in rows if r[0] is not None)


def one_row_per_key(
    df: DataFrame, id_col: str, period: str, newest: list[Column] = ()
) -> DataFrame:
    """One row of every key: the first by `newest`, or by all columns, the largest first."""
    order = list(newest) or [F.col(c).desc_nulls_last() for c in df.columns if c not in (id_col, period)]
    w = Window.partitionBy(id_col, period).orderBy(*(order or [F.lit(0)]))
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def period_number(df: DataFrame, period: str, periods: list[int]) -> Column:
    """The place of a period in the list of periods, as short as a calendar; null for others."""
    kind = df.schema[period].dataType
    known = F.array(*[F.lit(p).cast(kind) for p in sorted(set(periods))])
    return F.when(F.array_contains(known, F.col(period)), F.array_position(known, F.col(period)))


def dense_panel(
    df: DataFrame, id_col: str, period: str, periods: list[int] | None = None
) -> DataFrame:
    """Every entity in every observed period."""
    kind = df.schema[period].dataType
    periods = periods or observed_periods(df, period)
    ps = F.array(*[F.lit(p).cast(kind) for p in periods])
    return df.select(id_col).distinct().withColumn(period, F.explode(ps))


def panel_presence(
    df: DataFrame,
    id_col: str,
    period: str,
    flag: str = "present",
    periods: list[int] | None = None,
) -> DataFrame:
    """The dense panel with the observed columns and a 0/1 presence flag."""
    seen = df.withColumn(flag, F.lit(1))
    dense = dense_panel(df, id_col, period, periods)
    return dense.join(seen, [id_col, period], "left").fillna(0, [flag])


def churn_label(
    df: DataFrame,
    id_col: str,
    period: str,
    label: str = "label",
    calendar: bool = False,
    periods: list[int] | None = None,
) -> DataFrame:
    """Add the three-way churn label.

    Present two periods later: stays. Otherwise present one period later: leaves in the second
    period. Otherwise: leaves next. Null when the panel does not reach two periods ahead.
    "Next" is the next observed period, or the next calendar month with `calendar`.
    `periods` are the observed periods, if known; otherwise a job looks them up. A row of no
    listed period has no label. Repeated keys do no harm: presence is looked up by the period's
    number, not by row.
    """
    periods = periods or observed_periods(df, period)
    if not periods:
        return df.withColumn(label, F.lit(None).cast("string"))
    if calendar:
        number, last = month_index(period), month_number(max(periods))
    else:
        number, last = period_number(df, period, periods), len(set(periods))
    w = Window.partitionBy(id_col).orderBy("_number")
    steps = df.withColumn("_number", number.cast("long"))
    ahead = [F.max(F.lit(1)).over(w.rangeBetween(k, k)).isNotNull() for k in (1, 2)]
    value = (
        F.when(F.col("_number").isNull() | (F.col("_number") + 2 > last), F.lit(None))
        .when(ahead[1], F.lit(STAYS))
        .when(ahead[0], F.lit(LEAVES_SECOND))
        .otherwise(F.lit(LEAVES_NEXT))
    )
    return steps.withColumn(label, value).select(*df.columns, label)


def month_number(period: int) -> int:
    return period // 100 * 12 + period % 100 - 1


def _lagged(
    cols: list[str], id_col: str, period: str, lags: tuple[int, ...], calendar: bool
) -> dict[tuple[int, str], Column]:
    """One window specification for all columns (one per lag in calendar form)."""
    if not calendar:
        w = Window.partitionBy(id_col).orderBy(period)
        return {(k, c): F.lag(c, k).over(w) for k in lags for c in cols}
    by_month = Window.partitionBy(id_col).orderBy(month_index(period))
    return {
        (k, c): F.first(c).over(by_month.rangeBetween(-k, -k)) for k in lags for c in cols
    }


def lag_features(
    df: DataFrame,
    cols: list[str],
    id_col: str,
    period: str,
    lags: tuple[int, ...] = (1, 2),
    calendar: bool = False,
    keep: list[str] = (),
) -> DataFrame:
    """Keys and `lag<k>_<column>` for every column: the value at the entity's k-th previous row,
    or k calendar months before with `calendar`."""
    made = _lagged(cols, id_col, period, lags, calendar)
    return df.select(
        id_col, period, *keep, *[e.alias(f"lag{k}_{c}") for (k, c), e in made.items()]
    )


def variations(
    df: DataFrame,
    cols: list[str],
    id_col: str,
    period: str,
    lags: tuple[int, ...] = (1, 2),
    calendar: bool = False,
    keep: list[str] = (),
) -> DataFrame:
    """Keys and `variacion<k>_<column>`: relative change against the lagged value, computed in
    the window pass itself, so neither a lag table nor a join is needed."""
    made = _lagged(cols, id_col, period, lags, calendar)
    return df.select(
        id_col,
        period,
        *keep,
        *[variation(c, e).alias(f"variacion{k}_{c}") for (k, c), e in made.items()],
    )


def lag_join(
    base: DataFrame,
    lags: DataFrame,
    id_col: str,
    period: str,
    label: str | None = None,
    match_label: bool = False,
) -> DataFrame:
    """Join a panel with its stored lag table.

    With `match_label` the label takes part in the key, and rows without a label drop out.
    """
    keys = [id_col, period]
    if label and match_label:
        keys.append(label)
    elif label and label in lags.columns:
        lags = lags.drop(label)
    return base.join(lags, keys)


