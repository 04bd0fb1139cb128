"""Drift between months and column summaries, for all columns in the same jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.ordering import keys_at, lower_bound
from cohortlens.operators.panel import months_in
from cohortlens.operators.ranks import long_form
from cohortlens.session import pin


def exact_quantiles(
    df: DataFrame,
    value: Column,
    tie: Column,
    parts: int,
    groups: list[str],
    out: str = "edges",
    bits: int | None = None,
) -> DataFrame:
    """The parts+1 exact quantiles 0, 1/parts, ... 1 of every group, linearly interpolated.

    Quantile i stands at position (n-1)*i/parts; both neighbours are looked up exactly. Nulls
    must be filtered out before. `tie` spreads rows of a very frequent value.
    """

    def at(n: Column, i: Column) -> Column:
        return F.floor((n - 1) * i / parts).cast("long")

    steps = F.sequence(F.lit(0), F.lit(parts))

    def positions(n: Column) -> Column:
        low = F.transform(steps, lambda i: at(n, i))
        return F.array_distinct(F.concat(low, F.transform(low, lambda p: F.least(p + 1, n - 1))))

    found = keys_at(
        df, value.cast("double"), tie, positions, groups, bits, values_only=True
    )
    n = F.col("_total")
    pairs = F.map_from_entries(F.collect_list(F.struct("_position", "_value")))
    values = found.groupBy(*groups, "_total").agg(pairs.alias("_at"))

    def quantile(i: Column) -> Column:
        p = at(n, i)
        low = F.element_at("_at", p)
        high = F.element_at("_at", F.least(p + 1, n - 1))
        return low + (high - low) * ((n - 1) * i % parts / parts)

    return values.select(*groups, "_total", F.transform(steps, quantile).alias(out))


def _term(expected: Column, actual: Column, floor: float | None) -> Column:
    """(q - p) ln(q / p) with its limits: infinite if one side is empty, NaN if both are."""
    if floor is not None:
        expected, actual = F.greatest(expected, F.lit(floor)), F.greatest(actual, F.lit(floor))
    plain = (actual - expected) * F.ln(actual / expected)
    return (
        F.when((expected == 0) & (actual == 0), F.lit(float("nan")))
        .when((expected == 0) | (actual == 0), F.lit(float("inf")))
        .otherwise(plain)
    )


def psi(
    df: DataFrame,
    cols: list[str],
    id_col: str,
    period: str,
    train: list[int],
    score: list[int],
    buckets: int = 255,
    floor: float | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Population stability index of every column between train and score months.

    Bins are the exact train quantiles without duplicates; the last bin is closed. Score values
    outside the train range fall into no bin but count in the denominator. A null term is added
    only if both sides have nulls. An empty bin makes the index infinite, or not a number when
    empty on both sides; `floor` replaces empty shares by a small one instead.
    Months are taken once each; a month in both lists counts on both sides.
    """
    rows = long_form(months_in(df, period, train + score), cols, [id_col, period])
    is_train = F.col(period).isin(train)
    is_score = F.col(period).isin(score)

    edges = exact_quantiles(
        rows.where(is_train & F.col("value").isNotNull()),
        F.col("value"),
        F.col(id_col),
        buckets,
        ["feature"],
        bits=bits,
    )
    edges = edges.select("feature", F.array_distinct("edges").alias("edges"))
    edges = pin(edges, row_bytes=8 * (buckets + 1))

    binned = lower_bound(
        rows.join(edges, "feature"), "edges", "value", "_upto", buckets + 1, inclusive=True
    )
    size = F.size("edges")
    last = F.get(F.col("edges"), size - 1)
    # bin 0..size-2; -1 for nulls; -2 outside the train range, or if a constant leaves no bin
    bin_no = (
        F.when(F.col("value").isNull(), F.lit(-1))
        .when(size < 2, F.lit(-2))
        .when(F.col("value") == last, size - 2)
        .when((F.col("_upto") == 0) | (F.col("_upto") == size), F.lit(-2))
        .otherwise(F.col("_upto") - 1)
    )
    counts = (
        binned.withColumn("bin", bin_no)
        .groupBy("feature", "bin")
        .agg(
            F.sum(is_train.cast("long")).alias("_e"),
            F.sum(is_score.cast("long")).alias("_a"),
        )
    )
    filled = F.col("bin") != -1
    sizes = counts.groupBy("feature").agg(
        F.sum(F.when(filled, F.col("_e"))).alias("_e_all"),
        F.sum(F.when(filled, F.col("_a"))).alias("_a_all"),
        F.coalesce(F.sum(F.when(~filled, F.col("_e"))), F.lit(0)).alias("_e_null"),
        F.coalesce(F.sum(F.when(~filled, F.col("_a"))), F.lit(0)).alias("_a_null"),
    )
    every = edges.select(
        "feature",
        F.explode_outer(
            F.when(F.size("edges") > 1, F.sequence(F.lit(0), F.size("edges") - 2))
        ).alias("bin"),
    )
    share = every.join(counts, ["feature", "bin"], "left").join(sizes, "feature")

    def part(count: str, all_: str) -> Column:
        return F.coalesce(F.col(count), F.lit(0)) / F.col(all_)

    term = F.when(F.col("bin").isNotNull(), _term(part("_e", "_e_all"), part("_a", "_a_all"), floor))
    e_null = F.col("_e_null") / (F.col("_e_null") + F.col("_e_all"))
    a_null = F.col("_a_null") / (F.col("_a_null") + F.col("_a_all"))
    null_term = F.when(
        (F.col("_e_null") > 0) & (F.col("_a_null") > 0), _term(e_null, a_null, None)
    ).otherwise(F.lit(0.0))
    return (
        share.groupBy("feature")
        .agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("_bins"), F.max(null_term).alias("_null"))
        .select("feature", (F.col("_bins") + F.col("_null")).alias("psi"))
    )


def psi_report(psi_frame: DataFrame) -> DataFrame:
    """Largest drift first."""
    return psi_frame.orderBy(F.col("psi").desc_nulls_last(), "feature")


def describe_numeric(df: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of every column, nulls left out."""
    rows = long_form(df, cols, [id_col]).where(F.col("value").isNotNull())
    moments = rows.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_quantiles(rows, F.col("value"), F.col(id_col), 4, ["feature"])
    quartiles = q.select(
        "feature",
        *[F.element_at("edges", i + 1).alias(f"p{25 * i}") for i in (1, 2, 3)],
    )
    return moments.join(quartiles, "feature")


def column_profile(df: DataFrame, cols: list[str], approx: float | None = None) -> DataFrame:
    """Minimum, maximum, distinct count and null count of every column, of any type that has an order.

    Extremes are doubles if all columns are numbers, else texts. Values are counted as they are, not as doubles
    or texts. Exact distinct counts first reduce the values of every column, by itself and in its own type, to one row
    each, so a frequent value never gathers in one task and a column of few values is reduced before it is shuffled;
    `approx` counts with that relative error.
    """
    numbers = all(isinstance(df.schema[c].dataType, T.NumericType) for c in cols)
    kind = "double" if numbers else "string"
    one = df.agg(
        *[
            F.struct(F.min(c).cast(kind).alias("min"), F.max(c).cast(kind).alias("max")).alias(c)
            for c in cols
        ]
    )
    extremes = one.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["min"].alias("min"),
                                     F.col(c)["max"].alias("max")) for c in cols])).alias("e")
    ).select("e.*")
    if approx is not None:
        rows = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
        nulls = F.sum(F.col("value").isNull().cast("long"))
        counts = rows.groupBy("feature").agg(
            F.approx_count_distinct("value", approx).alias("nunique"), nulls.alias("nulls")
        )
    else:

        def counted(c: str) -> DataFrame:
            values = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            found = values.agg(
                F.count("value").alias("nunique"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
                F.sum("n").alias("_rows"),
            )
            return found.where(F.col("_rows") > 0).select(F.lit(c).alias("feature"), "nunique", "nulls")

        counts = reduce(DataFrame.unionByName, [counted(c) for c in cols])
    # One row for each column on either side; a table without rows has no columns to report.
    return counts.join(extremes, "feature").select("feature", "min", "max", "nunique", "nulls")
