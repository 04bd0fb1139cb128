"""Profit of contacting the customers with the highest scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.ordering import keys_at, peak, running, sort_key
from cohortlens.session import attach

# Shares of the public and the private leaderboard, best theoretical cut-off.
PUBLIC_SHARE = 0.3
PRIVATE_SHARE = 0.7
THRESHOLD = 0.025


def gain_curve(
    df: DataFrame,
    score: str,
    id_col: str,
    gain: str,
    groups: list[str] = (),
    between: tuple[int, int] | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Cumulative gain by descending score, ties by id.

    `nro_envios` is the 0-based position; `n_sent` the number of customers contacted. `between`
    keeps positions a <= nro_envios < b without sorting the others.
    """
    out = running(
        df,
        -F.col(score),
        F.col(id_col),
        groups,
        {"gain_cum": F.col(gain)},
        bits,
        position="nro_envios",
        between=between,
    )
    return out.withColumn("n_sent", F.col("nro_envios") + 1)


def public_private_curve(
    df: DataFrame,
    score: str,
    id_col: str,
    gain: str,
    side: str,
    groups: list[str] = (),
    between: tuple[int, int] | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Cumulative gain of the public and private side, each scaled to the whole population.

    Integer gains are summed first and scaled at the end.
    """
    out = running(
        df,
        -F.col(score),
        F.col(id_col),
        groups,
        {
            "_public": F.when(F.col(side) == "public", F.col(gain)).otherwise(F.lit(0)),
            "_private": F.when(F.col(side) == "private", F.col(gain)).otherwise(F.lit(0)),
        },
        bits,
        position="nro_envios",
        between=between,
    )
    return out.withColumns(
        {
            "public": F.when(F.col(side) == "public", F.col(gain) / PUBLIC_SHARE).otherwise(0.0),
            "private": F.when(F.col(side) == "private", F.col(gain) / PRIVATE_SHARE).otherwise(0.0),
            "public_cum": F.col("_public") / PUBLIC_SHARE,
            "private_cum": F.col("_private") / PRIVATE_SHARE,
        }
    ).drop("_public", "_private")


def curve_window(curve: DataFrame, low: int, high: int, position: str = "nro_envios") -> DataFrame:
    """Positions strictly between two limits."""
    return curve.where((F.col(position) > low) & (F.col(position) < high))


def best_cutoff(
    curve: DataFrame,
    value: str,
    groups: list[str] = (),
    position: str = "nro_envios",
    out: str = "best",
) -> DataFrame:
    """Highest value of a curve and its first position, as `<out>_value` and `<out>_pos`."""
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(position)).alias("p")))
    found = curve.groupBy(*groups).agg(top.alias("_top"))
    return found.select(
        *groups, F.col("_top.v").alias(f"{out}_value"), (-F.col("_top.p")).alias(f"{out}_pos")
    )


def on_grid(curve: DataFrame, start: int, step: int, count: int,
            position: str = "nro_envios") -> DataFrame:
    """Positions start, start+step, ... start+step*count."""
    p = F.col(position)
    return curve.where(p.between(start, start + step * count) & ((p - start) % step == 0))


def gain_max(df: DataFrame, score: str, id_col: str, gain: str, groups: list[str] = ()) -> DataFrame:
    """Highest cumulative gain over descending score, without sorting the rows that cannot lie at it."""
    return peak(df, -F.col(score), F.col(id_col), F.col(gain), groups).select(*groups, F.col("_peak").alias("gain_max"))


def best_contact(
    df: DataFrame, score: str, id_col: str, gain: str, groups: list[str] = (), bits: int | None = None, out: str = "best"
) -> DataFrame:
    """Highest cumulative gain and its first position, as `best_cutoff` of the gain curve, without the curve."""
    found = peak(df, -F.col(score), F.col(id_col), F.col(gain), groups, bits)
    return found.select(*groups, F.col("_peak").alias(f"{out}_value"), F.col("_at").alias(f"{out}_pos"))


def gain_at_threshold(
    df: DataFrame,
    score: str,
    gain: str,
    threshold: float = THRESHOLD,
    share: float | Column = 1.0,
    groups: list[str] = (),
) -> DataFrame:
    """Total gain of the rows at or above a score, scaled by the share they stand for."""
    total = F.sum(F.when(F.col(score) >= threshold, F.col(gain)).otherwise(F.lit(0)))
    share = F.lit(share) if isinstance(share, float) else F.max(share)
    return df.groupBy(*groups).agg((total / share).alias("gain"))


def cutoff_submissions(
    df: DataFrame,
    score: str,
    id_col: str,
    cutoffs: list[int],
    groups: list[str] = (),
    bits: int | None = None,
) -> DataFrame:
    """For every cut-off n, each customer with Predicted = 1 for the n highest scores.

    The score and id at each cut-off are found once; customers are compared with them, so the
    table is not sorted, and never once per cut-off.
    """
    wanted = F.array(*[F.lit(int(n)).cast("long") for n in sorted(set(cutoffs)) if n > 0])
    keys = keys_at(
        df,
        -F.col(score),
        F.col(id_col),
        lambda n: F.array_distinct(F.transform(wanted, lambda k: F.least(k, n) - 1)),
        groups,
        bits,
    )
    # Every row gets every cut-off, whatever its group has.
    ends = F.map_from_entries(
        F.collect_list(F.struct("_position", sort_key(F.col("_value"), F.col("_tie"))))
    )
    per_group = keys.groupBy(*groups).agg(ends.alias("_ends"), F.max("_total").alias("_rows"))
    numbers = F.array(*[F.lit(int(n)).cast("long") for n in sorted(set(cutoffs))])
    if groups:
        out = attach(df, per_group, list(groups), row_bytes=50 * max(1, len(set(cutoffs))))
    else:
        as_list = per_group.select(F.map_entries("_ends").alias("_list"), "_rows")
        out = attach(df, as_list, []).withColumn("_ends", F.map_from_entries("_list"))
    out = out.withColumn("_cut", F.explode(numbers))
    own = sort_key(-F.col(score), F.col(id_col))
    end = F.try_element_at("_ends", F.least(F.col("_cut"), F.col("_rows")) - 1)
    kind = df.schema[id_col].dataType
    ident = F.col(id_col).cast("long") if isinstance(kind, T.NumericType) else F.col(id_col)
    return out.select(
        *groups,
        F.col("_cut").alias("n_envios"),
        ident.alias(id_col),
        F.coalesce(own <= end, F.lit(False)).cast("int").alias("Predicted"),
    )
