"""Comparing experiments: curves over seeds, leaderboards, importances, signed-rank test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.selectors import root_name
from cohortlens.operators.ordering import TASK_ROWS, running
from cohortlens.session import stored


def seed_mean_curve(
    curves: DataFrame, values: list[str], groups: list[str], position: str = "nro_envios"
) -> DataFrame:
    """Mean of the curves of all seeds at every position."""
    return curves.groupBy(*groups, position).agg(*[F.avg(v).alias(f"{v}_mean") for v in values])


def seed_band(
    curves: DataFrame,
    value: str,
    groups: list[str],
    position: str = "nro_envios",
    whole_curve: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Mean curve with a band of one sample deviation over the seeds.

    With `whole_curve` the band width is one number per group: the deviation of the mean curve
    itself along its positions. `rows` is the number of rows of all curves, if known: the positions are then dealt to
    as many tasks as the rows need, whatever the session's number of shuffle partitions.
    """
    if rows and rows > TASK_ROWS:
        narrow = curves.select(*groups, position, value)
        curves = narrow.repartition(-(-rows // TASK_ROWS), *groups, position)
    mean = curves.groupBy(*groups, position).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    if whole_curve:
        width = mean.groupBy(*groups).agg(F.stddev_samp("mean").alias("std"))
        mean = mean.drop("std")
        mean = mean.join(width, groups) if groups else mean.withColumn("std", F.lit(width.first()[0]))
    return mean.withColumns(
        {"low": F.col("mean") - F.col("std"), "high": F.col("mean") + F.col("std")}
    )


def importance_mean(importances: DataFrame, feature: str, value: str) -> DataFrame:
    """Mean importance of each feature over all models, with its logarithm and root name."""
    mean = importances.groupBy(feature).agg(F.avg(value).alias("importance"))
    return mean.withColumns(
        {"log_importance": F.log1p("importance"), "root": root_name(feature)}
    )


def below_log_importance(mean: DataFrame, limit: float = 3.0) -> DataFrame:
    return mean.where(F.col("log_importance") < limit)


def importance_by_root(mean: DataFrame) -> DataFrame:
    """Importance of a feature together with its lagged copies."""
    return mean.groupBy("root").agg(
        F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("n_features")
    )


def bottom_features(mean: DataFrame, feature: str, n: int = 100) -> DataFrame:
    """The n least important features: the list of features to drop."""
    return mean.orderBy(F.col("importance").asc(), F.col(feature).desc()).limit(n).select(feature)


def top_features(mean: DataFrame, feature: str, n: int = 50) -> DataFrame:
    """The n most important features with any importance at all."""
    used = mean.where(F.col("importance") > 0)
    return used.orderBy(F.col("importance").desc(), F.col(feature).asc()).limit(n)


def drop_features(df: DataFrame, drop_list: DataFrame, name: str = "fname") -> DataFrame:
    """Drop the listed columns; the list is no longer than the schema it applies to."""
    listed = drop_list.where(F.col(name).isin(df.columns)).select(name).distinct()
    return df.drop(*[r[0] for r in listed.collect()])


def top_trials(trials: DataFrame, n: int, value: str = "value", number: str = "number",
               state: str = "state") -> DataFrame:
    """The n best completed trials."""
    done = trials.where(F.col(state) == "COMPLETE")
    return done.orderBy(F.col(value).desc(), F.col(number).asc()).limit(n)


def pending_runs(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned runs whose output does not exist yet."""
    return plan.join(done.select(*keys), keys, "left_anti")


def plan_runs(trials: DataFrame, trial: str, seeds: list[int], months: list[int],
              study: str) -> DataFrame:
    """Every trial with every seed (each seed also plus one) and month."""
    both = [int(s) for s in seeds] + [int(s) + 1 for s in seeds]
    return trials.select(
        F.lit(study).alias("study"),
        F.col(trial).alias("trial"),
        F.explode(F.array(*[F.lit(s) for s in both])).alias("seed"),
    ).withColumn("month", F.explode(F.array(*[F.lit(int(m)) for m in months])))


def leaderboard_long(wide: DataFrame, key: str, gains: list[str]) -> DataFrame:
    """Wide `<model>_<side>` gains as (key, modelo, tipo, ganancia)."""
    parts = F.split("model_type", "_")
    return wide.unpivot(key, gains, "model_type", "ganancia").select(
        key, parts.getItem(0).alias("modelo"), parts.getItem(1).alias("tipo"), "ganancia"
    )


def row_winner(gains: list[str]) -> Column:
    """Name of the column with the highest value of the row; the first one wins ties."""
    best = F.greatest(*gains)
    winner = F.lit(None).cast("string")
    for name in reversed(gains):
        winner = F.when(F.col(name) == best, F.lit(name)).otherwise(winner)
    return winner


def leaderboard_winner(wide: DataFrame, key: str, public: list[str],
                       private: list[str]) -> DataFrame:
    """Winning model of every split on each side."""
    return wide.select(
        key,
        row_winner(public).alias("best_public"),
        row_winner(private).alias("best_private"),
    )


def crosstab(df: DataFrame, rows: str, cols: str, values: list[str]) -> DataFrame:
    """Counts of two categorical columns, zeros filled."""
    return df.groupBy(rows).pivot(cols, values).count().fillna(0)


def gain_histogram(
    long: DataFrame, value: str, groups: list[str], low: float, high: float, bins: int
) -> DataFrame:
    """Row counts per equal-width bin; 0 and bins+1 hold values outside [low, high)."""
    slot = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return long.groupBy(*groups, slot.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def wilcoxon(
    pairs: DataFrame,
    first: str,
    second: str,
    groups: list[str] = (),
    decimals: int = 6,
    bits: int | None = None,
    method: str = "auto",
) -> DataFrame:
    """Wilcoxon signed-rank test of two paired columns, per group.

    Zero differences are dropped and equal absolute differences share their mean rank. Rows are
    first reduced to one row per absolute difference, and the ranks are running counts over
    those. Returns n, w_plus, w_minus, statistic, z (normal approximation, tie corrected), p_value
    (two-sided): by the exact law where at most EXACT_PAIRS differences are left and no two are equal in size, else
    by the normal approximation, which small samples differ from; with `method="approx"` always by the latter.
    """
    groups = list(groups)
    d = F.round(F.col(first) - F.col(second), decimals)
    sizes = (
        pairs.select(*groups, d.alias("_d"))
        .where(F.col("_d") != 0)
        .groupBy(*groups, F.abs("_d").alias("_abs"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum((F.col("_d") > 0).cast("long")).alias("_plus"),
        )
    )
    sizes = stored(sizes, "differences")
    ranked = running(sizes, F.col("_abs"), F.lit(0), groups, {"_upto": F.col("_n")}, bits)
    mean_rank = F.col("_upto") - (F.col("_n") - 1) / 2
    n = F.col("_n").cast("double")
    out = ranked.groupBy(*groups).agg(
        F.sum("_n").alias("n"),
        F.sum(mean_rank * F.col("_plus")).alias("w_plus"),
        F.sum(mean_rank * (F.col("_n") - F.col("_plus"))).alias("w_minus"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    total = F.col("n").cast("double")
    spread = F.sqrt((total * (total + 1) * (2 * total + 1) - F.col("_ties") / 2) / 24)
    out = (
        out.withColumn("statistic", F.least("w_plus", "w_minus"))
        .withColumn("z", (F.col("statistic") - total * (total + 1) / 4) / spread)
        .withColumn("p_value", two_sided_p("z"))
    )
    if method == "auto":
        law = pairs.sparkSession.createDataFrame(signed_rank_law(EXACT_PAIRS), "_law_n long, _law_w long, _exact double")
        here = (F.col("_ties") == 0) & (F.col("n") == F.col("_law_n")) & (F.col("statistic").cast("long") == F.col("_law_w"))
        out = out.join(F.broadcast(law), here, "left").withColumn("p_value", F.coalesce("_exact", "p_value"))
        out = out.drop("_law_n", "_law_w", "_exact")
    return out.drop("_ties")


# The most differences whose exact law is used.
EXACT_PAIRS = 50


def signed_rank_law(most: int) -> list[tuple[int, int, float]]:
    """(n, w, two-sided chance) of the smaller rank sum w of n untied differences, for all n up to `most`.

    Counts the sign patterns of each rank sum, adding one rank at a time: the sums of n ranks are those of n - 1
    ranks with and without rank n.
    """
    patterns, out = [1], []
    for n in range(1, most + 1):
        wider = patterns + [0] * n
        for w, count in enumerate(patterns):
            wider[w + n] += count
        patterns, below = wider, 0
        for w in range(n * (n + 1) // 4 + 1):
            below += patterns[w]
            out.append((n, w, min(1.0, 2 * below / 2**n)))
    return out


# Coefficients of a Chebyshev fit of the complementary error function, relative error below 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277]


def two_sided_p(z: Column | str) -> Column:
    """Two-sided tail of the normal distribution."""
    x = F.abs(F.col(z) if isinstance(z, str) else z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = c + t * power
    return t * F.exp(-x * x + power)


def paired_runs(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two experiments with equal keys, as keys, `first` and `second`."""
    a = first.select(*keys, F.col(value).alias("first"))
    b = second.select(*keys, F.col(value).alias("second"))
    return a.join(b, keys)
