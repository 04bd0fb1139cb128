"""Cross-validation by gain, random search, target comparison and backtests."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.models.stopping import cv_until_stopped, mean_curve, round_gains
from cohortlens.models.trees import assemble, fit_boosted, predict, scores_per_round
from cohortlens.operators.evaluate import pending_runs
from cohortlens.operators.profit import cutoff_submissions, public_private_curve
from cohortlens.operators.sampling import kfold, stratified_split
from cohortlens.session import stored
from cohortlens.sources.curves import RUN, write_cut_points, write_submissions
from cohortlens.sources.tables import finished_runs

# Ranges of the parameter search, given as (low, high) and type.
SEARCH_SPACE = {
    "num_leaves": (10, 500, int),
    "min_data_in_leaf": (50, 5000, int),
    "feature_fraction": (0.1, 0.9, float),
    "bagging_fraction": (0.1, 0.9, float),
}


def random_params(space: dict, trials: int, seed: int) -> list[dict]:
    """Reproducible parameter sets; fractions carry three decimals."""
    rng = random.Random(seed)
    return [
        {
            name: rng.randint(low, high) if kind is int else round(rng.uniform(low, high), 3)
            for name, (low, high, kind) in space.items()
        }
        for _ in range(trials)
    ]


def random_mask(features: list[str], seed: int) -> list[str]:
    """Each feature kept with probability one half; never empty."""
    rng = random.Random(seed)
    kept = [f for f in features if rng.random() < 0.5]
    return kept or features[:1]


def cv_curve(
    rows: DataFrame,
    id_col: str,
    target: str,
    weight: str | None,
    gain: str,
    rounds: int,
    folds: int = 5,
    learning_rate: float = 0.1,
    params: dict | None = None,
    seed: int = 42,
    every: int = 1,
    parallelism: int = 1,
) -> DataFrame:
    """Mean and deviation over the folds of the highest gain after every `every` boosting rounds.

    `rows` are assembled and carry a `fold` column. `parallelism` folds are fitted at a time. The
    held-out scores of all folds are written once; the gain curves of all (fold, round) pairs
    are then evaluated together.
    """

    def one(k: int) -> DataFrame:
        model = fit_boosted(
            rows.where(F.col("fold") != k), target, weight, rounds, learning_rate, params, seed
        )
        test = rows.where(F.col("fold") == k)
        return scores_per_round(model, test, [id_col, gain, "fold"], every=every)

    with ThreadPoolExecutor(parallelism) as pool:
        held_out = list(pool.map(one, range(folds)))
    scores = stored(reduce(DataFrame.unionByName, held_out), "cv-scores")
    return mean_curve(round_gains(scores, "margin", id_col, gain, ["fold", "iteration"]))


def with_folds(
    df: DataFrame, features: list[str], keep: list[str], id_col: str, label: str, folds: int, seed: int
) -> DataFrame:
    """Assembled rows with stratified folds, written once for all models of a search."""
    rows = kfold(df, id_col, label, folds, seed)
    return stored(assemble(rows, features, [*keep, "fold"]), "folds")


def best_round(curve: DataFrame) -> tuple[int, float]:
    """First round with the highest mean gain, and that gain."""
    row = curve.orderBy(F.col("gain_mean").desc(), F.col("iteration").asc()).first()
    return row["iteration"], row["gain_mean"]


def trial_values(curve: DataFrame, folds: int, months: int, keys: list[str] = ()) -> DataFrame:
    """Objective of each trial's mean curve: the highest mean fold gain times the folds, per train month, and its round."""
    top = F.max(F.struct(F.col("gain_mean").alias("v"), (-F.col("iteration")).alias("i"))).alias("_top")
    found = curve.groupBy(*keys).agg(top)
    return found.select(*keys, (F.col("_top.v") * folds / months).alias("value"), (-F.col("_top.i")).alias("best_iter"))


def beside(curves: dict[str, DataFrame], folds: int) -> DataFrame:
    """Mean gain times the folds after every round, one column per curve."""
    parts = [c.select("iteration", (F.col("gain_mean") * folds).alias(name)) for name, c in curves.items()]
    return reduce(lambda a, b: a.join(b, "iteration"), parts)


def search(
    df: DataFrame,
    features: list[str],
    id_col: str,
    target: str,
    weight: str | None,
    gain: str,
    train_months: list[int],
    trials: int,
    rounds: int,
    folds: int = 5,
    learning_rate: float = 0.1,
    sampling: float = 1.0,
    space: dict | None = None,
    seed: int = 42,
    mask: bool = False,
    every: int = 1,
    parallelism: int = 1,
    patience: int | None = None,
) -> DataFrame:
    """Random search; returns the trials table.

    The objective is the mean fold gain times the folds, per train month. A trial carries its
    parameters, the best round, the months, the seed and the sampling share. With `mask` every
    trial also draws a random half of the features. With `patience` a trial's rounds end when its best mean gain lies
    so many rounds back; `rounds` is then the most it may fit.
    """
    spark = df.sparkSession
    keep = [id_col, target, gain] + ([weight] if weight else [])
    shared = None if mask else with_folds(df, features, keep, id_col, target, folds, seed)
    out = []
    for number, params in enumerate(random_params(space or SEARCH_SPACE, trials, seed)):
        used = random_mask(features, seed + number) if mask else features
        rows = shared if shared is not None else with_folds(
            df, used, keep, id_col, target, folds, seed
        )
        if patience is None:
            curve = cv_curve(
                rows, id_col, target, weight, gain, rounds, folds, learning_rate, params, seed + number,
                every, parallelism,
            )
        else:
            curve = cv_until_stopped(
                rows, id_col, target, weight, gain, rounds, folds, learning_rate, params, seed + number,
                patience, min(patience, 10), parallelism,
            )
        value, iteration = trial_values(curve, folds, len(train_months)).first()
        out.append(
            (
                number,
                value,
                "COMPLETE",
                {k: float(v) for k, v in params.items()},
                iteration,
                train_months,
                seed + number,
                float(sampling),
                used,
            )
        )
    return spark.createDataFrame(
        out,
        "number int, value double, state string, params map<string,double>, best_iter int,"
        " train_months array<int>, seed int, sampling double, features array<string>",
    )


def compare_targets(
    df: DataFrame,
    features: list[str],
    id_col: str,
    targets: list[str],
    weight: str | None,
    gain: str,
    rounds: int,
    folds: int = 5,
    learning_rate: float = 0.1,
    params: dict | None = None,
    seed: int = 42,
) -> DataFrame:
    """Mean gain (times the folds) after every round, one column per target definition."""
    keep = [id_col, gain, *targets] + ([weight] if weight else [])
    curves = {}
    for target in targets:
        rows = with_folds(df, features, keep, id_col, target, folds, seed)
        curves[target] = cv_curve(
            rows, id_col, target, weight, gain, rounds, folds, learning_rate, params, seed
        )
    return beside(curves, folds)


def backtest(
    spark: SparkSession,
    train: DataFrame,
    test: DataFrame,
    id_col: str,
    target: str,
    weight: str | None,
    label: str,
    gain: str,
    plan: DataFrame,
    trials: dict[int, dict],
    path: str,
    learning_rate: float = 0.1,
    parallelism: int = 1,
) -> None:
    """Train every pending (trial, seed) of the plan and append its cut-point rows.

    `train` and `test` are assembled; `trials` maps a trial number to its parameters and
    `best_iter`. Runs whose output exists are skipped, so a broken backtest goes on where it
    stopped. The plan has one row per model to train; `parallelism` of them run at a time.
    """
    done = finished_runs(spark, path, RUN, "study string, trial int, seed int, month int")
    todo = pending_runs(plan, done, RUN).orderBy(*RUN)

    def one(run) -> None:
        chosen = trials[run["trial"]]
        model = fit_boosted(
            train,
            target,
            weight,
            chosen["best_iter"],
            learning_rate,
            chosen["params"],
            run["seed"],
        )
        scores = stored(predict(model, test, [id_col, label, gain], "y_pred_lgm"), "scores")
        sided = stratified_split(scores, id_col, label, 0.3, run["seed"])
        curve = public_private_curve(sided, "y_pred_lgm", id_col, gain, "side")
        rows = curve.select(
            id_col,
            F.col(gain).alias("ganancia"),
            "y_pred_lgm",
            "public",
            "private",
            "nro_envios",
            "public_cum",
            "private_cum",
            *[F.lit(run[k]).alias(k) for k in RUN],
        )
        write_cut_points(rows, path)

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(one, todo.collect()))


def submissions(
    train: DataFrame,
    test: DataFrame,
    id_col: str,
    target: str,
    weight: str | None,
    trials: dict[int, dict],
    seeds: list[int],
    cutoffs: list[int],
    path: str,
    learning_rate: float = 0.1,
) -> None:
    """Train every trial with every seed, score the test rows and write all cut-offs.

    The scores of all models are written once; every cut-off of every model then comes from one
    job. Submission files are partitioned by trial, seed and cut-off.
    """
    parts = []
    for number, chosen in trials.items():
        for seed in seeds:
            model = fit_boosted(
                train, target, weight, chosen["best_iter"], learning_rate, chosen["params"], seed
            )
            scores = predict(model, test, [id_col], "Prob")
            parts.append(scores.select("*", F.lit(number).alias("trial"), F.lit(seed).alias("seed")))
    scores = stored(reduce(DataFrame.unionByName, parts), "scores")
    rows = cutoff_submissions(scores, "Prob", id_col, cutoffs, ["trial", "seed"])
    write_submissions(rows, path, ["trial", "seed"])
