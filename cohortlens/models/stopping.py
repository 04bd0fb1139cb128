"""Boosting that goes on from its last margins and ends when the gain on held-out rows stops growing.

Every row carries the margin of each fold's model. A round fits one regression tree per fold on the gradient of the
logistic loss at those margins (the trees, their weights and seeds are those of the boosted classifier) and adds it. After
every few rounds the margins are checkpointed, so the plan stays short, and the gains of the new rounds are
measured on the rows that each fold's model has not seen.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.models.trees import tree_params
from cohortlens.operators.profit import gain_max
from cohortlens.session import shared_dir, stored

MARGINS, HELD = "_margins", "_held"


def patience_of(learning_rate: float) -> int:
    """Fixed rule: rounds without a better gain after which a search stops."""
    return int(100 + 5 / learning_rate)


def round_gains(scores: DataFrame, score: str, id_col: str, gain: str, keys: list[str]) -> DataFrame:
    """Highest gain of every round (and fold, target, ...) of given held-out scores, as `gain_max`."""
    return gain_max(scores, score, id_col, gain, keys)


def mean_curve(gains: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean and deviation over the folds of every round."""
    return gains.groupBy(*keys, "iteration").agg(
        F.avg("gain_max").alias("gain_mean"), F.stddev_samp("gain_max").alias("gain_std")
    )


def stopped(curve: DataFrame, patience: int, keys: list[str] = ()) -> DataFrame:
    """Where a search over the rounds ends: best_iter (first arg-max), its gain_mean, and the last round tried.

    A round is not tried if the best one before it lies `patience` rounds back or more. `curve` has one row for
    each round of a key.
    """
    keys = list(keys)
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("iteration")
    here = F.struct(F.col("gain_mean").alias("v"), (-F.col("iteration")).alias("i"))
    best = F.max(here).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    tried = curve.withColumn("_best", best)
    tried = tried.where(F.col("_best").isNull() | (F.col("iteration") - 1 + F.col("_best.i") < patience))
    # Rounds after the first gap belong to no search.
    tried = tried.withColumn("_at", F.row_number().over(upto)).withColumn("_first", F.min("iteration").over(upto))
    tried = tried.where(F.col("iteration") - F.col("_first") == F.col("_at") - 1)
    found = tried.groupBy(*keys).agg(F.max(here).alias("_top"), F.max("iteration").alias("last_iter"))
    return found.select(*keys, (-F.col("_top.i")).alias("best_iter"), F.col("_top.v").alias("gain_mean"), "last_iter")


def _fit_tree(rows: DataFrame, fold: int, target: str, weight: str | None, params: dict, seed: int, first: bool):
    sign = 2 * F.col(target).cast("double") - 1
    margin = F.get(MARGINS, F.lit(fold))
    residual = sign if first else 4 * sign / (1 + F.exp(2 * sign * margin))
    seen = rows.where(F.col("fold") != fold).withColumn("_residual", residual)
    tree = RandomForestRegressor(
        featuresCol="features", labelCol="_residual", predictionCol="_add", numTrees=1, bootstrap=False, seed=seed,
        **{"featureSubsetStrategy": "all", **tree_params(params)},
    )
    return (tree.setWeightCol(weight) if weight else tree).fit(seen)


def _advanced(rows: DataFrame, models: list[RandomForestRegressionModel], rate: float) -> DataFrame:
    """The margins after one more tree of every fold."""
    names = [f"_add{k}" for k in range(len(models))]
    columns = rows.columns
    for name, model in zip(names, models):
        rows = model.setPredictionCol(name).transform(rows)
    added = F.array(*[F.get(MARGINS, F.lit(k)) + rate * F.col(n) for k, n in enumerate(names)])
    rows = rows.withColumn(MARGINS, added)
    rows = rows.withColumn(HELD, F.array_append(HELD, F.get(MARGINS, F.col("fold"))))
    return rows.select(*columns)


def cv_until_stopped(
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
    patience: int | None = None,
    step: int = 10,
    parallelism: int = 1,
) -> DataFrame:
    """Mean and deviation over the folds of the highest gain after every round, up to the round that ends the search.

    `rows` are assembled and carry a `fold` column. All folds advance together, `step` rounds between two
    measurements, and stop when the best mean gain lies `patience` rounds back (the rule of `patience_of`, if
    None) or after `rounds`. At most `step` - 1 rounds more are fitted than the curve returns.
    """
    patience = patience_of(learning_rate) if patience is None else patience
    spark = rows.sparkSession
    shared_dir(spark)
    keep = [id_col, target, gain, "fold", "features"] + ([weight] if weight else [])
    state = rows.select(*dict.fromkeys(keep)).withColumns(
        {MARGINS: F.array_repeat(F.lit(0.0), folds), HELD: F.array().cast("array<double>")}
    )
    curve: list[tuple] = []
    while len(curve) < rounds:
        done, more = len(curve), min(step, rounds - len(curve))
        for i in range(done, done + more):

            def one(k: int, state=state, i=i):
                return _fit_tree(state, k, target, weight, params or {}, seed + i, i == 0)

            with ThreadPoolExecutor(parallelism) as pool:
                models = list(pool.map(one, range(folds)))
            state = _advanced(state, models, 1.0 if i == 0 else learning_rate)
        state = state.checkpoint()
        scores = state.select(id_col, gain, "fold", F.posexplode(HELD).alias("_place", "margin")).select(
            id_col, gain, "fold", "margin", (F.col("_place") + 1 + done).alias("iteration")
        )
        found = mean_curve(round_gains(scores, "margin", id_col, gain, ["fold", "iteration"]))
        curve += [tuple(r) for r in found.orderBy("iteration").collect()]  # `step` rows
        state = state.withColumn(HELD, F.array().cast("array<double>"))
        end = next((t for t in range(1, len(curve) + 1) if t - _best(curve[:t]) >= patience), None)
        if end is not None:
            curve = curve[:end]
            break
    return stored(spark.createDataFrame(curve, "iteration int, gain_mean double, gain_std double"), "cv-curve")


def _best(curve: list[tuple]) -> int:
    """First round with the highest mean gain."""
    return max(curve, key=lambda r: (r[1], -r[0]))[0]
