"""Model queries on the labelled panel; SQL states what is exact in their results (`*_facts`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import LEAVES_SECOND, row_gain
from cohortlens.models import search as M
from cohortlens.models import stopping as ST
from cohortlens.models import trees as T
from cohortlens.operators import evaluate as E
from cohortlens.operators import profit as G
from cohortlens.operators.features import class_targets
from cohortlens.operators.impute import impute_rules
from cohortlens.operators.panel import lag_features
from cohortlens.plans.analogs import ID, LABEL, LABELLED, MEASURES, PANEL, PERIOD, key_sql, labelled, with_
from cohortlens.plans.registry import query
from cohortlens.session import scratch_path, stored
from cohortlens.sources.curves import read_cut_points

FEATURES = MEASURES + [f"lag{k}_{c}" for k in (1, 2) for c in MEASURES]
SPLIT = 200001
ROUNDS = 4
PARAMS = {"num_leaves": 8, "min_data_in_leaf": 20, "bagging_fraction": 0.8}
KEEP = ["id", PERIOD, LABEL, "gain", "clase_peso", "clase_binaria1", "clase_binaria2"]


def training_rows(spark, sf) -> DataFrame:
    """Labelled panel with lags, sentinels for nulls, targets, weight and gain."""
    rows = lag_features(labelled(spark, sf), MEASURES, ID, PERIOD, keep=[*MEASURES, LABEL])
    rows = class_targets(rows, LABEL)
    rows = rows.withColumns(
        {
            "id": F.col(ID) * 1_000_000 + F.col(PERIOD),
            LABEL: F.coalesce(LABEL, F.lit("none")),
            "gain": row_gain(F.col(LABEL).eqNullSafe(LEAVES_SECOND)),
        }
    )
    return impute_rules(rows, {c: -1 for c in MEASURES})


def assembled(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Train rows before the split month and all rows from it on."""
    rows = stored(T.assemble(training_rows(spark, sf), FEATURES, KEEP), "assembled")
    return rows.where(F.col(PERIOD) < SPLIT), rows.where(F.col(PERIOD) >= SPLIT)


@query("gbt_scores")
def gbt_scores(spark, sf):
    train, test = assembled(spark, sf)
    model = T.fit_boosted(train, "clase_binaria2", "clase_peso", ROUNDS, 0.3, PARAMS)
    return T.predict(model, test, ["id", LABEL])


@query("feature_importance")
def feature_importance(spark, sf):
    train, _ = assembled(spark, sf)
    parts = [
        T.importances(
            spark,
            T.fit_boosted(train, "clase_binaria2", "clase_peso", ROUNDS, 0.3, PARAMS, seed),
            FEATURES,
            i,
        )
        for i, seed in enumerate((17, 19))
    ]
    both = parts[0].unionByName(parts[1])
    return E.importance_mean(both, "fname_model", "fimportance_model")


@query("model_gain_compare")
def model_gain_compare(spark, sf):
    train, test = assembled(spark, sf)
    keep = ["id", "gain"]
    boosted = T.fit_boosted(train, "clase_binaria2", "clase_peso", ROUNDS, 0.3, PARAMS)
    forest = T.fit_forest(train, "clase_binaria2", "clase_peso", 5, {"num_leaves": 16})
    scores = T.predict(boosted, test, keep).withColumn("model", F.lit("boosted")).unionByName(
        T.predict(forest, test, keep).withColumn("model", F.lit("forest"))
    )
    return G.gain_at_threshold(scores, "pred", "gain", groups=["model"])


@query("cv_gain")
def cv_gain(spark, sf):
    train, _ = assembled_rows(spark, sf)
    rows = M.with_folds(train, FEATURES, _SEARCH_KEEP, "id", LABEL, 3, 42)
    return M.cv_curve(rows, "id", "clase_binaria2", "clase_peso", "gain", ROUNDS, 3, 0.3, PARAMS)


_SEARCH_KEEP = ["id", "gain", "clase_peso", "clase_binaria1", "clase_binaria2"]


def assembled_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = stored(training_rows(spark, sf), "training")
    return rows.where(F.col(PERIOD) < SPLIT), rows.where(F.col(PERIOD) >= SPLIT)


def _trials(spark, sf, train) -> DataFrame:
    months = [r[0] for r in train.select(PERIOD).distinct().orderBy(PERIOD).collect()]
    space = {
        "num_leaves": (4, 16, int),
        "min_data_in_leaf": (5, 50, int),
        "feature_fraction": (0.4, 0.9, float),
        "bagging_fraction": (0.5, 0.9, float),
    }
    return M.search(
        train, FEATURES, "id", "clase_binaria2", "clase_peso", "gain", months,
        trials=2, rounds=3, folds=2, learning_rate=0.3, space=space,
    )


@query("trial_table")
def trial_table(spark, sf):
    train, _ = assembled_rows(spark, sf)
    return _trials(spark, sf, train)


@query("target_comparison")
def target_comparison(spark, sf):
    train, _ = assembled_rows(spark, sf)
    return M.compare_targets(
        train, FEATURES, "id", ["clase_binaria1", "clase_binaria2"], "clase_peso", "gain",
        rounds=3, folds=2, learning_rate=0.3, params=PARAMS,
    )


@query("backtest_cutpoints")
def backtest_cutpoints(spark, sf):
    train, test = assembled(spark, sf)
    trials = {
        0: {"params": PARAMS, "best_iter": 2},
        1: {"params": {"num_leaves": 4, "min_data_in_leaf": 10}, "best_iter": 3},
    }
    numbers = spark.createDataFrame([(n,) for n in trials], "number int")
    plan = E.plan_runs(numbers, "number", [17], [SPLIT], "exp")
    path = scratch_path(spark, "backtest")
    M.backtest(
        spark, train, test, "id", "clase_binaria2", "clase_peso", LABEL, "gain", plan, trials, path, 0.3
    )
    return read_cut_points(spark, path)


@query("model_submissions")
def model_submissions(spark, sf):
    train, test = assembled(spark, sf)
    path = scratch_path(spark, "submissions")
    trials = {0: {"params": PARAMS, "best_iter": 2}}
    M.submissions(
        train, test, "id", "clase_binaria2", "clase_peso", trials, [17, 18], [500, 1000, 2000], path, 0.3
    )
    return spark.read.csv(
        path, header=True, schema="id bigint, Predicted int, trial int, seed int, n_envios bigint"
    )


_ROWS = LABELLED + f""",
test_rows AS (SELECT cust * 1000000 + period AS id, coalesce(label, 'none') AS label,
                     CAST(CASE WHEN label = 'BAJA+2' THEN 273000 ELSE -7000 END AS BIGINT) AS gain
              FROM labelled WHERE period >= {SPLIT})"""


@query("gbt_scores_facts", with_(_ROWS, "SELECT id, label, true AS is_probability FROM test_rows"))
def gbt_scores_facts(spark, sf):
    return gbt_scores(spark, sf).select("id", LABEL, F.col("pred").between(0, 1).alias("is_probability"))


@query(
    "feature_importance_facts",
    "SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS fname, CAST(1 AS DOUBLE) AS total",
)
def feature_importance_facts(spark, sf):
    found = feature_importance(spark, sf)
    total = found.agg(F.round(F.sum("importance"), 6).alias("total"))
    return found.select(F.col("fname_model").alias("fname")).join(total)


@query(
    "backtest_facts",
    with_(
        _ROWS,
        """SELECT trial, seed, count(*) AS n_rows,
                  CAST(sum(public) AS BIGINT) AS n_public, CAST(sum(gain) AS BIGINT) AS gain
           FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY seed, label ORDER BY """
        + key_sql("id", "seed")
        + """, id) <= round_even(count(*) OVER (PARTITION BY seed, label) * 0.3, 0) THEN 1 ELSE 0 END AS public
                 FROM test_rows, (SELECT unnest([17, 18]) AS seed)), (SELECT unnest([0, 1]) AS trial)
           GROUP BY trial, seed""",
    ),
)
def backtest_facts(spark, sf):
    rows = backtest_cutpoints(spark, sf)
    return rows.groupBy("trial", "seed").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum((F.col("public") != 0).cast("long")).alias("n_public"),
        F.sum("ganancia").cast("long").alias("gain"),
    )


@query(
    "submission_facts",
    with_(
        _ROWS,
        """SELECT 0 AS trial, seed, n_envios, count(*) AS n_rows, least(n_envios, count(*)) AS n_predicted
           FROM test_rows, (SELECT unnest([17, 18]) AS seed), (SELECT unnest([500, 1000, 2000]) AS n_envios)
           GROUP BY seed, n_envios""",
    ),
)
def submission_facts(spark, sf):
    rows = model_submissions(spark, sf)
    return rows.groupBy("trial", "seed", "n_envios").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("Predicted").alias("n_predicted")
    )


# Held-out scores as a model might give them, from plain arithmetic, so that SQL can state what follows from scores:
# they rank the hits best at round 4, or 6 for the second target and odd trials.
_FOLDS, _TRIED, _PATIENCE, _MONTHS = 3, 10, 2, 6
_HELD_OUT = _ROWS + f""",
held AS (
  SELECT id, gain, id % {_FOLDS} AS fold, iteration, trial,
         CAST((id * (7919 + 104729 * iteration + 15485863 * trial)) % 1000003
              + CASE WHEN gain > 0 THEN 60000 * (6 - abs(iteration - 4 - 2 * trial)) ELSE 0 END AS DOUBLE) AS margin
  FROM test_rows, (SELECT unnest(range(1, {_TRIED + 1})) AS iteration), (SELECT unnest([0, 1]) AS trial)
),
gains AS (
  SELECT trial, fold, iteration, max(g) AS gain_max
  FROM (SELECT trial, fold, iteration, CAST(sum(gain) OVER (PARTITION BY trial, fold, iteration
               ORDER BY margin DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM held)
  GROUP BY trial, fold, iteration
),
curve AS (
  SELECT trial, iteration, avg(gain_max) AS gain_mean, stddev_samp(gain_max) AS gain_std
  FROM gains GROUP BY trial, iteration
)"""


def held_out_scores(spark, sf) -> DataFrame:
    rows = training_rows(spark, sf).where(F.col(PERIOD) >= SPLIT).select("id", "gain")
    rows = stored(rows, "test-rows")
    numbers = F.explode(F.sequence(F.lit(1), F.lit(_TRIED))).alias("iteration")
    rows = rows.select("*", numbers).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("trial"))
    return with_margins(rows)


def with_margins(rows: DataFrame) -> DataFrame:
    """Fold and margin of every row, iteration and trial."""
    # Both factors are reduced first: the product of large ids would not fit a long.
    factor = 7919 + 104729 * F.col("iteration").cast("long") + 15485863 * F.col("trial").cast("long")
    noise = (F.col("id") % 1000003) * (factor % 1000003) % 1000003
    found = F.when(F.col("gain") > 0, 60000 * (6 - F.abs(F.col("iteration") - 4 - 2 * F.col("trial")))).otherwise(0)
    return rows.select("id", "gain", "trial", "iteration", (F.col("id") % _FOLDS).alias("fold"),
                       (noise + found).cast("double").alias("margin"))


def held_out_curve(spark, sf) -> DataFrame:
    gains = ST.round_gains(held_out_scores(spark, sf), "margin", "id", "gain", ["trial", "fold", "iteration"])
    return stored(ST.mean_curve(gains, ["trial"]), "curve")


@query(
    "cv_gain_of_scores",
    with_(_HELD_OUT, "SELECT trial, iteration, round(gain_mean, 4) AS gain_mean, round(gain_std, 4) AS gain_std FROM curve"),
)
def cv_gain_of_scores(spark, sf):
    """Everything of a cross-validation that follows the scores: gain by fold and round, mean and deviation."""
    rounded = {c: F.round(c, 4) for c in ("gain_mean", "gain_std")}
    return held_out_curve(spark, sf).withColumns(rounded)


@query(
    "stopping_of_scores",
    with_(
        _HELD_OUT
        + f""",
best AS (
  SELECT *, (SELECT arg_min(b.iteration, -b.gain_mean * 1000 + b.iteration) FROM curve b
             WHERE b.trial = c.trial AND b.iteration <= c.iteration) AS top FROM curve c
),
ends AS (
  SELECT trial, coalesce(min(iteration) FILTER (iteration - top >= {_PATIENCE}), max(iteration)) AS last_iter
  FROM best GROUP BY trial
)""",
        """SELECT trial, CAST(b.top AS INTEGER) AS best_iter, CAST(last_iter AS INTEGER) AS last_iter,
                  round((SELECT gain_mean FROM curve c WHERE c.trial = b.trial AND c.iteration = b.top), 4) AS gain_mean
           FROM ends JOIN best b USING (trial) WHERE b.iteration = last_iter""",
    ),
)
def stopping_of_scores(spark, sf):
    """Where early stopping ends the rounds, and the best round up to there."""
    found = ST.stopped(held_out_curve(spark, sf), _PATIENCE, ["trial"])
    return found.withColumn("gain_mean", F.round("gain_mean", 4))


@query(
    "trial_values_of_scores",
    with_(
        _HELD_OUT,
        f"""SELECT trial, round(max(gain_mean) * {_FOLDS} / {_MONTHS}, 4) AS value,
                   CAST(arg_min(iteration, -gain_mean * 1000 + iteration) AS INTEGER) AS best_iter
            FROM curve GROUP BY trial""",
    ),
)
def trial_values_of_scores(spark, sf):
    """Objective and best round of every trial."""
    found = M.trial_values(held_out_curve(spark, sf), _FOLDS, _MONTHS, ["trial"])
    return found.withColumn("value", F.round("value", 4))


@query(
    "target_comparison_of_scores",
    with_(
        _HELD_OUT,
        f"""SELECT iteration, round(max(gain_mean) FILTER (trial = 0) * {_FOLDS}, 4) AS clase_binaria1,
                   round(max(gain_mean) FILTER (trial = 1) * {_FOLDS}, 4) AS clase_binaria2
            FROM curve GROUP BY iteration""",
    ),
)
def target_comparison_of_scores(spark, sf):
    """Mean gain of two targets side by side."""
    curve = held_out_curve(spark, sf)
    names = ("clase_binaria1", "clase_binaria2")
    out = M.beside({n: curve.where(F.col("trial") == i) for i, n in enumerate(names)}, _FOLDS)
    return out.withColumns({n: F.round(n, 4) for n in names})


@query(
    "model_gain_of_scores",
    with_(
        _HELD_OUT,
        """SELECT trial AS model, CAST(sum(CASE WHEN margin / CAST(40000000 AS DOUBLE) >= CAST(0.025 AS DOUBLE)
                    THEN gain ELSE 0 END) AS DOUBLE) AS gain
           FROM held WHERE iteration = 4 GROUP BY trial""",
    ),
)
def model_gain_of_scores(spark, sf):
    """Gain of two models' scores at the fixed threshold."""
    scores = held_out_scores(spark, sf).where("iteration = 4")
    scores = scores.select(F.col("trial").alias("model"), "gain", (F.col("margin") / 40000000).alias("pred"))
    return G.gain_at_threshold(scores, "pred", "gain", groups=["model"])


@query("early_stopping")
def early_stopping(spark, sf):
    """A search that ends by itself: the mean gain of its rounds."""
    train, _ = assembled_rows(spark, sf)
    rows = M.with_folds(train, FEATURES, _SEARCH_KEEP, "id", LABEL, 3, 42)
    return ST.cv_until_stopped(
        rows, "id", "clase_binaria2", "clase_peso", "gain", 8, 3, 0.3, PARAMS, patience=2, step=2, parallelism=3
    )


@query("split_counts")
def split_counts(spark, sf):
    """Splits of every feature over two models, by depth."""
    train, _ = assembled(spark, sf)
    parts = [
        T.split_counts(
            T.fit_boosted(train, "clase_binaria2", "clase_peso", ROUNDS, 0.3, PARAMS, seed), FEATURES, spark, i, by_depth=True
        )
        for i, seed in enumerate((17, 19))
    ]
    return parts[0].unionByName(parts[1])


# The nine of the fifteen columns that the mask of seed 42 keeps are written out here, apart from the code that draws it.
@query(
    "feature_mask",
    with_(
        PANEL,
        """SELECT period,
                  round(sum(CAST(spend AS DOUBLE)), 2) AS sum_spend, count(spend) AS n_spend,
                  round(sum(CAST(top_price AS DOUBLE)), 2) AS sum_top_price, count(top_price) AS n_top_price,
                  round(sum(CAST(n_filled AS DOUBLE)), 2) AS sum_n_filled, count(n_filled) AS n_n_filled,
                  round(sum(CAST(l1_top AS DOUBLE)), 2) AS sum_lag1_top_price, count(l1_top) AS n_lag1_top_price,
                  round(sum(CAST(l1_filled AS DOUBLE)), 2) AS sum_lag1_n_filled, count(l1_filled) AS n_lag1_n_filled,
                  round(sum(CAST(l1_urgent AS DOUBLE)), 2) AS sum_lag1_n_urgent, count(l1_urgent) AS n_lag1_n_urgent,
                  round(sum(CAST(l2_orders AS DOUBLE)), 2) AS sum_lag2_n_orders, count(l2_orders) AS n_lag2_n_orders,
                  round(sum(CAST(l2_top AS DOUBLE)), 2) AS sum_lag2_top_price, count(l2_top) AS n_lag2_top_price,
                  round(sum(CAST(l2_filled AS DOUBLE)), 2) AS sum_lag2_n_filled, count(l2_filled) AS n_lag2_n_filled
           FROM (SELECT *, lag(top_price) OVER w AS l1_top, lag(n_filled) OVER w AS l1_filled, lag(n_urgent) OVER w AS l1_urgent,
                        lag(n_orders, 2) OVER w AS l2_orders, lag(top_price, 2) OVER w AS l2_top,
                        lag(n_filled, 2) OVER w AS l2_filled
                 FROM panel WINDOW w AS (PARTITION BY cust ORDER BY period))
           GROUP BY period""",
    ),
)
def feature_mask(spark, sf):
    """Sum and count of every column that a random mask keeps, by period."""
    rows = lag_features(labelled(spark, sf), MEASURES, ID, PERIOD, keep=MEASURES)
    kept = rows.select(PERIOD, *M.random_mask(FEATURES, 42))
    columns = [c for c in kept.columns if c != PERIOD]
    sums = [F.round(F.sum(F.col(c).cast("double")), 2).alias(f"sum_{c}") for c in columns]
    return kept.groupBy(PERIOD).agg(*sums, *[F.count(c).alias(f"n_{c}") for c in columns])
