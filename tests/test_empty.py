"""Empty inputs give empty results."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import drift, evaluate, panel, profit, ranks, sampling


@pytest.fixture
def none(spark):
    schema = "id long, period int, label string, score double, gain long, side string, g string"
    return spark.createDataFrame([], schema)


@pytest.mark.parametrize(
    "run",
    [
        lambda d: panel.churn_label(d.drop("label"), "id", "period"),
        lambda d: panel.churn_label(d.drop("label"), "id", "period", calendar=True),
        lambda d: panel.lag_features(d, ["score"], "id", "period"),
        lambda d: panel.panel_presence(d, "id", "period"),
        lambda d: profit.gain_curve(d, "score", "id", "gain"),
        lambda d: profit.gain_curve(d, "score", "id", "gain", ["g"]),
        lambda d: profit.public_private_curve(d, "score", "id", "gain", "side"),
        lambda d: profit.cutoff_submissions(d, "score", "id", [1, 2]),
        lambda d: ranks.ntile_features(d, ["score"], "id", "period", 10),
        lambda d: ranks.rank_family(d, {"score": {"ordinal"}}, "id", "period"),
        lambda d: sampling.undersample(d, "id", "period", "label", 0.5),
        lambda d: sampling.stratified_split(d, "id", "label"),
        lambda d: sampling.kfold(d, "id", "label"),
        lambda d: sampling.repeated_splits(d, "id", "label", 3),
        lambda d: drift.psi(d, ["score"], "id", "period", [1], [2]),
        lambda d: drift.describe_numeric(d, ["score"], "id"),
        lambda d: drift.column_profile(d, ["score"]),
        lambda d: evaluate.wilcoxon(d.withColumn("b", F.col("score")), "score", "b", ["g"]),
        lambda d: profit.best_cutoff(profit.gain_curve(d, "score", "id", "gain"), "gain_cum", ["g"]),
    ],
)
def test_empty(none, run):
    assert run(none).count() == 0
