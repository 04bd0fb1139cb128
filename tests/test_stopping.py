"""Early stopping against the full run of the boosted classifier."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import row_gain
from cohortlens.models import search as M
from cohortlens.models import stopping as S
from cohortlens.models import trees as T

FEATURES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    part = lambda k: F.pmod(F.hash(F.col("id") + k), F.lit(100)) / 100
    df = spark.range(400).select("id", part(0).alias("a"), part(7).alias("b"), part(99).alias("noise"))
    # Nearly all can be learned at once; later rounds only learn the noise.
    hit = (F.col("a") + F.col("b") > 1.4) != (F.pmod(F.hash(F.col("id") + 3), F.lit(10)) == 0)
    df = df.select("*", hit.cast("int").alias("y"), F.lit(1.0).alias("w"), row_gain(hit).alias("gain"))
    ready = T.assemble(df, FEATURES, ["id", "y", "w", "gain"])
    return ready.withColumn("fold", F.pmod(F.hash(F.col("id") + 11), F.lit(2))).cache()


def test_stops_early_with_the_same_best_round(rows):
    params, rounds, patience = {"num_leaves": 4}, 9, 3
    full = M.cv_curve(rows, "id", "y", "w", "gain", rounds, 2, 0.5, params).orderBy("iteration").collect()
    short = S.cv_until_stopped(rows, "id", "y", "w", "gain", rounds, 2, 0.5, params, patience=patience, step=2)
    short = short.orderBy("iteration").collect()
    assert len(short) < rounds
    for a, b in zip(full, short):
        assert a["iteration"] == b["iteration"]
        assert b["gain_mean"] == pytest.approx(a["gain_mean"]) and b["gain_std"] == pytest.approx(a["gain_std"])
    best = max(full, key=lambda r: (r["gain_mean"], -r["iteration"]))["iteration"]
    assert max(short, key=lambda r: (r["gain_mean"], -r["iteration"]))["iteration"] == best
    assert len(short) == best + patience


def test_where_a_search_ends(spark):
    curves = {"a": [1, 5, 4, 3, 9], "b": [3, 3, 3, 3], "c": [1, 2, 3, 4], "d": [7]}
    data = [(k, i, float(v)) for k, vs in curves.items() for i, v in enumerate(vs, 1)]
    df = spark.createDataFrame(data, "k string, iteration int, gain_mean double")
    got = {r["k"]: (r["best_iter"], r["gain_mean"], r["last_iter"]) for r in S.stopped(df, 2, ["k"]).collect()}
    assert got == {"a": (2, 5.0, 4), "b": (1, 3.0, 3), "c": (4, 4.0, 4), "d": (1, 7.0, 1)}
    assert tuple(S.stopped(df.where("k = 'a'").drop("k"), 3).first()) == (5, 9.0, 5)
    assert S.patience_of(0.1) == 150 and S.patience_of(0.3) == 116
