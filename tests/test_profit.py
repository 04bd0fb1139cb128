import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import row_gain
from cohortlens.operators import profit as G


def four(spark):
    rows = [(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.1, 0)]
    df = spark.createDataFrame(rows, "id long, score double, hit int")
    return df.withColumn("gain", row_gain(F.col("hit") == 1))


def test_curve(spark):
    out = G.gain_curve(four(spark), "score", "id", "gain").orderBy("nro_envios").collect()
    assert [(r["id"], r["nro_envios"], r["n_sent"], r["gain_cum"]) for r in out] == [
        (1, 0, 1, 273000),
        (2, 1, 2, 266000),
        (3, 2, 3, 539000),
        (4, 3, 4, 532000),
    ]


def test_best_cutoff_and_max(spark):
    curve = G.gain_curve(four(spark), "score", "id", "gain")
    assert tuple(G.best_cutoff(curve, "gain_cum").first()) == (539000, 2)
    assert G.gain_max(four(spark), "score", "id", "gain").first()[0] == 539000


def test_best_cutoff_takes_the_first_of_equal_peaks(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 1, 7), ("a", 2, 7), ("b", 0, 1)], "g string, nro_envios int, v int")
    got = sorted(map(tuple, G.best_cutoff(df, "v", ["g"]).collect()))
    assert got == [("a", 7, 1), ("b", 1, 0)]


def test_public_and_private_sides_are_scaled(spark):
    df = four(spark).withColumn("side", F.when(F.col("id") <= 2, "public").otherwise("private"))
    out = G.public_private_curve(df, "score", "id", "gain", "side").orderBy("nro_envios").collect()
    assert [r["public_cum"] for r in out] == pytest.approx([273000 / 0.3, 266000 / 0.3, 266000 / 0.3, 266000 / 0.3])
    assert [r["private_cum"] for r in out] == pytest.approx([0, 0, 273000 / 0.7, 266000 / 0.7])
    assert [r["private"] for r in out] == pytest.approx([0, 0, 273000 / 0.7, -7000 / 0.7])


def test_threshold(spark):
    assert G.gain_at_threshold(four(spark), "score", "gain", 0.5, 0.5).first()[0] == 539000 / 0.5


def test_windows_and_grid(spark):
    curve = spark.range(20).select(F.col("id").alias("nro_envios"))
    assert [r[0] for r in G.curve_window(curve, 4, 7).orderBy("nro_envios").collect()] == [5, 6]
    assert [r[0] for r in G.on_grid(curve, 4, 3, 2).orderBy("nro_envios").collect()] == [4, 7, 10]


def test_cutoffs(spark):
    out = G.cutoff_submissions(four(spark), "score", "id", [0, 1, 2, 50])
    got = {}
    for r in out.collect():
        got.setdefault(r["n_envios"], set()).update({r["id"]} if r["Predicted"] else set())
    assert got == {0: set(), 1: {1}, 2: {1, 2}, 50: {1, 2, 3, 4}}


def test_cutoffs_per_group(spark):
    a = four(spark).withColumn("seed", F.lit(1))
    b = four(spark).withColumns({"seed": F.lit(2), "score": -F.col("score")})
    out = G.cutoff_submissions(a.unionByName(b), "score", "id", [1, 3], ["seed"])
    got = {}
    for r in out.where("Predicted = 1").collect():
        got.setdefault((r["seed"], r["n_envios"]), set()).add(r["id"])
    assert got == {(1, 1): {1}, (1, 3): {1, 2, 3}, (2, 1): {4}, (2, 3): {4, 2, 3}}


def test_curves_per_group(spark):
    a = four(spark).withColumn("seed", F.lit(1))
    both = a.unionByName(a.withColumn("seed", F.lit(2)))
    out = G.gain_max(both, "score", "id", "gain", ["seed"])
    assert sorted(map(tuple, out.collect())) == [(1, 539000), (2, 539000)]


def test_curve_sorts_in_buckets_not_in_one_task(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 97 as double) as score", "cast(1 as bigint) as gain")
    plan = G.gain_curve(df, "score", "id", "gain")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(_b0" in plan


def test_peak_equals_the_curve(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice(["a", "b", None]), rng.choice([0.1, 0.2, 0.3, None, rng.random()]), i, rng.choice([-7, 273, 0, None, -7, -7]))
        for i in range(400)
    ]
    rows += [("down", 1.0 / (i + 1), 1000 + i, -5) for i in range(30)] + [("flat", 0.5, 2000 + i, 0) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, score double, id long, gain long")
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        sums, at = [], 0
        for r in own:
            at += r[3] or 0
            sums.append(at)
        want[g] = (max(sums), sums.index(max(sums)))
    got = {r[0]: (r[1], r[2]) for r in G.best_contact(df, "score", "id", "gain", ["g"]).collect()}
    assert got == want
    assert {r[0]: r[1] for r in G.gain_max(df, "score", "id", "gain", ["g"]).collect()} == {g: v for g, (v, _) in want.items()}
    assert G.best_contact(df.limit(0), "score", "id", "gain", ["g"]).collect() == []


def test_peak_moves_few_rows(spark):
    """Hits fade with the score: only buckets near the peak are sorted."""
    from cohortlens.operators import ordering

    df = spark.range(20_000).select(
        "id", (-F.col("id") / 20_000).alias("score"), F.when(F.pmod(F.hash("id"), F.lit(100)) < 40 - F.col("id") / 200, 40).otherwise(-7).cast("long").alias("gain")
    )
    with ordering.small_buckets(8, 500):
        _, _, kept = ordering.peak_buckets(df, -F.col("score"), F.col("id"), F.col("gain"))
        assert kept.agg(F.sum("_n")).first()[0] < 6_000
        curve = G.gain_curve(df, "score", "id", "gain")
        assert tuple(G.best_contact(df, "score", "id", "gain").first()) == tuple(G.best_cutoff(curve, "gain_cum").first())
