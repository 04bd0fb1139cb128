import math

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import evaluate as E


def brute_wilcoxon(a, b):
    d = np.round(np.asarray(a) - np.asarray(b), 6)
    d = d[d != 0]
    r = pd.Series(np.abs(d)).rank().to_numpy()
    plus, minus = r[d > 0].sum(), r[d < 0].sum()
    n = len(d)
    t = pd.Series(np.abs(d)).value_counts().to_numpy().astype(float)
    se = math.sqrt((n * (n + 1) * (2 * n + 1) - (t**3 - t).sum() / 2) / 24)
    return n, plus, minus, min(plus, minus), (min(plus, minus) - n * (n + 1) / 4) / se


def test_wilcoxon_with_zeros_and_ties(spark):
    a = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    b = [1.0, 1.0, 4.0, 2.0, 3.0, 9.0, 7.0, 8.5]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    got = E.wilcoxon(df, "a", "b").first()
    assert tuple(got)[:5] == pytest.approx(brute_wilcoxon(a, b))


def test_wilcoxon_groups_and_p_value(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(x), float(x + y)) for g in (1, 2) for x, y in zip(rng.integers(0, 50, 300), rng.normal(0.1 * g, 1, 300).round(1))]
    df = spark.createDataFrame(rows, "trial int, a double, b double")
    out = E.wilcoxon(df, "a", "b", ["trial"])
    for r in out.collect():
        part = [(x, y) for t, x, y in rows if t == r["trial"]]
        want = brute_wilcoxon(*zip(*part))
        assert tuple(r)[1:6] == pytest.approx(want)
        assert r["p_value"] == pytest.approx(math.erfc(abs(want[4]) / math.sqrt(2)), rel=1e-6)


def test_band_over_seeds(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, 5.0)], "nro_envios int, v double")
    out = E.seed_band(df, "v", []).orderBy("nro_envios").collect()
    assert [(r["mean"], r["std"]) for r in out] == [(2.0, pytest.approx(math.sqrt(2))), (5.0, 0.0)]
    whole = E.seed_band(df, "v", [], whole_curve=True).collect()
    assert [r["std"] for r in whole] == [pytest.approx(np.std([2, 5], ddof=1))] * 2


def test_band_of_many_rows_has_tasks_for_them(spark, monkeypatch):
    """Whatever the number of shuffle partitions is."""
    monkeypatch.setattr(E, "TASK_ROWS", 100)
    df = spark.range(2400).selectExpr("id % 3 AS trial", "id div 6 AS nro_envios", "double(hash(id)) AS v")
    out = E.seed_band(df, "v", ["trial"], rows=2400)
    assert out.rdd.getNumPartitions() == 24
    want = {tuple(r) for r in E.seed_band(df, "v", ["trial"]).select("trial", "nro_envios", "mean").collect()}
    assert {tuple(r) for r in out.select("trial", "nro_envios", "mean").collect()} == want and len(want) == 1200


def test_importances_are_averaged_over_all_models(spark):
    df = spark.createDataFrame([("a", 10, 0), ("a", 20, 1), ("lag1_a", 0, 0), ("b", 3, 0)], "f string, v int, model int")
    mean = E.importance_mean(df, "f", "v")
    got = {r["f"]: (r["importance"], r["root"]) for r in mean.collect()}
    assert got == {"a": (15.0, "a"), "lag1_a": (0.0, "a"), "b": (3.0, "b")}
    assert {r["f"] for r in E.below_log_importance(mean, 2).collect()} == {"lag1_a", "b"}
    assert [r[0] for r in E.bottom_features(mean, "f", 2).collect()] == ["lag1_a", "b"]
    assert [r["f"] for r in E.top_features(mean, "f", 5).collect()] == ["a", "b"]
    assert {tuple(r) for r in E.importance_by_root(mean).collect()} == {("a", 15.0, 2), ("b", 3.0, 1)}


def test_drop_features_ignores_unknown_names(spark):
    df = spark.range(1).selectExpr("1 as a", "2 as b")
    listed = spark.createDataFrame([("b",), ("zz",)], "fname string")
    assert E.drop_features(df, listed).columns == ["a"]


def test_top_trials_only_completed(spark):
    rows = [(0, 5.0, "COMPLETE"), (1, 9.0, "FAIL"), (2, 5.0, "COMPLETE"), (3, 7.0, "COMPLETE")]
    df = spark.createDataFrame(rows, "number int, value double, state string")
    assert [r["number"] for r in E.top_trials(df, 2).collect()] == [3, 0]


def test_plan_and_pending(spark):
    trials = spark.createDataFrame([(4,)], "number int")
    plan = E.plan_runs(trials, "number", [17, 19], [202105], "e")
    assert sorted(r["seed"] for r in plan.collect()) == [17, 18, 19, 20]
    done = plan.where("seed = 18")
    left = E.pending_runs(plan, done, ["study", "trial", "seed", "month"])
    assert sorted(r["seed"] for r in left.collect()) == [17, 19, 20]


def board(spark):
    rows = [(1, 5.0, 1.0, 5.0, 2.0), (2, 1.0, 3.0, 2.0, 1.0)]
    return spark.createDataFrame(rows, "split int, rf_public double, rf_private double, gb_public double, gb_private double")


def test_leaderboard(spark):
    won = E.leaderboard_winner(board(spark), "split", ["rf_public", "gb_public"], ["rf_private", "gb_private"])
    got = {r["split"]: (r["best_public"], r["best_private"]) for r in won.collect()}
    assert got == {1: ("rf_public", "gb_private"), 2: ("gb_public", "rf_private")}
    table = E.crosstab(won, "best_public", "best_private", ["rf_private", "gb_private"])
    assert {tuple(r) for r in table.collect()} == {("rf_public", 0, 1), ("gb_public", 1, 0)}
    long = E.leaderboard_long(board(spark), "split", ["rf_public", "gb_private"])
    assert {tuple(r) for r in long.collect()} == {
        (1, "rf", "public", 5.0),
        (1, "gb", "private", 2.0),
        (2, "rf", "public", 1.0),
        (2, "gb", "private", 1.0),
    }
    bins = E.gain_histogram(long, "ganancia", ["modelo"], 0, 4, 4)
    assert {tuple(r) for r in bins.collect()} == {("rf", 5, 1), ("rf", 2, 1), ("gb", 3, 1), ("gb", 2, 1)}


def test_seed_mean(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 0, 4.0), (1, 1, 1.0)], "trial int, nro_envios int, v double")
    got = {tuple(r) for r in E.seed_mean_curve(df, ["v"], ["trial"]).collect()}
    assert got == {(1, 0, 3.0), (1, 1, 1.0)}


def test_exact_law_equals_all_sign_patterns(spark):
    import itertools

    law = {(n, w): p for n, w, p in E.signed_rank_law(12)}
    for n in range(1, 13):
        sums = [sum(i for i, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert law[n, w] == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / 2**n))
    a = [(g, float(i + 1) * (-1) ** (i * g % 3), 0.0) for g in (1, 2) for i in range(9)] + [(3, 2.0, 0.0), (3, -2.0, 0.0), (3, 1.0, 1.0)]
    df = spark.createDataFrame(a, "g int, a double, b double")
    got = {r["g"]: r for r in E.wilcoxon(df, "a", "b", ["g"]).collect()}
    for g in (1, 2):
        assert got[g]["p_value"] == pytest.approx(law[9, int(got[g]["statistic"])])
    # Ties: the normal approximation.
    assert got[3]["p_value"] == pytest.approx(math.erfc(abs(got[3]["z"]) / math.sqrt(2)), rel=1e-6)
    assert [r["p_value"] for r in E.wilcoxon(df, "a", "b", ["g"], method="approx").where("g = 1").collect()] != [got[1]["p_value"]]
