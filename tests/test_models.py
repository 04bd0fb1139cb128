import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from cohortlens.functions import row_gain
from cohortlens.models import search as M
from cohortlens.models import trees as T
from cohortlens.models.evaluator import GainEvaluator
from cohortlens.operators.evaluate import plan_runs
from cohortlens.operators.profit import gain_max
from cohortlens.operators.sampling import kfold
from cohortlens.sources.curves import read_cut_points
from cohortlens.sources.tables import finished_runs

FEATURES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id")
    df = spark.range(600).select(
        "id",
        (F.pmod(F.hash(x), F.lit(100)) / 100).alias("a"),
        (F.pmod(F.hash(x + 7), F.lit(100)) / 100).alias("b"),
        (F.pmod(F.hash(x + 99), F.lit(100)) / 100).alias("noise"),
    )
    hit = F.col("a") + F.col("b") > 1.5
    return df.select(
        "*", hit.cast("int").alias("y"), F.lit(1.0).alias("w"), row_gain(hit).alias("gain"),
        F.when(hit, "BAJA+2").otherwise("CONTINUA").alias("label"),
    ).cache()


def ready(rows, *more):
    return T.assemble(rows, FEATURES, ["id", "y", "w", "gain", "label", *more])


def test_scores_are_probabilities_and_repeatable(rows):
    train = ready(rows)
    first = T.predict(T.fit_boosted(train, "y", "w", 3, 0.3, seed=5), train, ["id", "gain"])
    second = T.predict(T.fit_boosted(train, "y", "w", 3, 0.3, seed=5), train, ["id", "gain"])
    assert first.count() == 600
    assert first.where("pred < 0 or pred > 1").count() == 0
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
    best = gain_max(first, "pred", "id", "gain").first()[0]
    assert best > 0.8 * rows.where("gain > 0").agg(F.sum("gain")).first()[0]


def test_last_round_equals_the_model(rows):
    train = ready(rows)
    model = T.fit_boosted(train, "y", "w", 3, 0.3)
    steps = T.scores_per_round(model, train, ["id"])
    assert steps.count() == 1800
    last = steps.where("iteration = 3").join(T.predict(model, train, ["id"]), "id")
    gap = F.abs(1 / (1 + F.exp(-2 * F.col("margin"))) - F.col("pred"))
    assert last.agg(F.max(gap)).first()[0] < 1e-9


def test_importances_cover_all_features(spark, rows):
    model = T.fit_forest(ready(rows), "y", "w", 4, {"num_leaves": 8})
    got = {r[0]: r[1] for r in T.importances(spark, model, FEATURES).collect()}
    assert set(got) == set(FEATURES) and sum(got.values()) == pytest.approx(1)
    assert min(got["a"], got["b"]) > got["noise"]


def test_tree_params():
    got = T.tree_params({"num_leaves": 500, "min_data_in_leaf": 50, "feature_fraction": 0.5, "bagging_fraction": 0.7})
    assert got == {"maxDepth": 9, "minInstancesPerNode": 50, "featureSubsetStrategy": "0.5", "subsamplingRate": 0.7}
    with pytest.raises(ValueError):
        T.tree_params({"num_leaves": 2**40})


def test_many_rounds_in_steps(rows):
    train = ready(rows)
    model = T.fit_boosted(train, "y", "w", 60, 0.3, {"num_leaves": 4})
    n = model.getNumTrees
    steps = T.scores_per_round(model, train, ["id"], every=25)
    assert sorted(r[0] for r in steps.select("iteration").distinct().collect()) == sorted({*range(25, n + 1, 25), n})
    one = T.scores_per_round(model, train, ["id"]).where("iteration = 25").withColumnRenamed("margin", "m")
    both = steps.where("iteration = 25").join(one, "id")
    assert both.where("abs(margin - m) > 1e-12").count() == 0


def test_rounds_end_early_on_validation_rows(rows):
    train = ready(rows).withColumn("check", F.col("id") % 4 == 0)
    model = T.fit_boosted(train, "y", "w", 30, 0.3, validation="check")
    assert model.getNumTrees < 30


def test_random_params_and_mask_are_reproducible():
    a, b = M.random_params(M.SEARCH_SPACE, 3, 1), M.random_params(M.SEARCH_SPACE, 3, 1)
    assert a == b and all(10 <= p["num_leaves"] <= 500 for p in a)
    names = [f"f{i}" for i in range(50)]
    assert M.random_mask(names, 4) == M.random_mask(names, 4)
    assert 5 < len(M.random_mask(names, 4)) < 45


def test_search_table(rows):
    out = M.search(
        rows, FEATURES, "id", "y", "w", "gain", [202101, 202102], trials=2, rounds=2, folds=2,
        learning_rate=0.3, sampling=0.5, space={"num_leaves": (2, 8, int)}, mask=True,
    )
    got = out.orderBy("number").collect()
    assert [r["number"] for r in got] == [0, 1]
    for r in got:
        assert 1 <= r["best_iter"] <= 2 and r["sampling"] == 0.5
        assert r["train_months"] == [202101, 202102] and 0 < len(r["features"]) <= 3


def test_cv_curve_matches_single_models(rows):
    df = kfold(rows, "id", "label", 2, 42)
    ready_rows = ready(df, "fold")
    curve = M.cv_curve(ready_rows, "id", "y", "w", "gain", 2, 2, 0.3, {"num_leaves": 4})
    gains = []
    for k in (0, 1):
        model = T.fit_boosted(ready_rows.where(F.col("fold") != k), "y", "w", 2, 0.3, {"num_leaves": 4})
        scores = T.predict(model, ready_rows.where(F.col("fold") == k), ["id", "gain"])
        gains.append(gain_max(scores, "pred", "id", "gain").first()[0])
    assert curve.where("iteration = 2").first()["gain_mean"] == pytest.approx(sum(gains) / 2)


def test_targets_side_by_side(rows):
    two = rows.withColumn("z", (F.col("a") > 0.8).cast("int"))
    out = M.compare_targets(two, FEATURES, "id", ["y", "z"], "w", "gain", 2, 2, 0.3)
    assert out.columns == ["iteration", "y", "z"] and out.count() == 2


def test_gain_evaluator_in_cross_validator(rows):
    df = ready(kfold(rows, "id", "label", 2, 42), "fold").withColumn("y", F.col("y").cast("double"))
    gbt = GBTClassifier(featuresCol="features", labelCol="y", maxIter=2, seed=1)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, [1, 3]).build()
    cv = CrossValidator(
        estimator=gbt, estimatorParamMaps=grid, evaluator=GainEvaluator("id", "gain"), numFolds=2, foldCol="fold"
    )
    metrics = cv.fit(df).avgMetrics
    assert len(metrics) == 2 and metrics[1] >= metrics[0]


def test_backtest_resumes(spark, rows, tmp_path):
    path = str(tmp_path / "bt")
    ready_rows = ready(rows)
    numbers = spark.createDataFrame([(0,)], "number int")
    trials = {0: {"params": {"num_leaves": 4}, "best_iter": 2}}
    args = (ready_rows, ready_rows, "id", "y", "w", "label", "gain")
    M.backtest(spark, *args, plan_runs(numbers, "number", [17], [202105], "e").where("seed = 17"), trials, path)
    files = set(spark.read.parquet(path).inputFiles())
    M.backtest(spark, *args, plan_runs(numbers, "number", [17], [202105], "e"), trials, path)
    assert files < set(spark.read.parquet(path).inputFiles())
    done = finished_runs(spark, path, ["seed"], "seed int")
    assert sorted(r[0] for r in done.collect()) == [17, 18]
    curve = read_cut_points(spark, path)
    assert curve.count() == 1200
    sides = curve.where("seed = 17").agg(F.sum((F.col("public") != 0).cast("int")), F.max("nro_envios")).first()
    assert sides[1] == 599 and sides[0] == 180


def test_submissions_of_all_models_and_cutoffs(spark, rows, tmp_path):
    path = str(tmp_path / "sub")
    trials = {3: {"params": {"num_leaves": 4}, "best_iter": 2}}
    M.submissions(ready(rows), ready(rows), "id", "y", "w", trials, [17, 19], [50, 100], path)
    out = spark.read.csv(path, header=True, schema="id bigint, Predicted int, trial int, seed int, n_envios int")
    got = {tuple(r) for r in out.groupBy("trial", "seed", "n_envios").agg(F.count("*"), F.sum("Predicted")).collect()}
    assert got == {(3, s, n, 600, n) for s in (17, 19) for n in (50, 100)}


def test_split_counts_equal_a_walk_of_the_model(spark, rows):
    model = T.fit_boosted(ready(rows), "y", "w", 4, 0.3, {"num_leaves": 8})
    plain = {}

    def walk(node, depth):
        if node.numDescendants() == 0:
            return
        key = (node.split().featureIndex(), depth)
        plain[key] = plain.get(key, 0) + 1
        walk(node.leftChild(), depth + 1)
        walk(node.rightChild(), depth + 1)

    for tree in model.trees:
        walk(tree._call_java("rootNode"), 0)
    by_depth = T.split_counts(model, FEATURES, spark, 7, by_depth=True).collect()
    assert {(FEATURES.index(r["fname_model"]), r["depth"]): r["splits"] for r in by_depth if r["splits"]} == plain
    assert len(by_depth) == len(FEATURES) * (1 + max(d for _, d in plain)) and {r["model"] for r in by_depth} == {7}
    whole = {r["fname_model"]: r["splits"] for r in T.split_counts(model, FEATURES + ["unused"], spark).collect()}
    assert whole == {**{f: sum(n for (i, _), n in plain.items() if FEATURES[i] == f) for f in FEATURES}, "unused": 0}


def test_margins_of_large_ids(spark):
    from cohortlens.plans.model_queries import with_margins

    ids = [1_000_001, 14_060_199_807, 900_000_000_000 + 200_001, 9_000_000_000_000_000_000, -900_000_200_001]
    data = [(i, -7000 if i % 2 else 273000, n, t) for i in ids for n in (1, 10) for t in (0, 1)]
    rows = with_margins(spark.createDataFrame(data, "id long, gain long, iteration int, trial int")).collect()
    for (i, gain, n, t), r in zip(data, rows):
        noise = abs(i) * (7919 + 104729 * n + 15485863 * t) % 1000003 * (1 if i > 0 else -1)
        assert r["margin"] == noise + (60000 * (6 - abs(n - 4 - 2 * t)) if gain > 0 else 0), (i, n, t)


def test_tasks_of_a_fit_follow_the_rows(spark, rows, monkeypatch):
    few = spark.range(1000).coalesce(1)
    assert T._spread(few).rdd.getNumPartitions() == 1
    monkeypatch.setattr(T, "FIT_ROWS", 100)
    spread = T._spread(few)
    assert max(spread.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 110
    assert spread.agg(F.sum("id")).first()[0] == 499500
    assert T.fit_boosted(ready(rows), "y", "w", 2).getNumTrees == 2
