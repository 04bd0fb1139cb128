import pytest
from pyspark.sql import functions as F

from cohortlens.operators import sampling as S


def rows(spark, n=1000):
    x = F.col("id")
    return spark.range(n).select(
        "id",
        (x % 3).cast("int").alias("period"),
        F.when(x % 10 == 0, "BAJA+1").when(x % 10 == 1, "BAJA+2").when(x % 10 < 4, F.lit(None)).otherwise("CONTINUA").alias("label"),
    )


def test_half_rounds_to_even(spark):
    df = spark.range(5).withColumn("g", F.lit("a"))
    assert S.in_exact_sample(df, "id", ["g"], 0.5, 1).where("sampled").count() == 2
    df = spark.range(7).withColumn("g", F.lit("a"))
    assert S.in_exact_sample(df, "id", ["g"], 0.5, 1).where("sampled").count() == 4


def test_no_and_all_rows(spark):
    df = spark.range(9).withColumn("g", F.lit("a"))
    assert S.in_exact_sample(df, "id", ["g"], 0.0, 1).where("sampled").count() == 0
    assert S.in_exact_sample(df, "id", ["g"], 1.0, 1).where("sampled").count() == 9


def test_undersample_keeps_all_but_the_majority(spark):
    df = rows(spark)
    out = S.undersample(df, "id", "period", "label", 0.2)
    assert out.columns == df.columns
    stays = F.col("label").eqNullSafe("CONTINUA")
    assert out.where(~stays).count() == df.where(~stays).count()
    want = {r[0]: round(r[1] * 0.2) for r in df.where(stays).groupBy("period").count().collect()}
    assert {r[0]: r[1] for r in out.where(stays).groupBy("period").count().collect()} == want


def test_sample_does_not_depend_on_partitions_or_order(spark):
    df = rows(spark)
    a = S.stratified_split(df, "id", "label", 0.3, 7)
    b = S.stratified_split(df.repartition(13).orderBy(F.desc("id")), "id", "label", 0.3, 7)
    assert sorted(map(tuple, a.select("id", "side").collect())) == sorted(map(tuple, b.select("id", "side").collect()))
    c = S.stratified_split(df, "id", "label", 0.3, 8)
    assert a.select("id", "side").exceptAll(c.select("id", "side")).count() > 0


def test_split_is_exact_per_label_with_nulls(spark):
    out = S.stratified_split(rows(spark), "id", "label", 0.3, 7)
    got = {r[0]: (r["public"], r["private"]) for r in out.groupBy("label").pivot("side").count().collect()}
    assert got == {"BAJA+1": (30, 70), "BAJA+2": (30, 70), None: (60, 140), "CONTINUA": (180, 420)}


def test_repeated_splits(spark):
    out = S.repeated_splits(rows(spark, 200), "id", "label", 5, 0.3)
    assert out.count() == 1000
    assert out.where("side = 'public'").groupBy("split").count().select("count").distinct().collect()[0][0] == 60
    assert out.where("side = 'public'").groupBy("id").count().count() > 100


def test_folds_are_even_within_each_label(spark):
    out = S.kfold(rows(spark), "id", "label", 5, 3)
    sizes = out.groupBy("label", "fold").count().groupBy("label").agg(F.max("count") - F.min("count"), F.count("*"))
    assert all(r[1] <= 1 and r[2] == 5 for r in sizes.collect())


def test_sampling_does_not_shuffle_the_rows(spark):
    out = S.in_exact_sample(rows(spark), "id", ["label"], 0.3, 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sampling_without_broadcast(spark, tiny_pins):
    out = S.stratified_split(rows(spark, 300), "id", "label", 0.3, 7)
    assert out.where("side = 'public'").count() == 9 + 9 + 18 + 54


def test_splits_are_independent(spark):
    """Any three splits share 0.3 ** 3 of their public rows, in neighbouring and in distant numbers."""
    df = spark.range(20_000).withColumn("label", F.lit("a"))
    sides = S.repeated_splits(df, "id", "label", 12).where("side = 'public'")
    wide = sides.groupBy("id").pivot("split", list(range(1, 13))).count().fillna(0).toPandas()
    for three in ((1, 2, 3), (2, 3, 4), (10, 11, 12), (1, 3, 5), (1, 6, 11)):
        share = (wide[list(map(str, three))].sum(axis=1) == 3).sum() / 20_000
        assert abs(share - 0.027) < 0.006, (three, share)


def test_masks_equal_repeated_splits(spark, monkeypatch):
    """Many rows of few keys: ties at the last key are decided by id; more splits than one word holds."""
    from cohortlens.functions import scalars

    prime = 101  # small enough for ties
    for module in (scalars, S):
        monkeypatch.setattr(module, "SPLIT_PRIME", prime)
    monkeypatch.setattr(scalars, "SPLIT_BITS", 12)
    monkeypatch.setattr(S, "SPLIT_BITS", 12)
    monkeypatch.setattr(S, "MASK_DIGIT_BITS", 6)
    df = spark.range(400).select(
        F.format_string("c%03d", "id").alias("id"), F.when(F.col("id") % 7 != 0, (F.col("id") % 3).cast("int")).alias("label"),
        (F.col("id") % 11 - 3).alias("gain"),
    ).repartition(4)
    n = 65
    masked = S.split_masks(df, "id", "label", n, 0.3).collect()
    assert len(masked) == 400 and {len(r["public_splits"]) for r in masked} == {2}
    sided = S.repeated_splits(df, "id", "label", n, 0.3).collect()
    want = {(r["id"], r["split"]): r["side"] == "public" for r in sided}
    for r in masked:
        for s in range(n):
            assert bool(r["public_splits"][s // 62] >> (s % 62) & 1) == want[r["id"], s + 1]
    gains = S.split_gains(S.split_masks(df, "id", "label", n, 0.3), {"m": F.col("gain") > 0}, "gain", n).collect()
    won = {r["id"]: max(r["gain"], 0) for r in masked}
    for r in gains:
        public = sum(g for i, g in won.items() if want[i, r["split"]])
        assert r["m_public"] == pytest.approx(public / 0.3)
        assert r["m_private"] == pytest.approx((sum(won.values()) - public) / 0.7)
    none = S.split_masks(df.limit(0), "id", "label", 3)
    assert none.collect() == [] and [r["m_public"] for r in S.split_gains(none, {"m": F.lit(True)}, "gain", 3).collect()] == [0, 0, 0]
