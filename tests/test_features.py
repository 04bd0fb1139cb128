import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.functions import null_safe_sum, root_name, safe_ratio
from cohortlens.operators import features as X
from cohortlens.operators import impute as I
from cohortlens.operators import ranks as R
from cohortlens.operators.training import training_sets


def test_safe_ratio_and_sum(spark):
    df = spark.createDataFrame([(5, 0), (5, None), (None, 2), (None, None), (3, 2)], "a int, b int")
    got = df.select(safe_ratio("a", "b"), null_safe_sum("a", "b")).collect()
    assert [r[0] for r in got] == [None, None, 0.0, None, 1.5]
    assert [r[1] for r in got] == [5, 5, 2, 0, 5]


def test_targets_of_every_class(spark):
    df = spark.createDataFrame([("CONTINUA",), ("BAJA+1",), ("BAJA+2",), (None,)], "label string")
    got = [tuple(r)[1:] for r in X.class_targets(df, "label").collect()]
    assert got == [(1.0, 0, 0), (1.00001, 0, 1), (1.00002, 1, 1), (1.0, 0, 1)]


def test_new_customers_counter(spark):
    df = spark.createDataFrame([(1, 3, "x"), (2, 3, "x"), (3, 3, "x")], "tenure int, trx int, o string")
    out = X.scale_new_customers(df, "trx", "tenure")
    assert out.columns == ["tenure", "o", "trx"]
    assert [r["trx"] for r in out.orderBy("tenure").collect()] == [9.0, 4.5, 3.0]


def base_columns():
    made = set(X.TOTALS) | {c for pair in X.EXTREMES for c in pair} | set(X.RATIOS)
    used = [c for parts in X.TOTALS.values() for c in parts]
    used += [c for parts in X.EXTREMES.values() for c in parts]
    used += [c for pair in X.RATIOS.values() for c in pair]
    used += ["ctrx_quarter", "cliente_antiguedad"]
    return sorted(set(used) - made)


def test_bank_features(spark):
    cols = base_columns()
    values = {c: float(i + 1) for i, c in enumerate(cols)}
    values["Visa_mlimitecompra"] = None
    values["cinversion2"] = 0.0
    df = spark.createDataFrame([tuple(values[c] for c in cols)], ", ".join(f"{c} double" for c in cols))
    row = X.bank_features(df).first()
    v = lambda c: values[c] or 0.0
    assert row["mtc_limitecompra_total"] == v("Master_mlimitecompra")
    assert row["mtc_adelanto_total"] == sum(
        v(f"{b}_madelanto{k}") for b in ("Master", "Visa") for k in ("pesos", "dolares")
    )
    assert row["c_seguros_total"] == sum(
        v(c) for c in ("cseguro_vida", "cseguro_auto", "cseguro_vivienda", "cseguro_accidentes_personales")
    )
    assert row["m_promedio_inversion2"] is None
    assert row["m_promedio_atm"] == v("matm") / v("catm_trx")
    assert row["proporcion_limite_visa_cubierto"] is None
    assert row["tc_fechamora_menor"] == min(v("Master_Finiciomora"), v("Visa_Finiciomora"))
    assert len(X.RATIOS) == 42 and len(X.TOTALS) == 5 + 18 + 5 and len(X.EXTREMES) == 4


def test_impute_rules(spark):
    df = spark.createDataFrame([(None, None, None, None)], "a double, lag1_a double, lag2_b int, c int")
    row = I.impute_rules(df, {"a": None, "lag1_a": -1, "b": -99}).first()
    assert tuple(row) == (None, -1.0, -99, None)


def test_impute_mean_is_fitted_on_train(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double")
    test = spark.createDataFrame([(None,), (10.0,)], "a double")
    means = I.column_means(train, ["a"])
    assert [r[0] for r in I.impute_mean(test, means).collect()] == [2.0, 10.0]


@pytest.mark.parametrize("tiles", [4, 10, 200])
def test_tiles_equal_ntile(spark, tiles):
    x = F.col("id")
    df = spark.range(700).select(
        "id",
        F.when(x % 9 == 0, F.lit(0)).otherwise(x % 2 + 1).cast("int").alias("period"),
        F.when(x % 3 == 0, F.lit(1.0)).when(x % 7 == 0, F.lit(None)).otherwise(F.hash(x) % 50).cast("double").alias("a"),
        (F.hash(x) % 1000).alias("b"),
    )
    out = R.ntile_features(df, ["a", "b"], "id", "period", tiles, replace=False)
    for c in ("a", "b"):
        w = Window.partitionBy("period").orderBy(F.col(c).asc_nulls_last(), "id")
        out = out.withColumn(f"want_{c}", F.ntile(tiles).over(w))
    assert out.where("ntile_a <> want_a or ntile_b <> want_b").count() == 0
    assert out.count() == 700


def test_tiles_replace_the_columns(spark):
    df = spark.createDataFrame([(1, 1, 2.0, "k")], "id int, period int, m double, o string")
    assert R.ntile_features(df, ["m"], "id", "period", 200).columns == ["id", "period", "o", "ntile_m"]


def test_tiles_without_broadcast(spark, tiny_pins):
    df = spark.range(60).selectExpr("id", "cast(id % 2 as int) as period", "cast(id % 9 as double) as m")
    out = R.ntile_features(df, ["m"], "id", "period", 10, replace=False)
    w = Window.partitionBy("period").orderBy("m", "id")
    assert out.withColumn("want", F.ntile(10).over(w)).where("want <> ntile_m").count() == 0


def test_rank_family(spark):
    df = spark.createDataFrame(
        [(i, 1, v) for i, v in enumerate([3.0, 1.0, 1.0, None, 9.0, 4.0, 4.0, 4.0])], "id int, period int, m double"
    )
    out = R.rank_family(df, {"m": {"ordinal", "percentil", "cuartil"}}, "id", "period")
    w = Window.partitionBy("period").orderBy(F.col("m").asc_nulls_last())
    want = df.select(
        "id",
        F.rank().over(w).cast("double").alias("o"),
        F.percent_rank().over(w).alias("p"),
        F.ntile(4).over(w.orderBy(F.col("m").asc_nulls_last(), "id")).cast("double").alias("q"),
    )
    got = out.select("id", "ordinal_m", "percentil_m", "cuartil_m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_root_name(spark):
    df = spark.createDataFrame([("lag1_a",), ("lag2_a",), ("a_lag1_",)], "n string")
    assert [r[0] for r in df.select(root_name("n")).collect()] == ["a", "a", "a_lag1_"]


def test_deciles(spark):
    df = spark.range(40).selectExpr("id", "cast(id % 2 as int) as foto_mes", "cast(id as int) as cliente_antiguedad", "cast(null as int) as tc_fechaalta_mayor")
    out = X.add_deciles(df, X.DECILES, "id", "foto_mes").where("foto_mes = 0").orderBy("id")
    got = [(r["cliente_antiguedad_decil"], r["antiguedad_tarjetas"]) for r in out.collect()]
    assert got == [(i // 2 + 1, i // 2 + 1) for i in range(20)]


def test_training_sets(spark):
    rows = [(i, m, "CONTINUA" if i % 2 else "BAJA+2", 1.0, 2.0) for m in (1, 2) for i in range(20)]
    rows += [(i, 3, None, 1.0, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, foto_mes int, label string, a double, b double")
    sets = training_sets(df, "id", "foto_mes", "label", [1, 2], [3], fraction=0.5, drop=["b"])
    assert sets.features == ["a"] and sets.test.count() == 5
    got = {r[0]: r[1] for r in sets.train.groupBy("label").count().collect()}
    assert got == {"CONTINUA": 10, "BAJA+2": 20}
    also = training_sets(df, "id", "foto_mes", "label", [1, 3], [3], drop_unlabelled=True)
    assert also.train.count() == 20 and also.test.count() == 5


def test_sentinels_widen_whole_number_columns(spark):
    from cohortlens.operators.impute import impute_rules

    df = spark.createDataFrame([(None, None, None), (1, 2, 3)], "a int, b tinyint, c bigint")
    out = impute_rules(df, {"a": -9999999999, "b": -1.0, "c": 0.5})
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "tinyint", "double"]
    assert sorted(map(tuple, out.collect())) == [(-9999999999, -1, 0.5), (1, 2, 3.0)]
