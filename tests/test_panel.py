import pytest
from pyspark.sql import functions as F

from cohortlens.functions import month_index, select_columns, yyyymm
from cohortlens.operators import panel as P


def label_panel(spark, months):
    seen = {"A": (1, 2, 3, 4), "B": (1, 2), "C": (1,), "D": (1, 3), "E": (1, 2, 4)}
    rows = [(c, months[m - 1]) for c, ms in seen.items() for m in ms]
    return spark.createDataFrame(rows, "id string, period int")


WANT = {
    ("A", 1): "CONTINUA",
    ("A", 2): "CONTINUA",
    ("A", 3): None,
    ("A", 4): None,
    ("B", 1): "BAJA+2",
    ("B", 2): "BAJA+1",
    ("C", 1): "BAJA+1",
    ("D", 1): "CONTINUA",
    ("D", 3): None,
    ("E", 1): "BAJA+2",
    ("E", 2): "CONTINUA",
    ("E", 4): None,
}


@pytest.mark.parametrize("calendar", [False, True])
def test_label(spark, calendar):
    months = [202011, 202012, 202101, 202102]
    out = P.churn_label(label_panel(spark, months), "id", "period", calendar=calendar)
    got = {(r["id"], months.index(r["period"]) + 1): r["label"] for r in out.collect()}
    assert got == WANT


def test_label_by_observed_and_by_calendar_month(spark):
    df = spark.createDataFrame([(1, 202101), (1, 202103), (1, 202104), (2, 202101)], "id int, period int")
    seen = {(r["id"], r["period"]): r["label"] for r in P.churn_label(df, "id", "period").collect()}
    assert seen[(1, 202101)] == "CONTINUA" and seen[(2, 202101)] == "BAJA+1"
    cal = P.churn_label(df, "id", "period", calendar=True)
    cal = {(r["id"], r["period"]): r["label"] for r in cal.collect()}
    assert cal[(1, 202101)] == "CONTINUA" and cal[(1, 202103)] is None
    other = spark.createDataFrame([(1, 202101), (1, 202104), (2, 202104)], "id int, period int")
    cal = P.churn_label(other, "id", "period", calendar=True).where("period = 202101").first()
    assert cal["label"] == "BAJA+1"


def test_label_keeps_other_columns_and_their_order(spark):
    df = spark.createDataFrame([(202101, 5.0, 1)], "period int, amount double, id int")
    assert P.churn_label(df, "id", "period").columns == ["period", "amount", "id", "label"]


def test_dense_panel_and_presence(spark):
    df = spark.createDataFrame([(1, 202101, 3.0), (2, 202102, 4.0)], "id int, period int, v double")
    assert P.dense_panel(df, "id", "period").count() == 4
    got = {(r["id"], r["period"]): (r["present"], r["v"]) for r in P.panel_presence(df, "id", "period").collect()}
    assert got == {
        (1, 202101): (1, 3.0),
        (1, 202102): (0, None),
        (2, 202101): (0, None),
        (2, 202102): (1, 4.0),
    }


def test_lags_across_a_gap(spark):
    df = spark.createDataFrame([(1, 202012, 5.0), (1, 202102, 7.0)], "id int, period int, v double")
    by_row = P.lag_features(df, ["v"], "id", "period").where("period = 202102").first()
    assert (by_row["lag1_v"], by_row["lag2_v"]) == (5.0, None)
    by_month = P.lag_features(df, ["v"], "id", "period", calendar=True).where("period = 202102").first()
    assert (by_month["lag1_v"], by_month["lag2_v"]) == (None, 5.0)


def test_variation_is_null_after_zero_or_missing(spark):
    rows = [(1, 1, 0.0), (1, 2, 4.0), (1, 3, 6.0), (1, 4, None)]
    df = spark.createDataFrame(rows, "id int, period int, v double")
    out = P.variations(df, ["v"], "id", "period", lags=(1,)).orderBy("period").collect()
    assert [r["variacion1_v"] for r in out] == [None, None, 0.5, None]


def test_all_lags_share_one_window_and_sort(spark):
    df = spark.createDataFrame([(1, 1, *range(30))], "id int, period int, " + ", ".join(f"c{i} int" for i in range(30)))
    plan = P.lag_features(df, [f"c{i}" for i in range(30)], "id", "period")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Sort [") == 1


def test_lag_join_with_and_without_label_match(spark):
    df = spark.createDataFrame([(1, 1, "CONTINUA", 2.0), (1, 2, None, 3.0)], "id int, period int, label string, v double")
    lags = P.lag_features(df, ["v"], "id", "period", lags=(1,), keep=["label"])
    joined = P.lag_join(df, lags, "id", "period", "label")
    assert joined.count() == 2 and joined.columns.count("label") == 1
    assert P.lag_join(df, lags, "id", "period", "label", match_label=True).count() == 1


def test_split_months_may_overlap(spark):
    df = spark.createDataFrame([(1, m) for m in (1, 2, 3)], "id int, period int")
    train, test = P.month_split(df, "period", [1, 2], [2, 3])
    assert (train.count(), test.count()) == (2, 2)


def test_month_helpers(spark):
    row = spark.sql("select timestamp_ntz'2020-12-31 10:00:00' as t, 202101 as p")
    got = row.select(yyyymm("t"), month_index("p") - month_index(yyyymm("t"))).first()
    assert tuple(got) == (202012, 1)


def test_too_many_periods_are_refused(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_PERIODS", 3)
    with pytest.raises(ValueError):
        P.observed_periods(spark.range(10), "id")


def test_select_columns(spark):
    df = spark.range(1).selectExpr("1 as mcuenta", "2 as ccaja", "3 as lag1_mcuenta", "4 as foto_mes")
    assert select_columns(df, "^m|^lag1_m") == ["mcuenta", "lag1_mcuenta"]
    assert select_columns(df, exclude="foto|lag") == ["mcuenta", "ccaja"]


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "id int, period int")
    assert [tuple(r) for r in P.duplicate_keys(df, "id", "period").collect()] == [(1, 1, 2)]


def test_label_window_has_one_shuffle(spark):
    df = label_panel(spark, [1, 2, 3, 4]).repartition(4)
    plan = P.churn_label(df, "id", "period")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_months_reach_the_scan_as_a_date_range(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = P.in_months(orders, "o_orderdate", [199601, 199703])
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in pushed and "LessThan(o_orderdate,1997-04-01" in pushed
    want = orders.where("year(o_orderdate) * 100 + month(o_orderdate) in (199601, 199703)")
    assert out.count() == want.count() > 0
    assert P.in_months(orders, "o_orderdate", []).count() == 0


def test_label_of_repeated_and_null_keys(spark):
    rows = [(1, 1), (1, 1), (1, 2), (1, 3), (2, 1), (2, 1), (2, 2), (3, 1), (3, None), (None, 1), (None, 3)]
    df = spark.createDataFrame(rows, "id long, period int")
    got = sorted(map(str, P.churn_label(df, "id", "period").collect()))
    label = {(1, 1): "CONTINUA", (2, 1): "BAJA+2", (3, 1): "BAJA+1", (None, 1): "CONTINUA"}
    from pyspark.sql import Row

    assert got == sorted(str(Row(id=i, period=p, label=label.get((i, p)))) for i, p in rows)
    once = P.one_row_per_key(df.withColumn("v", F.lit(1)), "id", "period")
    assert once.count() == len(set(rows))
