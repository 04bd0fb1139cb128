import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import drift as D


def brute_psi(train, score, buckets):
    """The index on plain arrays."""
    e, a = train[~np.isnan(train)], score[~np.isnan(score)]
    edges = np.unique(np.quantile(e, np.arange(buckets + 1) / buckets))
    p = np.histogram(e, edges)[0] / len(e)
    q = np.histogram(a, edges)[0] / len(a)
    with np.errstate(all="ignore"):
        out = ((q - p) * np.log(q / p)).sum()
    n, m = np.isnan(train).mean(), np.isnan(score).mean()
    return out + ((m - n) * np.log(m / n) if n > 0 and m > 0 else 0)


def frame(spark, train, score):
    rows = [(i, 1, None if np.isnan(v) else float(v)) for i, v in enumerate(train)]
    rows += [(i, 2, None if np.isnan(v) else float(v)) for i, v in enumerate(score)]
    return spark.createDataFrame(rows, "id long, period int, x double")


def psi(spark, train, score, **kw):
    out = D.psi(frame(spark, train, score), ["x"], "id", "period", [1], [2], **kw)
    return out.first()["psi"]


def test_same_sample_has_no_drift(spark):
    x = np.arange(500.0)
    assert psi(spark, x, x, buckets=20) == 0


@pytest.mark.parametrize("buckets", [5, 20])
def test_against_arrays(spark, buckets):
    rng = np.random.default_rng(1)
    train = np.round(rng.normal(0, 1, 800), 2)
    score = np.round(rng.normal(0.2, 1.1, 900), 2)
    train[:200] = 0.0
    train[300:340] = np.nan
    score[:100] = np.nan
    assert psi(spark, train, score, buckets=buckets) == pytest.approx(brute_psi(train, score, buckets))


def test_empty_bin_is_infinite_unless_floored(spark):
    train = np.arange(100.0)
    score = np.concatenate([np.arange(50.0), np.arange(200.0, 240.0)])
    assert psi(spark, train, score, buckets=10) == math.inf
    floored = psi(spark, train, score, buckets=10, floor=1e-4)
    p, q = np.full(10, 0.1), np.array([10 / 90] * 5 + [1e-4] * 5)
    assert floored == pytest.approx(((q - p) * np.log(q / p)).sum(), rel=0.05)


def test_nulls_on_one_side_only_add_nothing(spark):
    x = np.arange(200.0)
    with_null = np.append(x, np.nan)
    assert psi(spark, x, with_null, buckets=10) == 0
    assert psi(spark, with_null, x, buckets=10) == 0


def test_constant_column_has_no_bins(spark):
    assert psi(spark, np.ones(50), np.ones(50)) == 0


def test_many_columns_in_one_frame(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"id": range(n), "period": [1, 2] * (n // 2), "a": rng.random(n), "b": rng.integers(0, 4, n) * 1.0})
    out = D.psi(spark.createDataFrame(pdf), ["a", "b"], "id", "period", [1], [2], buckets=6)
    got = {r["feature"]: r["psi"] for r in out.collect()}
    for c in ("a", "b"):
        want = brute_psi(pdf[pdf.period == 1][c].to_numpy(), pdf[pdf.period == 2][c].to_numpy(), 6)
        assert got[c] == pytest.approx(want, nan_ok=True)
    assert D.psi_report(out).columns == ["feature", "psi"]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 100, 1001), 1)
    x[:400] = 3.5
    df = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(x)], "id long, g string, v double")
    out = D.exact_quantiles(df, F.col("v"), F.col("id"), 16, ["g"]).first()["edges"]
    assert np.allclose(out, np.quantile(x, np.arange(17) / 16))


def test_describe(spark):
    pdf = pd.DataFrame({"id": range(7), "a": [1.0, 2, 2, 5, None, 9, 4], "b": [0.0] * 7})
    df = spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None)))
    out = D.describe_numeric(df, ["a", "b"], "id").where("feature = 'a'").first()
    want = pdf["a"].describe()
    got = [out[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
    assert np.allclose(got, want.to_numpy())


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (3, 2.0)], "a int, b double")
    got = {r["feature"]: tuple(r)[1:] for r in D.column_profile(df, ["a", "b"]).collect()}
    assert got == {"a": (1.0, 3.0, 2, 0), "b": (2.0, 2.0, 1, 1)}
    near = {r["feature"]: r["nunique"] for r in D.column_profile(df, ["a", "b"], approx=0.05).collect()}
    assert near == {"a": 2, "b": 1}


def test_psi_without_broadcast(spark, tiny_pins):
    x = np.arange(300.0)
    assert psi(spark, x, x + 20, buckets=5) == pytest.approx(brute_psi(x, x + 20, 5))


def test_profile_of_any_type(spark):
    df = spark.createDataFrame([(2**53, "b", None), (2**53 + 1, "a", 1.5), (2**53, None, 1.5)], "n long, t string, x double")
    got = {r["feature"]: tuple(r)[1:] for r in D.column_profile(df, ["n", "t", "x"]).collect()}
    assert got == {"n": (str(2**53), str(2**53 + 1), 2, 0), "t": ("a", "b", 2, 1), "x": ("1.5", "1.5", 1, 1)}
    assert D.column_profile(df, ["n"]).first()["nunique"] == 2


def test_profile_counts_values_before_they_are_shuffled(spark):
    """A column is counted in its own type; nulls, texts, dates and no rows."""
    df = spark.range(1000).select(
        F.when(F.col("id") % 4 > 0, F.col("id") % 3).alias("few"),
        F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("zero"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("day"),
    )
    out = D.column_profile(df, ["few", "zero", "day"])
    assert {r["feature"]: (r["nunique"], r["nulls"]) for r in out.collect()} == {"few": (3, 250), "zero": (1, 0), "day": (7, 0)}
    assert D.column_profile(df.limit(0), ["few", "zero", "day"]).collect() == []
